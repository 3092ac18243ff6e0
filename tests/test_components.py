import random

import duckdb
import pytest

from pairwright import catalogue
from pairwright.operators import components, kernels
from pairwright.operators.components import connected_components
from pairwright.sources import fixtures


def expected(edges):
    out = {x: x for e in edges for x in e if x is not None}
    return out | dict(kernels.stars([e for e in edges if None not in e and e[0] != e[1]]))


@pytest.mark.parametrize("at_once", [0, 20, 100_000])
def test_rounds_give_the_least_node_reached(spark, at_once):
    rng = random.Random(at_once)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000, i) for i in range(1001, 1060)] + [(i, i + 1) for i in range(2000, 2100)] + [(None, 3), (7, 7), (900, 900), (2, 5), (5, 2)]
    got = connected_components(spark.createDataFrame(edges, "aid1 long, aid2 long"), at_once=at_once).collect()
    assert len(got) == len({r.aid for r in got})
    assert {r.aid: r.nid for r in got} == expected(edges)


def test_rounds_go_on_with_what_is_left(spark, monkeypatch):
    """All rounds together write a small multiple of the edges, as each leaves out what the ones before joined."""
    kept, written = components.staged, []

    def counted(df, name):
        out = kept(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(components, "staged", counted)
    n = 3000
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "aid1 long, aid2 long")
    got = connected_components(edges)
    assert got.where("nid = 0").count() == n + 1
    assert sum(written) < 8 * n


@pytest.mark.parametrize("name", ["meta_edges", "pcc_labels"])
def test_queries_take_rounds_to_the_last_edge(spark, sf, monkeypatch, name):
    """However few edges there are, none are joined in one task beside the rounds."""
    kept, steps, plans = components.staged, [], []

    def seen(df, step):
        steps.append(step)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, step)

    monkeypatch.setattr(components, "staged", seen)
    monkeypatch.setattr(fixtures, "staged", seen)
    monkeypatch.setattr(fixtures, "_kept", {})
    df = catalogue.QUERIES[name](spark, sf)
    got = sorted(map(tuple, df.collect()))
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert steps.count("moves") > 3 and not any("InPandas" in p or "InArrow" in p for p in plans)
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    assert got == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall())
