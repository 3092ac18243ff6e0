import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pairwright.operators import kernels, recovery, redundancy
from pairwright.operators.bridges import edge_labels
from pairwright.operators.groups import by_group

PAIRS = "nid long, aid1 long, aid2 long"


def graphs(seed, n=60):
    """Random connected graphs: (nid, u, v)."""
    rng, out = random.Random(seed), []
    for g in range(n):
        size = rng.randint(2, 9)
        nodes = [100 * g + i for i in range(size)]
        rng.shuffle(nodes)
        edges = {tuple(sorted((nodes[i], rng.choice(nodes[:i])))) for i in range(1, size)}
        edges |= {tuple(sorted(rng.sample(nodes, 2))) for _ in range(rng.randint(0, 2 * size))}
        out += [(100 * g, *e) for e in sorted(edges)]
    return out


def parts(edges):
    by = {}
    for nid, u, v in edges:
        by.setdefault(nid, []).append((u, v))
    return by


def falls(edges, gone):
    return len(kernels.components({n for e in edges for n in e}, [e for e in edges if e not in gone])) > 1


def test_labels_tell_bridges_and_cuts_of_two(spark):
    edges = graphs(1)
    rows = spark.createDataFrame(edges + [(0, 5, 5)], PAIRS)
    for at_once in (0, 10_000):
        label = {(r.aid1, r.aid2): (r.label, r.tree) for r in edge_labels(rows, at_once=at_once).collect()}
        assert set(label) == {(u, v) for _, u, v in edges}
        for own in parts(edges).values():
            assert {e for e in own if falls(own, {e})} == {e for e in own if label[e][0] == 0}
            solid = [e for e in own if label[e][0]]
            assert {p for p in combinations(solid, 2) if falls(own, set(p))} == {(a, b) for a, b in combinations(solid, 2) if label[a][0] == label[b][0]}
    assert edge_labels(rows.limit(0)).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4])
def test_edge_connectivity_by_kernel_labels_and_certificate(spark, k):
    edges = graphs(2, 40) + [(9000 + 0, 9000 + a, 9000 + b) for a, b in combinations(range(6), 2)]
    rows = spark.createDataFrame(edges, PAIRS)
    want = sorted((nid, all(not falls(own, set(c)) for i in range(1, k) for c in combinations(own, i)) and len({n for e in own for n in e}) > k) for nid, own in parts(edges).items() if len(own) <= 15)
    keep = {nid for nid, _ in want}
    small = {r.nid: r.held for r in redundancy.edge_connected(rows, k).collect()}
    large = {r.nid: r.held for r in redundancy.edge_connected(rows, k, kernel_edges=0).collect()}
    assert sorted((n, small[n]) for n in keep) == want
    # Degrees rule out components of too few nodes before either is asked.
    assert {n: h for n, h in large.items() if len({x for e in parts(edges)[n] for x in e}) > k} == {n: h for n, h in small.items() if len({x for e in parts(edges)[n] for x in e}) > k}


def test_a_long_ring_takes_rounds_and_no_large_task(spark):
    n = 3000
    ring = spark.range(n).select(F.col("id").alias("aid1"), ((F.col("id") + 1) % n).alias("aid2"))
    ring = ring.select(F.least("aid1", "aid2").alias("aid1"), F.greatest("aid1", "aid2").alias("aid2"))
    chord = ring.union(spark.createDataFrame([(0, n + 1), (5, n + 1), (7, n + 2)], "aid1 long, aid2 long"))
    labels = edge_labels(chord, at_once=100_000)
    assert labels.where("label = 0").select("aid1", "aid2").collect() == [(7, n + 2)]
    # Two cuts of the ring between the ends of the second way from 0 to 5, and the two edges of that way.
    assert sorted(r["count"] for r in labels.groupBy("label").count().collect()) == [1, 2, 5, n - 5]


def test_hub_has_many_blocks(spark):
    hub = spark.range(1, 3000).select(F.lit(0).cast("long").alias("aid1"), F.col("id").alias("aid2"))
    extra = spark.createDataFrame([(1, 2), (2, 3)], "aid1 long, aid2 long")
    labels = edge_labels(hub.union(extra), at_once=100_000)
    assert labels.where("label <> 0").count() == 5 and labels.where("label = 0").count() == 2996


def test_groups_are_streamed(spark):
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, i, None if i % 3 else "x") for i in range(500)], "g long, i long, s string")
    got = by_group(rows, "g", lambda g, own: [(g, len(own), sum(1 for _, s in own if s is None))], "g long, n long, nulls long").collect()
    want = {}
    for g, i, s in ((r.g, r.i, r.s) for r in rows.collect()):
        n, m = want.get(g, (0, 0))
        want[g] = (n + 1, m + (s is None))
    assert {r.g: (r.n, r.nulls) for r in got} == want and len(got) == len(want)


def test_cuts_of_one_network_equal_cuts_of_new_ones():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(2, 7)
        pairs = list(combinations(range(n), 2))
        weighted = [(*e, rng.choice([0, 1, 2, 3.5])) for e in rng.sample(pairs, rng.randint(1, len(pairs)))]
        network = kernels.CutNetwork(weighted)
        for _ in range(6):
            s, t = rng.sample(range(n), 2)
            most = rng.choice([0, 0.2, 1, 2, 3, 5])
            total, cut = kernels.min_cut(weighted, s, t)
            got = network.lighter_cut(s, t, most)
            assert got == (None if most < total else cut)


def test_no_call_sees_more_than_a_component(spark):
    edges = spark.createDataFrame([(10 * g + a, 10 * g + b, "NEGTV" if (a, b) == (0, 2) else "POSTV", 1, 0.5, None) for g in range(50) for a, b in ((0, 1), (1, 2), (0, 2))], "aid1 long, aid2 long, decision string, num_reviews long, prob_match double, confidence string")
    pcc = spark.createDataFrame([(10 * g + i, 10 * g) for g in range(50) for i in range(3)], "aid long, nid long")
    plan = recovery.hypotheses(edges, pcc)
    assert plan.count() == 50 and "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().executedPlan().toString()


def test_pairs_by_rank_are_all_pairs_once(spark):
    sizes = [(a, b) for a in range(1, 8) for b in range(1, 8)]
    df = spark.createDataFrame(sizes, "a long, b long").withColumn("i", F.explode(F.expr("sequence(0L, a * b - 1)")))
    r1, r2 = redundancy.pair_at(F.col("i"), F.col("a"), F.col("b"))
    got = {}
    for r in df.select("a", "b", "i", r1.alias("r1"), r2.alias("r2")).orderBy("i").collect():
        got.setdefault((r.a, r.b), []).append((r.r1, r.r2))
    for (a, b), pairs in got.items():
        assert sorted(pairs) == [(x, y) for x in range(a) for y in range(b)]
        # The first pairs share no record.
        assert len({x for x, _ in pairs[: min(a, b)]}) == len({y for _, y in pairs[: min(a, b)]}) == min(a, b)


def test_absent_pairs_between_components_without_an_edge(spark):
    pcc = spark.createDataFrame([(i, 10 * (i // 10)) for i in (0, 1, 2, 10, 11, 20)], "aid long, nid long")
    edges = spark.createDataFrame([(0, 10, "POSTV"), (0, 20, "UNREV"), (1, 20, "NEGTV")], "aid1 long, aid2 long, decision string")
    asked = spark.createDataFrame([(0, 10), (0, 20), (10, 20)], "nid1 long, nid2 long")
    got = sorted(map(tuple, redundancy.negative_augmentation(edges, pcc, asked).collect()))
    assert got == [(0, 10, 1, 11, False), (0, 10, 2, 10, False), (0, 20, 0, 20, True), (10, 20, 10, 20, False), (10, 20, 11, 20, False)]
    assert len(redundancy.negative_augmentation(edges, pcc, asked, k=5).collect()) == 5 + 2 + 2


def leaves_of(nodes, edges):
    cut = kernels.bridges(edges)
    blocks = kernels.components(nodes, [e for e in edges if e not in cut])
    return [b for b in blocks if sum((u in b) != (v in b) for u, v in cut) == 1]


def reviewed(seed, n, p_open, p_closed):
    """Connected graphs of positive edges, of whose other pairs some are unreviewed or closed: (nid, u, v, decision)."""
    rng, out = random.Random(seed), []
    for g in range(n):
        nodes = [100 * g + i for i in range(rng.randint(3, 12))]
        shuffled = rng.sample(nodes, len(nodes))
        have = {tuple(sorted((shuffled[i], rng.choice(shuffled[:i])))) for i in range(1, len(nodes))}
        have |= {tuple(sorted(rng.sample(nodes, 2))) for _ in range(rng.randint(0, 4))}
        for p in combinations(nodes, 2):
            x = rng.random()
            kind = "POSTV" if p in have else "UNREV" if x < p_open else rng.choice(["NEGTV", "INCMP", "UNKWN"]) if x < p_open + p_closed else None
            out += [(100 * g, *p, kind)] if kind else []
    return out


@pytest.mark.parametrize(("p_open", "p_closed"), [(0.0, 0.0), (0.1, 0.7)])
def test_bridges_are_closed_by_trees_of_blocks(spark, p_open, p_closed):
    rows = reviewed(3, 16, p_open, p_closed)
    edges = spark.createDataFrame(rows, "nid long, aid1 long, aid2 long, decision string").drop("nid")
    own = {}
    for nid, u, v, d in rows:
        own.setdefault(nid, {})[u, v] = d
    members = {nid: {n for e in e_ for n in e} for nid, e_ in own.items()}
    pcc = spark.createDataFrame([(a, nid) for nid, m in members.items() for a in m], "aid long, nid long")
    wanted = {r.nid for r in redundancy.positive_redundancy(edges, pcc, 2, only_consistent=False).collect() if not r.pos_redun}
    found = {}
    for r in redundancy.positive_augmentation(edges, pcc, 2, kernel_edges=0).collect():
        assert r.aid1 < r.aid2 and r.existing == (own[r.nid].get((r.aid1, r.aid2)) == "UNREV")
        found.setdefault(r.nid, []).append((r.aid1, r.aid2))
    assert set(found) <= wanted
    for nid in wanted:
        have = [e for e, d in own[nid].items() if d == "POSTV"]
        usable = [e for e in combinations(sorted(members[nid]), 2) if own[nid].get(e, "UNREV") == "UNREV"]
        got = found.get(nid, [])
        assert set(got) <= set(usable) and len(got) == len(set(got))
        held = lambda more: not kernels.bridges(have + more)  # noqa: B023, E731
        # All that can be closed is.
        assert held(got) == held(usable)
        assert not any(kernels.bridges(have + got) - kernels.bridges(have + usable)) or not held(usable)
        if not p_open and not p_closed:
            assert len(got) == -(-len(leaves_of(members[nid], have)) // 2)
        open_ = [e for e, d in own[nid].items() if d == "UNREV"]
        if held(open_):
            assert set(got) <= set(open_)


def test_a_long_path_is_closed_by_one_edge(spark):
    path = [(i, i + 1, "POSTV") for i in range(500)]
    edges = spark.createDataFrame(path, "aid1 long, aid2 long, decision string")
    pcc = spark.range(501).select(F.col("id").alias("aid"), F.lit(0).cast("long").alias("nid"))
    assert [tuple(r) for r in redundancy.positive_augmentation(edges, pcc, 2, kernel_edges=100).collect()] == [(0, 0, 500, False)]
