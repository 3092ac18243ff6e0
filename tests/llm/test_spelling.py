import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairwright.llm import spelling
from pairwright.llm.queries import ORACLES, QUERIES
from pairwright.llm.spelling import near_pairs, spelling_groups, word_counts

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def counts(rows, damaged):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % damaged else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return n


def brute(rows, damaged=199, least=6, least_count=5, ratio=5):
    words = {w: n for w, n in counts(rows, damaged).items() if len(w) >= least and n >= least_count}
    best = {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        form = min(others, key=lambda o: (-words[o], o), default=None)
        best[w] = (form if form and words[form] >= ratio * n else None, len(others))
    out = []
    for w, n in words.items():
        form, n_near = best[w]
        root = w
        while best[root][0]:
            root = best[root][0]
        out.append((w, form, root, n, n_near, words.get(form)))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_query_equals_sql_and_words_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = got(QUERIES["op12_spelling_variants"](spark, sf))
    assert {(w, n) for w, _, _, n, _, _ in found} == {(w, n) for w, n in counts(rows, 199).items() if len(w) >= 6 and n >= 5}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert found == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_spelling_variants']})").fetchall())
    assert any(f for _, f, _, _, _, _ in found)


def test_forms_and_chains(spark):
    text = " ".join(w for w, n in (("Weather", 130), ("weathar", 26), ("weatar", 5), ("weathers", 26), ("wether", 6), ("éléphant", 30), ("ÉLÉPHANT", 6), ("elephant", 6), ("listen", 30), ("silent", 6), ("tinsel", 6)) for _ in range(n))
    rows = [(1, text), (1, text[:40]), (2, None), (3, ""), (None, "weather weather1weather"), (4, "½ 日本 x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    for damaged in (199, 3):
        assert got(spelling_groups(df, damaged=damaged)) == brute(rows, damaged)
    found = {r[0]: r for r in got(spelling_groups(df, damaged=1 << 40))}
    assert found["weathar"][1:3] == ("weather", "weather") and found["weatar"][1:3] == ("weathar", "weather")
    assert found["silent"][4] == 0
    assert spelling_groups(df.limit(0)).count() == 0 and spelling_groups(df.where("text IS NULL")).columns == COLUMNS


def test_long_texts_and_other_names(spark):
    long = "ab" * 2_000
    rows = [(7, " ".join([long] * 6 + [long + "c"] * 6 + ["abcdef " * 100_000]))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "h long, run string, n int")
    assert got(spelling_groups(df, damaged=1 << 40, id_col="h", text_col="run")) == brute(rows, 1 << 40)


@pytest.mark.parametrize("alphabet", ["ab", "abcxyzàÿ÷"])
def test_near_pairs_equal_brute_force(spark, alphabet):
    @settings(max_examples=6, deadline=None)
    @given(st.sets(st.text(alphabet, min_size=1, max_size=9), min_size=1, max_size=120))
    def check(words):
        df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n int")
        found = [(r.word, r.other) for r in near_pairs(df).collect()]
        assert sorted(found) == sorted((a, b) for a in words for b in words if near(a, b))

    check()


def test_counts_need_no_whole_documents(spark):
    plan = word_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan
    assert word_counts(spark.createDataFrame([(1, "x" * 9 + " yyyyyy")], "doc_id long, text string")).agg(F.sum("n")).first()[0] == 2


def test_no_join_sends_words_through_the_driver(spark, monkeypatch):
    """Spark sizes exploded words as the compressed file that they come from, and so would broadcast gigabytes."""
    kept, plans = spelling.staged, []

    def plan_of(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    def seen(df, name):
        plan_of(df)
        return kept(df, name)

    monkeypatch.setattr(spelling, "staged", seen)
    text = " ".join(["weather"] * 130 + ["weathar"] * 26 + ["weatar"] * 5)
    plan_of(spelling_groups(spark.createDataFrame([(1, text)], "doc_id long, text string"), damaged=1 << 40))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p or "BroadcastNestedLoopJoin" in p]
