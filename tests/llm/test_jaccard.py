import random
import re

import pytest
from pyspark.sql import functions as F

from pairwright.llm import jaccard_join
from pairwright.llm.jaccard_join import choose_l, keep_one_of_each, near_duplicates

#: Chains of revisions, of which a few are joined by one link alone.
CHAINS = 400
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """{(doc_id, n): component}, by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    seen = set()
    for members in by.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if 100 * len(x & y) >= 75 * len(x | y):
                        p, q = sorted((find(sets[a][0]), find(sets[b][0])))
                        root[q] = p
    return sorted((d, len(s), find(d)) for d, s in sets)


def check(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows)
    return docs


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = sorted(map(tuple, near_duplicates(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_of_near_copies_common_passages_and_edges(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    word = lambda: rng.choice(vocabulary) + str(rng.randrange(3))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.randrange(6, 90))]
        for _ in range(rng.randrange(2, 25)):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                at = rng.randrange(len(own))
                own[at : at + 1] = [[], [word()], [word(), word()]][rng.randrange(3)]
            rows.append(own)
            if g % 2:
                rows.append(list(own))
    rows += [passage + [word() for _ in range(rng.randrange(0, 60))] for _ in range(40)]
    rows += [[word() for _ in range(rng.randrange(0, 7))] for _ in range(40)] + [["a"], ["a"], ["A"], ["a", "b"], [], []]
    ids = rng.sample(range(10**6), len(rows))
    rows = [(d, " ".join(r)) for d, r in zip(ids, rows, strict=True)] + [(-7, None), (-8, " \n")]
    docs = check(spark, rows)
    want = {d for d, _, c in brute(rows) if d == c}
    kept = keep_one_of_each(docs.selectExpr("doc_id", "text", "1 AS n", "2 AS rep"))
    assert kept.columns == ["doc_id", "text", "n", "rep"]
    assert {r.doc_id for r in kept.collect()} == want


def test_chains_of_revisions(spark):
    rng = random.Random(5)
    rows = []
    for g in range(CHAINS):
        n = rng.randrange(20, 80)
        words = [f"g{g}w{i}" for i in range(400)]
        step = max(1, n // 7)
        at = 0
        for _ in range(rng.randrange(4, 9)):
            rows.append(" ".join(words[at : at + n + 4]))
            at += rng.randrange(max(1, step - 2), step + 1)
    rows = list(zip(rng.sample(range(10**6), len(rows)), rows, strict=True))
    check(spark, rows)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "x y z q w e r"), (None, "a b c d e f"), (2, "X Y Z q w e r")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id or 0) for r in near_duplicates(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_longer_prefixes_for_frequent_tokens():
    import numpy as np

    l, k = choose_l(np.array([2] * 100), 100)
    assert l >= 1 and k == 25 + l
    l, k = choose_l(np.array([2] * 40 + [5000] * 60), 100)
    assert l > 1 and k == 25 + l  # later shared tokens are as frequent, so more are asked for


def test_maps_bound_shared_tokens():
    import numpy as np

    from pairwright.llm.jaccard_join import maps_before

    rng = np.random.default_rng(4)
    for _ in range(50):
        pool = rng.integers(-(2**62), 2**62, 300)
        x, y = (rng.choice(pool, 120, replace=False) for _ in range(2))
        (mx, ex), (my, ey) = maps_before(x), maps_before(y)
        for i, j in rng.integers(0, 120, (30, 2)):
            common = np.bitwise_count(mx[i].view(np.uint64) & my[j].view(np.uint64)).sum() + min(ex[i], ey[j])
            assert len(set(x[:i]) & set(y[:j])) <= common


def test_columns_with_clashing_names_stay(spark):
    from pairwright.llm.jaccard_join import keep_one_of_each

    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, 5, "a", 1), (2, text, 6, "b", 2), (3, "other words", 7, "c", 3), (None, text, 8, "d", 4)], "doc_id long, text string, slot int, gone string, _slot int")
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.slot, r.gone, r._slot) for r in got.collect()) == [(5, "a", 1), (7, "c", 3), (8, "d", 4)]


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:55_000])), (3, "w1 w2")], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == {1: (59_996, 1), 2: (54_996, 1), 3: (1, 3)}


def test_postings_in_parts_are_the_same_rows(spark, monkeypatch):
    sets = spark.createDataFrame([(d, 12, list(range(d, d + 12))) for d in range(60)], "id long, n long, tokens array<long>").repartition(2)
    rows = lambda: sorted(map(tuple, jaccard_join._postings(sets, 75).collect()))
    whole = rows()
    monkeypatch.setattr(jaccard_join, "POSTINGS_AT_ONCE", 1)
    assert whole and rows() == whole
    nothing = sets.withColumn("tokens", F.array(F.col("id") * 100))
    assert jaccard_join._postings(nothing, 75).count() == 0
