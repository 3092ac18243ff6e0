import time

import numpy as np
from pyspark.sql import functions as F

from pairwright.operators import nearest as n
from pairwright.operators.nearest import nearest


def by_columns(queries, vectors, k):
    """Plain expressions over all pairs."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    wide = lambda df: df.select("id", F.transform("e", lambda x: x.cast("double")).alias("e")).withColumn("n", norm(F.col("e")))
    dot = F.aggregate(F.zip_with("qe", "e", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = wide(queries).toDF("qaid", "qe", "qn").crossJoin(wide(vectors)).where("qaid <> id").select("qaid", "id", F.round(F.try_divide(dot, F.col("qn") * F.col("n")), 6).alias("score")).collect()
    best = {}
    for r in sorted(pairs, key=lambda r: (r.qaid, r.score is None, -(r.score or 0), r.id)):
        best.setdefault(r.qaid, []).append((r.qaid, r.id, r.score, len(best.get(r.qaid, [])) + 1))
    return sorted(x for rows in best.values() for x in rows[:k])


def test_blocks_rank_as_all_pairs_do(spark):
    """Copies, near copies within a unit of rounding, negative scores, vectors with nulls and of other lengths."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8)).astype("float32")
    rows = [*base, *base[:12], *[base[3]] * 20, *(base[:20] + rng.normal(size=(20, 8)) * 4e-4).astype("float32"), *-base[:5]]
    rows = [[float(x) for x in r] for r in rows] + [None, [1.0, None] * 4, [1.0] * 7, [0.5] * 7]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, e array<float>")
    queries = df.where("id % 7 = 0 OR id > 115")
    want = by_columns(queries, df, 5)
    for held, asked in ((1000, 1000), (16, 5)):
        got = sorted(tuple(r) for r in nearest(queries, df, 5, held, asked).collect())
        assert got == want
    assert nearest(df.limit(0), df, 5).count() == nearest(df, df.limit(0), 5).count() == 0


def test_halves_are_rounded_as_columns_are(spark):
    """Scores at half a unit, where the order of ids depends on which way they go."""
    xs = [0.1234565, 0.12345649999, 0.1234566, -0.1234565, -0.1234564, 0.1234565]
    rows = [(0, [1.0, 0.0])] + [(i + 1, [x, float(np.sqrt(1 - x * x))]) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    for k in (1, 2, 3, 5):
        assert sorted(tuple(r) for r in nearest(df.where("id = 0"), df, k, 3, 3).collect()) == by_columns(df.where("id = 0"), df, k)


def test_pairs_cost_products_of_matrices(spark):
    """8 million pairs are scored in seconds; with an expression for each pair it was minutes of CPU."""
    table = spark.range(40_000).select("id", F.array(*[F.rand(i).cast("float") for i in range(64)]).alias("e")).localCheckpoint()
    start = time.time()
    assert nearest(table.where("id % 200 = 0"), table, 5).count() == 1000
    assert time.time() - start < 30
    assert n.HELD * n.STRIPE * 8 < 1 << 25
