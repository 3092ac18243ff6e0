"""Generated review graphs, simulated rankers and verifiers, for tests and demonstrations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.codes import INCMP, NEGTV, POSTV, UNREV
from pairwright.operators import graph


def unit(*parts, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on the values given and the seed only."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def generated(spark: SparkSession, n_pccs: int = 16, size: int = 5, size_std: float = 0.0, pos_redun: tuple[int, ...] = (1, 2, 3), p_incon: float = 0.0, p_incomp: float = 0.0, p_pair_neg: float = 0.4, p_pair_incmp: float = 0.2, p_pair_unrev: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(annots, edges): individuals of about ``size`` records, each a ring with chords, and edges between neighbours.

    Individual i gets a connectivity from ``pos_redun``: chords of length up to half of it are
    positive. With probability p_incon some pair inside is negative, with p_incomp
    incomparable. Record j of individual i and record j of individual i + 1 have an edge
    of a kind drawn from the pair probabilities. All draws are hashes of ids and ``seed``.
    """
    groups = spark.range(n_pccs).withColumnRenamed("id", "g")
    spread = F.round(F.lit(size) + F.lit(size_std) * 2 * (unit("g", seed=seed) - 0.5)).cast("int")
    groups = groups.withColumn("n", F.greatest(F.lit(1), spread)).withColumn("k", F.element_at(F.array(*map(F.lit, pos_redun)), F.floor(unit("g", seed=seed + 1) * len(pos_redun)).cast("int") + 1))
    width = size * 4 + 8
    nodes = groups.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    aid = lambda g, j: g * width + j + 1
    annots = nodes.select(aid(F.col("g"), F.col("j")).alias("aid"), F.col("g").alias("name_label"), F.col("g").alias("orig_name_label"))
    chord = nodes.withColumn("d", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("k") / 2)).cast("int")))).where("n > 1").withColumn("o", (F.col("j") + F.col("d")) % F.col("n")).where("o <> j")
    chord = chord.where((F.col("k") > 1) | (F.col("o") > F.col("j")))
    own = chord.select(F.least("j", "o").alias("a"), F.greatest("j", "o").alias("b"), "g").distinct().select(aid(F.col("g"), F.col("a")).alias("aid1"), aid(F.col("g"), F.col("b")).alias("aid2"), F.lit(POSTV).alias("decision"), F.lit(POSTV).alias("truth"))
    wrong = groups.where("n > 3").withColumn("x", unit("g", seed=seed + 2)).where((F.col("x") < p_incon) | (F.col("x") > 1 - p_incomp))
    wrong = wrong.select(aid(F.col("g"), F.lit(0)).alias("aid1"), aid(F.col("g"), F.floor(F.col("n") / 2).cast("int")).alias("aid2"), F.when(F.col("x") < p_incon, NEGTV).otherwise(INCMP).alias("decision"), F.lit(POSTV).alias("truth"))
    pair = nodes.join(groups.select((F.col("g") - 1).alias("g"), F.col("n").alias("m")), "g").where("j < m").withColumn("x", unit("g", "j", seed=seed + 3))
    kind = F.when(F.col("x") < p_pair_neg, NEGTV).when(F.col("x") < p_pair_neg + p_pair_incmp, INCMP).when(F.col("x") < p_pair_neg + p_pair_incmp + p_pair_unrev, UNREV)
    cross = pair.select(aid(F.col("g"), F.col("j")).alias("aid1"), aid(F.col("g") + 1, F.col("j")).alias("aid2"), kind.alias("decision"), F.lit(NEGTV).alias("truth")).where("decision IS NOT NULL")
    edges = wrong.unionByName(own.join(wrong, ["aid1", "aid2"], "left_anti")).unionByName(cross)
    return annots, edges


def simulated_probs(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """Pairs (with ``truth``) with POSTV, NEGTV and INCMP that sum to 1: the truth gets more than half, by hashes."""
    strong = 0.55 + 0.4 * unit("aid1", "aid2", seed=seed)
    share = unit("aid1", "aid2", seed=seed + 1)
    p = lambda c, first: F.when(F.col("truth") == c, strong).otherwise((1 - strong) * (share if first else 1 - share))
    return pairs.withColumns({POSTV: p(POSTV, True), NEGTV: F.when(F.col("truth") == POSTV, (1 - strong) * share).otherwise(p(NEGTV, False)), INCMP: F.when(F.col("truth") == INCMP, strong).otherwise((1 - strong) * (1 - share))})


def ranked(queries: DataFrame, ranker: Callable[[DataFrame], DataFrame], k: int = 10) -> DataFrame:
    """(aid1, aid2): distinct candidate pairs from a ranker that turns (qaid) into (qaid, daid, score)."""
    order = Window.partitionBy("qaid").orderBy(F.desc("score"), "daid")
    best = ranker(queries).where("qaid <> daid").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return best.select(F.least("qaid", "daid").alias("aid1"), F.greatest("qaid", "daid").alias("aid2")).distinct()


def cached_probs(pairs: DataFrame, known: DataFrame, verifier: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Probabilities of pairs: those known, and the verifier's for the rest."""
    columns = ["aid1", "aid2", POSTV, NEGTV, INCMP]
    found = known.join(pairs.select("aid1", "aid2"), ["aid1", "aid2"], "left_semi").select(*columns)
    return found.unionByName(verifier(pairs.join(known, ["aid1", "aid2"], "left_anti")).select(*columns))
