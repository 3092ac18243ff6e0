"""Statistics of numbers, confusion of reviews with the truth, and violated invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators import graph


def stats(rows: DataFrame, column: str, by: list[str] | None = None, median: bool = False) -> DataFrame:
    """mean, std (population), max, min, n_min, n_max, size, total and num_nan of a column; NaN counts only for num_nan."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    keys = by or []
    rows = rows.select(*keys, x.alias("x"), F.isnan(F.col(column).cast("double")).alias("bad"))
    ends = rows.groupBy(*keys, "x").agg(F.count("*").alias("k"), F.count_if("bad").alias("b"))
    mean = F.sum(F.col("x") * F.col("k")) / F.sum(F.when(F.col("x").isNotNull(), F.col("k")))
    first = ends.groupBy(*keys).agg(
        mean.alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"), F.min_by("k", "x").alias("n_min"), F.max_by("k", "x").alias("n_max"), F.sum("k").alias("size"), F.sum(F.col("x") * F.col("k")).alias("total"), F.sum("b").alias("num_nan"),
    )
    spread = rows.groupBy(*keys).agg(F.stddev_pop("x").alias("std"), *([F.median("x").alias("median")] if median else []))
    return first.join(spread, keys) if keys else first.join(F.broadcast(spread))


def confusion(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def error_edges(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Reviewed pairs whose answer is not the truth."""
    return rows.where((F.col(pred) != "UNREV") & (F.col(pred) != F.col(truth)))


def accuracy(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(n_fn, n_fp, n_tp, pos_acc) of reviewed pairs."""
    count = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    got = rows.agg(count("POSTV", "NEGTV").alias("n_fn"), count("NEGTV", "POSTV").alias("n_fp"), count("POSTV", "POSTV").alias("n_tp"))
    return got.withColumn("pos_acc", F.col("n_tp") / F.nullif(F.col("n_tp") + F.col("n_fn"), F.lit(0)))


def not_disjoint(edges: DataFrame) -> DataFrame:
    """Edges with more than one decision."""
    return edges.groupBy("aid1", "aid2").agg(F.count_distinct("decision").alias("n")).where("n > 1")


def bad_edges(edges: DataFrame) -> DataFrame:
    """Edges whose ends are not in order, or whose decision is none."""
    return edges.where((F.col("aid1") >= F.col("aid2")) | F.col("decision").isNull() | ~F.col("decision").isin(*graph.DECISIONS)).select("aid1", "aid2", "decision")


def meta_violations(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """(what, n): rows where the negative metagraph and the edges disagree; none if all is well."""
    meta = graph.neg_metagraph(edges, pcc)
    weights = meta.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).join(F.broadcast(edges.agg(F.count_if(F.col("decision") == "NEGTV").alias("e"))))
    total = weights.select(F.lit("weights").alias("what"), (F.col("w") - F.col("e")).alias("n"))
    loops, bad = meta.where("nid1 = nid2").select(F.col("nid1").alias("nid")), graph.pcc_summary(edges, pcc).where("NOT is_consistent").select("nid")
    lost = loops.exceptAll(bad).union(bad.exceptAll(loops)).agg(F.count("*").alias("n")).select(F.lit("loops").alias("what"), "n")
    return total.union(lost).where("n <> 0")


def meta_differences(edges: DataFrame, pcc: DataFrame, kept: DataFrame) -> DataFrame:
    """(nid1, nid2, weight, kept): where a negative metagraph that is kept differs from that of the edges; null where one lacks the row."""
    now = graph.neg_metagraph(edges, pcc)
    both = now.join(kept.select("nid1", "nid2", F.col("weight").alias("kept")), ["nid1", "nid2"], "full_outer")
    return both.where("NOT weight <=> kept").select("nid1", "nid2", "weight", "kept")


def recovery_violations(edges: DataFrame, pcc: DataFrame, suspected: DataFrame) -> DataFrame:
    """(nid, what): components with suspected edges (aid1, aid2) that are consistent, or inconsistent ones without any.

    A suspected edge between two components is in neither and counts for its lesser one.
    """
    bad = graph.inconsistent(edges, pcc).withColumn("bad", F.lit(True))
    marked = graph.with_labels(suspected.select("aid1", "aid2"), pcc).select(F.col("nid1").alias("nid"), (F.col("nid1") == F.col("nid2")).alias("inside")).groupBy("nid").agg(F.bool_and("inside").alias("inside"))
    rows = bad.join(marked, "nid", "full_outer")
    what = F.when(F.col("inside").isNull(), "no suspect").when(F.col("bad").isNull(), "consistent").when(~F.col("inside"), "suspect between")
    return rows.select("nid", what.alias("what")).where("what IS NOT NULL")
