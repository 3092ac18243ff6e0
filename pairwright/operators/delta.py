"""What changed between two partitions of items, or between two states of the review log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.session import growing, staged


def grouping_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(item, old_id, new_id, kind) for two tables (item, id).

    kind is added or removed for items of one side only. Of the others, unchanged: both groups
    have the same items; merge: the new group is the union of whole old groups; split: the
    old group is the union of whole new groups; hybrid: neither. Added and removed items do
    not count for what a group holds.
    """
    both = old.select("item", F.col("id").alias("old_id")).join(new.select("item", F.col("id").alias("new_id")), "item", "full_outer")
    kept = both.where("old_id IS NOT NULL AND new_id IS NOT NULL")
    parts = kept.groupBy("old_id", "new_id").agg(F.count("*").alias("n"))
    olds = parts.groupBy("old_id").agg(F.sum("n").alias("old_n"), F.count("*").alias("old_parts"))
    news = parts.groupBy("new_id").agg(F.sum("n").alias("new_n"), F.count("*").alias("new_parts"))
    sized = parts.join(olds, "old_id").join(news, "new_id").withColumns({"whole_old": F.col("n") == F.col("old_n"), "whole_new": F.col("n") == F.col("new_n")})
    pure_merge = sized.groupBy("new_id").agg(F.bool_and("whole_old").alias("merge"))
    pure_split = sized.groupBy("old_id").agg(F.bool_and("whole_new").alias("split"))
    kind = F.when(F.col("whole_old") & F.col("whole_new"), "unchanged").when(F.col("merge"), "merge").when(F.col("split"), "split").otherwise("hybrid")
    kinds = sized.join(pure_merge, "new_id").join(pure_split, "old_id").select("old_id", "new_id", kind.alias("kind"))
    lone = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed")
    return both.join(kinds, ["old_id", "new_id"], "left").select("item", "old_id", "new_id", F.coalesce("kind", lone).alias("kind"))


def unjustified_splits(delta: DataFrame, edges: DataFrame) -> DataFrame:
    """(old_id, new1, new2): parts of a split or hybrid old group with no NEGTV or INCMP edge between them.

    All pairs of parts without a reason are what is asked for, so the result has their number.
    """
    delta = growing(staged(delta, "delta"))
    parts = growing(staged(delta.where("kind IN ('split', 'hybrid')").select("old_id", "new_id").distinct(), "parts"))
    pairs = parts.join(parts.withColumnRenamed("new_id", "next"), "old_id").where("new_id < next")
    # Only edges between two parts that are asked for can be a reason.
    of = growing(delta.where("new_id IS NOT NULL").join(parts.select("new_id").distinct(), "new_id", "left_semi").select("item", "new_id"))
    reasons = edges.where("decision IN ('NEGTV', 'INCMP')").join(of.toDF("aid1", "n1"), "aid1").join(of.toDF("aid2", "n2"), "aid2").select(F.least("n1", "n2").alias("new_id"), F.greatest("n1", "n2").alias("next")).where("new_id < next").distinct()
    return pairs.join(reasons, ["new_id", "next"], "left_anti").select("old_id", F.col("new_id").alias("new1"), F.col("next").alias("new2"))


IMPORTANT = ("evidence_decision", "meta_decision", "tags")


def edge_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of ``new`` that are not in ``old`` or whose evidence decision, meta decision or tags differ (null equals null).

    Tags are an array, compared as it stands; a table without them has null.
    """
    kinds = {"tags": "array<string>"}
    value = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string"))
    o = old.select("aid1", "aid2", *[value(old, c).alias(f"old_{c}") for c in IMPORTANT], F.lit(True).alias("_old"))
    n = new.select("aid1", "aid2", *[value(new, c).alias(f"new_{c}") for c in IMPORTANT])
    rows = n.join(o, ["aid1", "aid2"], "left").withColumn("is_new", F.col("_old").isNull()).drop("_old")
    same = reduce(lambda a, b: a & b, [F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}")) for c in IMPORTANT])
    return rows.where(F.col("is_new") | ~same)


def name_delta(old: DataFrame, new: DataFrame, ignore_unknown: bool = False) -> DataFrame:
    """(aid, old_name, new_name) where the names differ, from two tables (aid, name). A null old name is unknown.

    With ``ignore_unknown``, new names none of whose records had a known one before are left out.
    """
    rows = old.select("aid", F.col("name").alias("old_name")).join(new.select("aid", F.col("name").alias("new_name")), "aid")
    if ignore_unknown:
        known = rows.where("old_name IS NOT NULL").select("new_name").distinct()
        rows = rows.join(known, "new_name", "left_semi").select("aid", "old_name", "new_name")
    return rows.where(~F.col("old_name").eqNullSafe(F.col("new_name")))


def delta_sizes(groups: DataFrame) -> DataFrame:
    """(kind, side, n_groups, n_items, min_size, max_size, mean_size) of the rows of grouping_delta.

    ``side`` is old or new; a group counts with those of its items that have the kind.
    """
    sides = [groups.where(F.col(c).isNotNull()).select("kind", F.lit(side).alias("side"), F.col(c).alias("id")) for side, c in (("old", "old_id"), ("new", "new_id"))]
    sizes = sides[0].union(sides[1]).groupBy("kind", "side", "id").agg(F.count("*").alias("n"))
    return sizes.groupBy("kind", "side").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_items"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"))


KINDS = {"unchanged": "old_id", "split": "old_id", "merge": "new_id", "hybrid": "old_id"}


def delta_counts(edges: DataFrame, names: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of counts of the rows of edge_delta, name_delta and grouping_delta.

    Of edges: n_added, n_modified, and of the latter those whose evidence decision and tags, tags
    only, or decision only changed. Of names: n_names_changed. Of groups by kind: old ones that
    are unchanged, split or hybrid, and new ones that are merged.
    """
    tags, decision = (~F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}")) for c in ("tags", "evidence_decision"))
    old = ~F.col("is_new")
    cases = {"added": F.col("is_new"), "modified": old, "changed_decision_and_tags": old & tags & decision, "changed_tags": old & tags & ~decision, "changed_decision": old & ~tags & decision}
    of_edges = edges.agg(*[F.count_if(c).alias(f"n_{n}") for n, c in cases.items()])
    of_groups = groups.agg(*[F.count_distinct(F.when(F.col("kind") == k, F.col(c))).alias(f"n_{k}") for k, c in KINDS.items()])
    return of_edges.join(F.broadcast(names.agg(F.count("*").alias("n_names_changed")))).join(F.broadcast(of_groups))
