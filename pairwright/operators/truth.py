"""What pairs of records are in truth, from names and other tables of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.codes import INCMP, NEGTV, POSTV
from pairwright.functions.tags import tag_filter


def is_same(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs`` with ``same``: whether their ends have one name; null where an end has none. ``names``: (aid, name)."""
    one, two = names.select(F.col("aid").alias("aid1"), F.col("name").alias("_n1")), names.select(F.col("aid").alias("aid2"), F.col("name").alias("_n2"))
    return pairs.join(one, "aid1", "left").join(two, "aid2", "left").withColumn("same", F.col("_n1") == F.col("_n2")).drop("_n1", "_n2")


def is_comparable(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` with ``comparable``: not reviewed as incomparable."""
    shut = edges.where(F.col("decision") == INCMP).select("aid1", "aid2", F.lit(False).alias("comparable"))
    return pairs.join(shut, ["aid1", "aid2"], "left").withColumn("comparable", F.coalesce("comparable", F.lit(True)))


def is_photobomb(edges: DataFrame, column: str = "tags") -> DataFrame:
    """``edges`` with ``photobomb``: whether their tags say so."""
    return edges.withColumn("photobomb", tag_filter(F.col(column), has_any="photobomb"))


def match_state(pairs: DataFrame, names: DataFrame, comparable: str | None = None) -> DataFrame:
    """``pairs`` with ``truth`` (INCMP where ``comparable`` is false, else by name) and one 0 or 1 for each state."""
    rows = is_same(pairs, names)
    seen = F.coalesce(F.col(comparable), F.lit(True)) if comparable else F.lit(True)
    rows = rows.withColumn("truth", F.when(~seen, INCMP).when(F.col("same"), POSTV).when(~F.col("same"), NEGTV))
    return rows.withColumns({c: (F.col("truth") == c).cast("int") for c in (POSTV, NEGTV, INCMP)})


def with_truth(edges: DataFrame, names: DataFrame, comparable: str | None = None) -> DataFrame:
    """``edges`` with the attribute ``truth``."""
    return match_state(edges, names, comparable).select(*edges.columns, "truth")


def photobomb_samples(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(aid1, aid2, photobomb): edges of different names, to learn what a photobomb is."""
    return is_photobomb(is_same(edges, names).where("NOT same")).select("aid1", "aid2", "photobomb")
