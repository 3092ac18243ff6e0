"""What reviews did to the components of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.codes import INCMP, NEGTV, POSTV
from pairwright.operators import graph


def review_actions(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """(aid1, aid2, decision, action) of reviewed pairs, by components before and after.

    Between components: merge, neg-evidence, incomp-evidence or other-evidence; within one:
    split, pos-evidence, neg-evidence, incomp-evidence or other-evidence.
    """
    was = graph.with_labels(changed, before).select("aid1", "aid2", "decision", (F.col("na") == F.col("nb")).alias("within"))
    now = graph.with_labels(changed, after).select("aid1", "aid2", (F.col("na") == F.col("nb")).alias("together"))
    evidence = F.when(F.col("decision") == NEGTV, "neg-evidence").when(F.col("decision") == INCMP, "incomp-evidence").otherwise("other-evidence")
    action = F.when(~F.col("within") & F.col("together"), "merge").when(F.col("within") & ~F.col("together"), "split").when(F.col("within") & (F.col("decision") == POSTV), "pos-evidence").otherwise(evidence)
    return was.join(now, ["aid1", "aid2"]).select("aid1", "aid2", "decision", F.when(F.col("within"), "within").otherwise("between").alias("side"), action.alias("action"))
