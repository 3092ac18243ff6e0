"""Which reviews of an inconsistent component are the likeliest to be wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.codes import NEGTV, POSTV, cut_weight
from pairwright.operators import graph, kernels
from pairwright.operators.groups import by_group


def hypotheses(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """(nid, aid1, aid2, hypothesis) of all suspected edges.

    For each negative edge (s, t) inside a component, the positive edges have a minimum cut
    between s and t. If the negative edge weighs less it is suspected to be POSTV, otherwise
    the edges of the cut with the least side of t are suspected to be NEGTV.
    """
    bad = graph.inconsistent(edges, pcc)
    inner = graph.edges_inside(edges.where(F.col("decision").isin(POSTV, NEGTV)), pcc).withColumn("nid", F.col("nid1")).join(bad, "nid", "left_semi")
    weighted = inner.select("nid", "aid1", "aid2", "decision", cut_weight(F.col("num_reviews"), F.col("prob_match"), F.col("confidence")).alias("w"))

    def suspect(nid, rows):
        rows.sort(key=lambda r: r[:2])
        network = kernels.CutNetwork([(a, b, w) for a, b, d, w in rows if d == POSTV])
        found = {}
        for s, t, d, w in rows:
            if d == NEGTV:
                cut = network.lighter_cut(s, t, w)
                found.update({(s, t): POSTV} if cut is None else dict.fromkeys(cut, NEGTV))
        return [(nid, a, b, h) for (a, b), h in sorted(found.items())]

    return by_group(weighted, "nid", suspect, "nid long, aid1 long, aid2 long, hypothesis string")


def recovering(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """Edges with ``recovering``: an end's component, or one that it has negative edges to, is inconsistent."""
    bad = graph.inconsistent(edges, pcc)
    beside = graph.neg_nid_freq(edges, pcc).join(bad.toDF("other"), "other", "left_semi").select("nid")
    marked = bad.union(beside).distinct()
    rows = graph.with_labels(edges, pcc)
    one, two = marked.select(F.col("nid").alias("nid1"), F.lit(True).alias("m1")), marked.select(F.col("nid").alias("nid2"), F.lit(True).alias("m2"))
    return rows.join(one, "nid1", "left").join(two, "nid2", "left").select(*edges.columns, F.coalesce("m1", "m2", F.lit(False)).alias("recovering"))
