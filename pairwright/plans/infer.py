"""Batch inference as one plan, and its incremental form over a stream of reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.config import Config
from pairwright.functions.codes import POSTV
from pairwright.operators import feedback, graph, recovery, redundancy
from pairwright.operators.components import connected_components


@dataclass
class Inference:
    """Everything that follows from the current decisions; each part is computed when it is read."""

    annots: DataFrame
    edges: DataFrame
    pcc: DataFrame
    config: Config

    @property
    def states(self) -> DataFrame:
        return graph.inferred_state(self.edges, self.pcc)

    @property
    def summary(self) -> DataFrame:
        return graph.pcc_summary(self.edges, self.pcc)

    @property
    def neg_metagraph(self) -> DataFrame:
        return graph.neg_metagraph(self.edges, self.pcc)

    @property
    def pos_redundant(self) -> DataFrame:
        return redundancy.positive_redundancy(self.edges, self.pcc, self.config.redun_pos)

    @property
    def neg_redundant(self) -> DataFrame:
        return redundancy.negative_redundancy(self.edges, self.pcc, self.config.redun_neg)

    @property
    def errors(self) -> DataFrame:
        return recovery.hypotheses(self.edges, self.pcc)

    def status(self, extended: bool = False) -> DataFrame:
        return graph.status(self.edges, self.pcc, extended)


def infer(annots: DataFrame, edges: DataFrame, config: Config | None = None) -> Inference:
    """``annots``: (aid); ``edges``: aid1 < aid2 with decision, num_reviews, prob_match and confidence.

    Ends of edges that are no records are added to them, or are an error if the settings do not allow unseen nodes.
    """
    config = config or Config()
    annots = graph.with_ends(annots, edges, config.allow_unseen_nodes)
    return Inference(annots, edges, connected_components(edges.where(F.col("decision") == POSTV), nodes=annots), config)


def infer_reviews(annots: DataFrame, reviews: DataFrame, config: Config | None = None, committed: DataFrame | None = None) -> Inference:
    """From a review log: the last review of an edge counts.

    With ``committed`` (aid1, aid2), the edges with reviews in the permanent table, an unreview deletes those of its
    edge before it, and one of a committed edge is an error.
    """
    reviews = graph.canonical(reviews)
    if committed is not None:
        reviews = feedback.effective(reviews, committed)
    return infer(annots, with_measures(graph.latest_reviews(reviews)), config)


def with_measures(edges: DataFrame) -> DataFrame:
    """Edges with null for measures that they lack."""
    kinds = {"num_reviews": "bigint", "prob_match": "double", "confidence": "string"}
    return edges.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in edges.columns})


def relabelled(pcc: DataFrame, old_edges: DataFrame, edges: DataFrame, changed: DataFrame, annots: DataFrame) -> DataFrame:
    """Components after some edges have changed, computed again only where they touch.

    ``changed``: (aid1, aid2). Members of the components of their ends form one part of the
    graph, which no positive edge leaves; all other labels stay.
    """
    labels = pcc.union(annots.select("aid").join(pcc, "aid", "left_anti").select("aid", F.col("aid").alias("nid")))
    ends = changed.select(F.explode(F.array("aid1", "aid2")).alias("aid")).distinct()
    touched = labels.join(ends, "aid", "left_semi").select("nid").distinct()
    members = labels.join(touched, "nid", "left_semi").select("aid")
    inner = edges.where(F.col("decision") == POSTV).join(members.toDF("aid1"), "aid1", "left_semi")
    again = connected_components(inner, nodes=members)
    return labels.join(touched, "nid", "left_anti").select("aid", "nid").unionByName(again)
