"""Rules of the review log: defaults, what an unreview undoes, and what is put back to its start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.codes import UNREV, rectified
from pairwright.operators import graph

KEY = ["aid1", "aid2"]
#: Values of review fields that are not given.
DEFAULTS = {"evidence_decision": UNREV, "meta_decision": "null", "confidence": "unspecified"}


def with_defaults(reviews: DataFrame) -> DataFrame:
    """``reviews`` with defaults for nulls and for columns that they lack; a review without a time is of now."""
    out = reviews.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in reviews.columns else F.lit(v) for c, v in DEFAULTS.items()})
    return out.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp())) if "timestamp" in out.columns else out


def effective(reviews: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """The reviews that still count: an unreview deletes those of its edge before it, and stands itself.

    ``committed``: (aid1, aid2) of edges whose reviews are in the permanent table; to unreview
    one of those is an error. One partial aggregation over the log finds the last unreview of
    each edge, and only edges with one are looked up.
    """
    decision = rectified(F.col("evidence_decision"), F.col("meta_decision"))
    undone = reviews.where(decision == UNREV).groupBy(*KEY).agg(F.max("review_id").alias("_undone"))
    if committed is not None:
        fixed = committed.select(*KEY).distinct().withColumn("_fixed", F.lit(True))
        fail = F.raise_error(F.concat_ws(" ", F.lit("committed reviews cannot be undone:"), *KEY)).cast("long")
        undone = undone.join(fixed, KEY, "left").select(*KEY, F.when(F.col("_fixed"), fail).otherwise(F.col("_undone")).alias("_undone"))
    rows = reviews.join(undone, KEY, "left").where("_undone IS NULL OR review_id >= _undone")
    return rows.drop("_undone")


def current(reviews: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """The last review of each edge, how many it had in all (num_reviews), and how many still count (n_effective)."""
    last = graph.latest_reviews(with_defaults(reviews))
    counts = effective(with_defaults(reviews), committed).groupBy(*KEY).agg(F.count("*").alias("n_effective"))
    return last.join(counts, KEY)


def node_reviews(aids: DataFrame, review_id: int, **attributes) -> DataFrame:
    """A review of a node is a row of its own table: (aid, review_id, attributes...)."""
    return aids.select("aid", F.lit(review_id).cast("long").alias("review_id"), *[F.lit(v).alias(k) for k, v in attributes.items()])


def split_by_commit(reviews: DataFrame, committed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(internal, external): reviews that are not, and that are, in the permanent table, by review_id."""
    ids = committed.select("review_id").distinct()
    return reviews.join(ids, "review_id", "left_anti"), reviews.join(ids, "review_id", "left_semi")


def reset_feedback(reviews: DataFrame, committed: DataFrame) -> DataFrame:
    """The log as the permanent table has it: reviews that are not in it go."""
    return split_by_commit(reviews, committed)[1]


def cleared_edges(edges: DataFrame) -> DataFrame:
    """All edges, unreviewed and without other attributes."""
    kinds = dict(edges.dtypes)
    return edges.select(*KEY, *[F.lit(UNREV if c == "decision" else None).cast(kinds[c]).alias(c) for c in edges.columns if c not in KEY])


def reset_names(annots: DataFrame) -> DataFrame:
    """Every record with the name that it came with."""
    return annots.withColumn("name_label", F.col("orig_name_label"))


def cleared_names(annots: DataFrame) -> DataFrame:
    """Every record with a name of its own."""
    return annots.withColumn("name_label", -F.col("aid"))


def reset(annots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names as they came, and no edges."""
    return reset_names(annots), edges.where("false")


def staging_ahead(staging: DataFrame, matches: DataFrame) -> DataFrame:
    """(aid1, aid2): edges whose last staged review the table of matches does not have or has otherwise."""
    last = graph.latest_reviews(graph.canonical(with_defaults(staging))).select(*KEY, F.col("evidence_decision").alias("_s"))
    have = graph.canonical(matches).select(*KEY, F.col("evidence_decision").alias("_m"), F.lit(True).alias("_there"))
    return last.join(have, KEY, "left").where(F.col("_there").isNull() | ~F.col("_s").eqNullSafe(F.col("_m"))).select(*KEY)
