"""Priorities of candidate pairs, the queue, automatic and simulated reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.codes import INCMP, NEGTV, POSTV, UNREV

NO_SCORE = 1e-9
ERROR_BOOST = 10.0


def scores(probs: DataFrame, pcc: DataFrame, thresholds: dict[str, float] | None = None, prioritize_nonpos: bool = True) -> DataFrame:
    """Pairs with ``priority``: P(POSTV), or 1 - P(POSTV) inside a component, and 1 more for each class over its threshold."""
    from pairwright.operators.graph import with_labels

    rows = with_labels(probs, pcc)
    base: Column = F.when(F.col("nid1") == F.col("nid2"), 1 - F.col(POSTV)).otherwise(F.col(POSTV))
    for c in (POSTV, NEGTV, INCMP) if prioritize_nonpos else ():
        t = (thresholds or {}).get(c)
        if t is not None:
            base = F.when(F.col(c) > t, F.greatest(base, F.col(c)) + 1).otherwise(base)
    return rows.select(*probs.columns, base.alias("priority"))


def queue(edges: DataFrame, redundant: DataFrame, errors: DataFrame, metric: str = "prob_match") -> DataFrame:
    """(aid1, aid2, priority): unreviewed edges that are not redundant, and suspected errors, which come first."""
    key = ["aid1", "aid2"]
    base = F.coalesce(F.nanvl(F.col(metric).cast("double"), F.lit(None)), F.lit(NO_SCORE))
    open_ = edges.where(F.col("decision") == UNREV).join(redundant.select(*key), key, "left_anti").select(*key, base.alias("priority"))
    wrong = edges.join(errors.select(*key).distinct(), key, "left_semi").select(*key, (base + ERROR_BOOST).alias("priority"))
    return open_.unionByName(wrong).groupBy(*key).agg(F.max("priority").alias("priority"))


def top(queue_: DataFrame, n: int) -> DataFrame:
    """The n first pairs, by falling priority and then by their ends."""
    return queue_.orderBy(F.desc("priority"), "aid1", "aid2").limit(n)


def popped(queue_: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n first pairs, and the queue without them."""
    first = top(queue_, n)
    return first, queue_.join(first.select("aid1", "aid2"), ["aid1", "aid2"], "left_anti")


def upserted(queue_: DataFrame, items: DataFrame) -> DataFrame:
    """The queue with the priorities of ``items`` in place of its own."""
    items = items.select("aid1", "aid2", "priority")
    return queue_.join(items.select("aid1", "aid2"), ["aid1", "aid2"], "left_anti").unionByName(items)


def auto_review(probs: DataFrame, thresholds: dict[str, float], photobomb: str | None = None, photobomb_most: float = 1.0) -> DataFrame:
    """Pairs with ``auto_decision``: the likeliest class where just one is over its threshold, else null."""
    over = sum((F.when(F.col(c) > F.lit(float(thresholds.get(c, float("inf")))), 1).otherwise(0) for c in (POSTV, NEGTV, INCMP)), F.lit(0))
    best = F.greatest(POSTV, NEGTV, INCMP)
    pick = F.when(F.col(POSTV) == best, POSTV).when(F.col(NEGTV) == best, NEGTV).otherwise(INCMP)
    clear = over == 1
    if photobomb:
        clear = clear & (F.coalesce(F.col(photobomb), F.lit(0.0)) <= photobomb_most)
    return probs.select("*", F.when(clear, pick).alias("auto_decision"))


def unit_hash(salt: int = 0) -> Column:
    """A number from 0 to 1 that depends on the ends of a pair only, by integer arithmetic."""
    return ((F.col("aid1") * 7919 + F.col("aid2") * 104729 + salt) % 10007) / 10007


def oracle_review(pairs: DataFrame, accuracy: float, truth: str = "truth") -> DataFrame:
    """Pairs with ``answer`` and ``confidence`` of a simulated reviewer of that accuracy."""
    wrong = F.when(F.col(truth) == POSTV, NEGTV).when(F.col(truth) == NEGTV, POSTV).otherwise(F.when(unit_hash(1) < 0.5, POSTV).otherwise(NEGTV))
    sure = "absolutely_sure" if accuracy >= 1 else "pretty_sure" if accuracy > 0.95 else "not_sure" if accuracy > 0.75 else "guessing"
    return pairs.select("*", F.when(unit_hash() > accuracy, wrong).otherwise(F.col(truth)).alias("answer"), F.lit(sure).alias("confidence"))


def filtered(queue_: DataFrame, edges: DataFrame, pcc: DataFrame, conf_thresh: str | None = None, mode: str | None = None, preds: DataFrame | None = None) -> DataFrame:
    """The queue without pairs that reviewers need not see.

    With ``conf_thresh`` (a code of confidence), pairs inside a component whose ends positive edges of that confidence or
    more connect, and pairs of two components with such a negative edge of their own. ``mode``: ``split`` keeps pairs inside
    components, ``merge`` pairs between them, ``predict`` pairs whose prediction in ``preds`` (aid1, aid2, pred) is not
    what the components say, and inside a component only where edges that are pretty sure do not connect
    them. Pairs of a priority of `ERROR_BOOST` or more are suspected errors, which neither confidence nor predictions drop.
    A pair with an end in no component is dropped.
    """
    from pairwright.functions.codes import CONFIDENCE
    from pairwright.operators.components import AT_ONCE, connected_components
    from pairwright.operators.graph import confident, with_labels

    if mode not in (None, "split", "merge", "predict") or (mode == "predict") != (preds is not None):
        raise ValueError("mode is split, merge, or predict with predictions")

    def connected(code: str) -> DataFrame:
        parts = connected_components(confident(edges, POSTV, CONFIDENCE[code][0] or 0), nodes=pcc.select("aid"), at_once=AT_ONCE)
        return with_labels(queue_.select(*key), parts).where("nid1 = nid2").select(*key)

    key = ["aid1", "aid2"]
    rows = with_labels(queue_, pcc).withColumns({"_in": F.col("nid1") == F.col("nid2"), "_calm": F.col("priority") < ERROR_BOOST}).select(*queue_.columns, "_in", "_calm")

    def without(rows: DataFrame, pairs: DataFrame, inside: bool) -> DataFrame:
        marked = rows.join(pairs.distinct().withColumn("_drop", F.lit(True)), key, "left")
        return marked.where(F.col("_drop").isNull() | ~F.col("_calm") | (F.col("_in") != F.lit(inside))).drop("_drop")

    if conf_thresh is not None:
        rows = without(rows, connected(conf_thresh), True)
        rows = without(rows, confident(edges, NEGTV, CONFIDENCE[conf_thresh][0] or 0).select(*key), False)
    if mode in ("split", "merge"):
        rows = rows.where("_in" if mode == "split" else "NOT _in")
    if preds is not None:
        rows = without(rows, connected("pretty_sure"), True)
        rows = without(rows, preds.where(F.col("pred") == POSTV).select(*key), True)
        rows = without(rows, preds.where(F.col("pred") == NEGTV).select(*key), False)
    return rows.drop("_in", "_calm")


def hardness(probs: DataFrame, edges: DataFrame) -> DataFrame:
    """(aid1, aid2, priority): edges that are decided, by 1 less the probability of their decision."""
    rows = edges.where(F.col("decision").isin(POSTV, NEGTV, INCMP)).select("aid1", "aid2", "decision").join(probs.select("aid1", "aid2", POSTV, NEGTV, INCMP), ["aid1", "aid2"])
    said = F.when(F.col("decision") == POSTV, F.col(POSTV)).when(F.col("decision") == NEGTV, F.col(NEGTV)).otherwise(F.col(INCMP))
    return rows.select("aid1", "aid2", (1 - said).alias("priority"))


def slices(ranking: DataFrame, top_n: int, middle: int, bottom: int) -> DataFrame:
    """Of each query's ranking the first, middle and last rows, with ``part``."""
    own = Window.partitionBy("qaid")
    rows = ranking.withColumn("r", F.row_number().over(own.orderBy(F.desc("score"), "daid"))).withColumn("n", F.count("*").over(own))
    start = F.floor((F.col("n") - middle) / 2)
    part = F.when(F.col("r") <= top_n, "top").when(F.col("r") > F.col("n") - bottom, "bottom").when((F.col("r") > start) & (F.col("r") <= start + middle), "middle")
    return rows.withColumn("part", part).where("part IS NOT NULL").drop("n", "r")


def normalised(ranking: DataFrame) -> DataFrame:
    """Rankings with ``normscore``: the score over the greatest of all, which is one row."""
    best = ranking.agg(F.max("score").alias("best"))
    return ranking.join(F.broadcast(best)).select(*ranking.columns, (F.col("score") / F.col("best")).alias("normscore"))


def edge_scores(ranking: DataFrame) -> DataFrame:
    """(aid1, aid2, score, rank): the better of the two directions of each pair; of equals the lower rank."""
    rows = ranking.select(F.least("qaid", "daid").alias("aid1"), F.greatest("qaid", "daid").alias("aid2"), F.struct("score", (-F.col("rank")).alias("r")).alias("s"))
    return rows.groupBy("aid1", "aid2").agg(F.max("s").alias("s")).select("aid1", "aid2", "s.score", (-F.col("s.r")).alias("rank"))


def skipped(queue_: DataFrame, pairs: DataFrame) -> DataFrame:
    """The queue without ``pairs``."""
    return queue_.join(pairs.select("aid1", "aid2"), ["aid1", "aid2"], "left_anti")


def reinstated(queue_: DataFrame, edges: DataFrame, metric: str = "prob_match") -> DataFrame:
    """The queue and those of ``edges`` that it lacks, by their metric; one without gets the least priority."""
    base = F.coalesce(F.nanvl(F.col(metric).cast("double"), F.lit(None)), F.lit(NO_SCORE))
    return queue_.unionByName(skipped(edges.select("aid1", "aid2", base.alias("priority")), queue_))


def without_internal(queue_: DataFrame, pcc: DataFrame, nids: DataFrame) -> DataFrame:
    """The queue without pairs inside the components ``nids`` (nid)."""
    from pairwright.operators.graph import edges_inside

    return skipped(queue_, edges_inside(queue_, pcc).join(nids.select(F.col("nid").alias("nid1")), "nid1", "left_semi"))


def with_internal(queue_: DataFrame, edges: DataFrame, pcc: DataFrame, nids: DataFrame, metric: str = "prob_match") -> DataFrame:
    """The queue and the unreviewed edges inside the components ``nids`` (nid)."""
    from pairwright.operators.graph import edges_inside

    inside = edges_inside(edges.where(F.col("decision") == UNREV), pcc).join(nids.select(F.col("nid").alias("nid1")), "nid1", "left_semi")
    return reinstated(queue_, inside, metric)


def requests(queue_: DataFrame, edges: DataFrame, pcc: DataFrame, n: int) -> DataFrame:
    """What a reviewer is asked: the n first pairs with their edge's decision, confidence and number of reviews,
    their components, and the length of the queue and the number of components, which are one row each."""
    from pairwright.operators.graph import with_labels

    totals = queue_.agg(F.count("*").alias("queue_len")).join(pcc.agg(F.count_distinct("nid").alias("n_ccs")))
    data = edges.select("aid1", "aid2", "decision", "confidence", "num_reviews")
    rows = with_labels(top(queue_, n), pcc).join(data, ["aid1", "aid2"], "left").join(F.broadcast(totals))
    return rows.select("aid1", "aid2", "priority", "nid1", "nid2", "decision", "confidence", "num_reviews", "queue_len", "n_ccs")


def unreviewed_candidates(ranking: DataFrame, edges: DataFrame) -> DataFrame:
    """(aid1, aid2, score, rank): ranked pairs, the better direction of each, that have no review."""
    return skipped(edge_scores(ranking), edges.where(F.col("decision") != UNREV))
