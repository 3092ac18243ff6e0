"""The review loop: phases that propose pairs, reviewers that answer them, and inference after each batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.config import Config
from pairwright.functions.codes import INCMP, NEGTV, POSTV, UNREV
from pairwright.operators import graph, priority, redundancy, refresh, search
from pairwright.operators.actions import review_actions
from pairwright.operators.simulate import ranked
from pairwright.plans.infer import Inference, infer, with_measures
from pairwright.session import staged

Reviewer = Callable[[DataFrame], DataFrame]
KEY = ["aid1", "aid2"]


@dataclass
class ReviewLoop:
    """Reviews in batches. ``verifier`` turns pairs into probabilities, ``oracle`` pairs into (aid1, aid2, decision, confidence).

    A pair that the thresholds decide is reviewed automatically; the others go to the oracle,
    up to ``batch`` of the first in the queue at a time. ``ranker``, if given, turns (qaid) into (qaid, daid, score); its first
    ``ranking_ntop`` for each record become candidates before the ranking phase. Each batch's reviews replace those
    of the pairs before; inference follows, and every phase goes on until it proposes nothing, or
    the stop criterion ends the ranking phase. A batch (``batch`` rows at most) is numbered in one
    task.
    """

    annots: DataFrame
    edges: DataFrame
    verifier: Reviewer
    oracle: Reviewer
    config: Config = field(default_factory=Config)
    batch: int = 500
    history: list[dict] = field(default_factory=list)
    log: DataFrame | None = None
    ranker: Callable[[DataFrame], DataFrame] | None = None
    seen: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.inference: Inference = infer(self.annots, staged(with_measures(self.edges), "loop-edges"), self.config)

    def step(self, phase: str, proposed: DataFrame, only_auto: bool = False, once: bool = False) -> int:
        """Review the first pairs proposed (aid1, aid2, priority); how many there were.

        With ``only_auto`` the oracle is asked only about pairs with an end in an inconsistent component. With ``once`` the
        phase proposes no pair again.
        """
        if once and phase in self.seen:
            proposed = proposed.join(self.seen[phase], KEY, "left_anti")
        first = staged(priority.top(proposed, self.batch), "proposed")
        n = first.count()
        if not n:
            return 0
        probs = staged(priority.auto_review(self.verifier(first), self.config.thresholds), "verified")
        auto = probs.where("auto_decision IS NOT NULL") if self.config.autoreview_enabled and self.inference.summary.where("NOT is_consistent").isEmpty() else probs.limit(0)
        by_auto = auto.select(*KEY, F.col("auto_decision").alias("decision"), F.lit("pretty_sure").alias("confidence"))
        asked = first.join(auto, KEY, "left_anti")
        if only_auto:
            bad = graph.inconsistent(self.inference.edges, self.inference.pcc).join(self.inference.pcc, "nid").select("aid")
            ends = asked.select(*KEY, F.explode(F.array("aid1", "aid2")).alias("aid")).join(bad, "aid", "left_semi")
            asked = asked.join(ends, KEY, "left_semi")
        if once:
            old = self.seen.get(phase)
            self.seen[phase] = staged(first.select(*KEY) if old is None else old.unionByName(first.select(*KEY)), "seen")
        by_oracle = self.oracle(asked).select(*KEY, "decision", "confidence")
        old = self.inference.pcc
        reviews = staged(by_auto.withColumn("user_id", F.lit("algo:auto")).unionByName(by_oracle.withColumn("user_id", F.lit("user:oracle"))), "reviews")
        self.accept(reviews.drop("user_id"), probs)
        if phase == "ranking":
            self._remember(reviews, old)
        self.history.append({"phase": phase, "reviews": n})
        return n

    def _remember(self, reviews: DataFrame, old: DataFrame) -> None:
        """Append reviews to the log, numbered by ranges, and whether each merged or split components."""
        changed = review_actions(old, self.inference.pcc, reviews).select(*KEY, F.col("action").isin("merge", "split").alias("meaningful"))
        start = len(self.history) * (self.batch + 1)
        numbered = reviews.join(changed, KEY).select("user_id", "meaningful", (F.row_number().over(Window.orderBy(*KEY)) + start).cast("long").alias("review_id"))
        self.log = staged(numbered if self.log is None else self.log.unionByName(numbered), "log")

    def accept(self, reviews: DataFrame, probs: DataFrame) -> None:
        """Put reviews in place of what the pairs had, and infer again."""
        reviews = reviews.join(probs.select(*KEY, F.col(POSTV).alias("prob_match")), KEY, "left")
        old = self.inference.edges.select(*KEY, "num_reviews").toDF(*KEY, "_n")
        reviews = reviews.join(old, KEY, "left").select(*KEY, "decision", "confidence", "prob_match", (F.coalesce("_n", F.lit(0)) + 1).alias("num_reviews"))
        rest = self.inference.edges.join(reviews, KEY, "left_anti")
        self.inference = infer(self.annots, staged(rest.unionByName(reviews, allowMissingColumns=True), "loop-edges"), self.config)

    def _exhaust(self, phase: str, propose: Callable[[], DataFrame], most: int | None = None, may_stop: bool = False, **how: bool) -> int:
        """Batches until nothing is proposed, the stop criterion is met (in the ranking phase), or ``most`` are done if that is given."""
        total, batches = 0, 0
        while most is None or batches < most:
            n = self.step(phase, propose(), **how)
            total, batches = total + n, batches + 1
            if not n or (may_stop and self.finished()):
                break
        return total

    def finished(self) -> bool:
        """Whether the manual reviews so far foretell that few more will change anything."""
        if self.log is None:
            return False
        c = self.config
        return bool(refresh.stop(self.log, c.refresh_window, c.refresh_patience, c.refresh_thresh, c.refresh_method).first()["done"])

    def ranking(self) -> DataFrame:
        """Unreviewed edges that no redundancy makes needless."""
        i = self.inference
        flags = redundancy.flagged(i.edges, i.pcc, i.pos_redundant, i.neg_redundant)
        needless = flags.where("redundant").select(*KEY)
        return self._worth(priority.queue(i.edges, needless, i.edges.limit(0)))

    def _worth(self, queue: DataFrame) -> DataFrame:
        """The queue without what ``queue_conf_thresh`` drops."""
        thresh = self.config.queue_conf_thresh
        return queue if thresh is None else priority.filtered(queue, self.inference.edges, self.inference.pcc, thresh)

    def refresh_candidates(self) -> int:
        """Add the ranker's pairs that have no edge, as unreviewed ones with the verifier's probability; how many."""
        if self.ranker is None:
            return 0
        edges = self.inference.edges
        found = staged(ranked(self.annots.select(F.col("aid").alias("qaid")), self.ranker, self.config.ranking_ntop).join(edges, KEY, "left_anti"), "candidates")
        scored = self.verifier(found).select(*KEY, F.lit(UNREV).alias("decision"), F.col(POSTV).alias("prob_match"), F.lit(0).cast("long").alias("num_reviews"))
        self.inference = infer(self.annots, staged(edges.unionByName(scored, allowMissingColumns=True), "loop-edges"), self.config)
        return found.count()

    def hard_cases(self) -> DataFrame:
        """Decided edges, those first that the verifier thinks least likely, but none of a confidence that the settings think enough."""
        i = self.inference
        decided = i.edges.where(F.col("decision").isin(POSTV, NEGTV, INCMP))
        return self._worth(priority.hardness(self.verifier(decided.select(*KEY)), decided))

    def recovery(self) -> DataFrame:
        """Suspected errors, the likeliest pairs first."""
        e = self.inference.errors.select(*KEY).distinct()
        return e.join(self.inference.edges, KEY).select(*KEY, F.coalesce("prob_match", F.lit(priority.NO_SCORE)).alias("priority"))

    def positive(self) -> DataFrame:
        i = self.inference
        known = i.edges.where(F.col("decision") != UNREV).select(*KEY)
        return redundancy.positive_augmentation(i.edges, i.pcc, self.config.redun_pos).join(known, KEY, "left_anti").select(*KEY, F.lit(1.0).alias("priority"))

    def negative(self) -> DataFrame:
        i = self.inference
        pairs = redundancy.non_redundant_pairs(i.edges, i.pcc, self.config.redun_neg).select("nid1", "nid2")
        known = i.edges.where(F.col("decision") != UNREV).select(*KEY)
        return redundancy.negative_augmentation(i.edges, i.pcc, pairs, self.config.redun_neg).join(known, KEY, "left_anti").select(*KEY, F.lit(1.0).alias("priority"))

    def run(self, most: int | None = None) -> list[dict]:
        """All phases, each until it proposes nothing.

        First, as the settings ask: some random pairs (``algo_quickstart``), hard cases (``algo_hardcase``, which needs
        ranking, redundancy and automatic reviews off and inference on), recovery, positive redundancy. Then rounds of
        ranking, recovery and positive redundancy while a round reviews something; then negative redundancy, and recovery and
        positive redundancy of what that changed. ``algo_max_outer_loops`` bounds the rounds and ``most``, if given, the
        batches of a phase.
        """
        c = self.config
        positive = c.redun_enabled and c.redun_enforce_pos

        def mend() -> int:
            done = self._exhaust("recovery", self.recovery, most) if c.inference_enabled else 0
            return done + (self._exhaust("positive", self.positive, most) if positive else 0)

        if c.algo_quickstart:
            pairs = search.sampled_pairs(self.annots, "aid", c.manual_n_peek).select(F.col("a").alias("aid1"), F.col("c").alias("aid2"), F.lit(1.0).alias("priority"))
            self.step("quickstart", pairs)
        if c.algo_hardcase:
            if c.ranking_enabled or c.redun_enabled or c.autoreview_enabled or not c.inference_enabled:
                raise ValueError("hard cases are reviewed with inference on, and ranking, redundancy and automatic reviews off")
            self._exhaust("hardcase", self.hard_cases, most, once=True)
        mend()
        rounds = 0
        while c.ranking_enabled and (c.algo_max_outer_loops is None or rounds < c.algo_max_outer_loops):
            rounds += 1
            self.refresh_candidates()
            done = self._exhaust("ranking", self.ranking, most, may_stop=True)
            if not done + mend() or most is not None:
                break
        if c.redun_enabled and c.redun_enforce_neg and self._exhaust("negative", self.negative, most, only_auto=c.redun_neg_only_auto, once=c.redun_neg_only_auto):
            mend()
        return self.history

    def status(self, extended: bool = False) -> DataFrame:
        return graph.status(self.inference.edges, self.inference.pcc, extended)
