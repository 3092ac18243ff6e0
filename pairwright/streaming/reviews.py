"""The review log as a stream: the last review of each edge, and all that follows from it kept up to date."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairwright.functions.codes import INCMP, NEGTV, POSTV, UNREV, rectified
from pairwright.operators import graph, kernels, redundancy
from pairwright.operators.components import AT_ONCE, connected_components, spanning_forest
from pairwright.operators.groups import by_group
from pairwright.session import growing, shared_dir
from pairwright.session import staged as kept
from pairwright.sources.committed import CommittedTables


def staged(df: DataFrame, name: str) -> DataFrame:
    """Tables of a batch grow with it, so none of them is broadcast."""
    return growing(kept(df, name))


#: A batch of no fewer reviewed edges than this, and no fewer than one to so many that are stored, is folded in by making all tables anew.
RENEW_LEAST = 1000
RENEW_SHARE = 16

LATEST = "aid1 long, aid2 long, review_id long, evidence_decision string, meta_decision string, num_reviews long"


def latest_stream(reviews: DataFrame) -> DataFrame:
    """A stream of the new state of each edge that a micro-batch has reviews of (update mode)."""

    def update(key, batches, state: GroupState):
        best = state.get if state.exists else (-1, None, None, 0)
        n = best[3]
        for pdf in batches:
            n += len(pdf)
            last = pdf.loc[pdf["review_id"].idxmax()]
            if last["review_id"] > best[0]:
                best = (int(last["review_id"]), last["evidence_decision"], last["meta_decision"], n)
        best = (*best[:3], n)
        state.update(best)
        yield pd.DataFrame([(*key, *best)], columns=["aid1", "aid2", "review_id", "evidence_decision", "meta_decision", "num_reviews"])

    rows = graph.canonical(reviews).select("aid1", "aid2", "review_id", "evidence_decision", "meta_decision")
    return rows.groupBy("aid1", "aid2").applyInPandasWithState(update, LATEST, "review_id long, evidence_decision string, meta_decision string, num_reviews long", "update", GroupStateTimeout.NoTimeout)


class ReviewState:
    """Edges, components, meta edges and redundancy flags that micro-batches of reviews bring up to date.

    All are tables in hash buckets (`CommittedTables`): records and edges by record (an edge from both ends, with
    ``tree``: whether it is in the spanning forest of the positive edges), members, counts of edges between
    components by decision, and flags by component. A batch reads and writes only the buckets of the records and
    components that it changes, and becomes visible as a whole: an epoch that is there already is not applied again,
    and a new object over the same ``folder`` goes on from the last one.

    A positive edge that goes and is not in the forest leaves the components as they are. For one in the forest, the
    component's forest falls into pieces, and replacements are looked for among the positive edges of all pieces
    but the largest. A batch that reviews a large share of the edges (``renew_least``, `RENEW_SHARE`) touches most components;
    then all tables are made anew from all edges, which is less work. Records that no annotation names are added as they are reviewed. To unreview an edge of
    ``committed`` (aid1 < aid2, those with reviews in the permanent table) is an error, and the batch changes nothing.
    """

    TABLES = {
        "nodes": ("aid long, nid long", "aid"),
        "members": ("nid long, aid long", "nid"),
        "edges": ("u long, v long, review_id long, evidence_decision string, meta_decision string, num_reviews long, decision string, tree boolean", "u"),
        "meta": ("nid long, other long, " + ", ".join(f"{d} long" for d in graph.DECISIONS) + ", redundant boolean", "nid"),
        "flags": ("nid long, size long, inconsistent boolean, pos_redundant boolean", "nid"),
    }

    def __init__(self, annots: DataFrame, folder: str | None = None, buckets: int = 64, k_pos: int = 2, k_neg: int = 2, committed: DataFrame | None = None, renew_least: int = RENEW_LEAST):
        self.spark, self.committed, self.renew_least = annots.sparkSession, committed, renew_least
        self.folder, self.k_pos, self.k_neg = folder or f"{shared_dir(self.spark)}/reviews-{uuid.uuid4().hex}", k_pos, k_neg
        self.tables = CommittedTables(self.spark, self.folder, self.TABLES, buckets)
        #: Of the last batch: components whose forest lost an edge, and records that got another label; None if all was made anew.
        self.searched = self.moved = 0
        if self.tables.version < 0:
            own = annots.select("aid", F.col("aid").alias("nid")).distinct()
            flags = own.select("nid", F.lit(1).alias("size"), F.lit(False).alias("inconsistent"), F.lit(True).alias("pos_redundant"))
            self.tables.commit({"nodes": (["aid"], own, None), "members": (["nid", "aid"], own, None), "flags": (["nid"], flags, None)}, {"epoch": -1})

    # What there is ---------------------------------------------------------------------

    @property
    def epoch(self) -> int:
        return self.tables.manifest["notes"]["epoch"]

    @property
    def edges(self) -> DataFrame:
        """aid1 < aid2 with the last review, num_reviews, decision and tree."""
        return self.tables.read("edges").where("u < v").withColumnsRenamed({"u": "aid1", "v": "aid2"})

    @property
    def pcc(self) -> DataFrame:
        return self.tables.read("nodes")

    @property
    def neg_metagraph(self) -> DataFrame:
        """(nid1, nid2, weight) as `graph.neg_metagraph` gives it."""
        return self.tables.read("meta").where(f"nid <= other AND {NEGTV} > 0").select(F.col("nid").alias("nid1"), F.col("other").alias("nid2"), F.col(NEGTV).alias("weight"))

    @property
    def inconsistent(self) -> DataFrame:
        return self.tables.read("flags").where("inconsistent").select("nid")

    @property
    def pos_redundant(self) -> DataFrame:
        """(nid) of consistent components that are redundant."""
        return self.tables.read("flags").where("pos_redundant").select("nid")

    @property
    def neg_redundant(self) -> DataFrame:
        """(nid1, nid2) as `redundancy.negative_redundancy` gives it."""
        return self.tables.read("meta").where("redundant AND nid < other").select(F.col("nid").alias("nid1"), F.col("other").alias("nid2"))

    # A batch ---------------------------------------------------------------------------

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Fold a batch of reviews into the state as one commit; an epoch counts once."""
        t = self.tables.refresh()
        if epoch <= self.epoch:
            return
        reviews, seen = graph.canonical(batch).groupBy("aid1", "aid2"), Observation()
        news = reviews.agg(F.max_by(F.struct("review_id", "evidence_decision", "meta_decision"), "review_id").alias("r"), F.count("*").alias("n"))
        news = staged(news.observe(seen, F.count(F.lit(1)).alias("n")), "news")
        if seen.get["n"] >= self.renew_least and 2 * RENEW_SHARE * seen.get["n"] >= t.read("edges").count():
            return self._renew(news, epoch)
        ends = news.select(F.explode(F.array("aid1", "aid2")).alias("aid")).distinct()
        known = staged(t.matching("nodes", ends), "known")
        fresh = staged(ends.join(known, "aid", "left_anti"), "fresh")
        folded = self._folded(news)
        self._check(folded)
        label = known.union(fresh.select("aid", F.col("aid").alias("nid")))
        cut = folded.where(f"was = '{POSTV}' AND decision <> '{POSTV}'").select("aid1", "aid2", "tree")
        apart, links = self._split(cut, label)
        grown = folded.where(f"decision = '{POSTV}' AND NOT was <=> '{POSTV}'").select("aid1", "aid2")
        moved, joins = self._merged(grown, label, apart, fresh)
        self.moved = moved.count()
        delta = self._delta(folded, moved)
        flags, gone, members = self._flags(folded, moved, delta)
        meta, lost = self._meta(delta, flags)
        tree = links.unionByName(joins)
        t.commit({
            "nodes": (["aid"], moved.select("aid", "nid"), None),
            "members": (["nid", "aid"], moved.select("nid", "aid"), moved.where("old IS NOT NULL").select(F.col("old").alias("nid"), "aid")),
            "edges": (["u", "v"], self._edge_rows(folded, tree), None),
            "meta": (["nid", "other"], meta, lost),
            "flags": (["nid"], flags, gone),
        }, {"epoch": epoch})

    def _folded(self, news: DataFrame) -> DataFrame:
        """Edges with new reviews as they are then; ``was`` is the decision before (null for a new edge), ``tree`` as before."""
        before = self.tables.matching("edges", news.select("aid1")).withColumnsRenamed({"u": "aid1", "v": "aid2", "decision": "was"})
        both = news.join(before, ["aid1", "aid2"], "left")
        return staged(self._newest(both, "was", F.coalesce("tree", F.lit(False)).alias("tree")), "folded")

    @staticmethod
    def _newest(both: DataFrame, *more) -> DataFrame:
        """Stored edges joined with news (r, n), either of which may be missing, as they are then."""
        newer = F.col("n").isNotNull() & F.coalesce(F.col("review_id") < F.col("r.review_id"), F.lit(True))
        pick = lambda c: F.when(newer, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
        number = (F.coalesce("num_reviews", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("num_reviews")
        rows = both.select("aid1", "aid2", pick("review_id"), pick("evidence_decision"), pick("meta_decision"), number, *more)
        return rows.withColumn("decision", rectified(F.col("evidence_decision"), F.col("meta_decision")))

    def _check(self, reviewed: DataFrame) -> None:
        if self.committed is not None:
            undone = reviewed.where(F.col("decision") == UNREV).join(self.committed.select("aid1", "aid2"), ["aid1", "aid2"], "left_semi").first()
            if undone:
                raise ValueError(f"committed reviews cannot be undone: {undone.aid1} {undone.aid2}")

    def _renew(self, news: DataFrame, epoch: int) -> None:
        """Fold in a batch by making all tables anew: components by contraction, forests and redundancy within by component, counts by aggregation."""
        t, columns = self.tables, [c.split()[0] for c in self.TABLES["edges"][0].split(", ")]
        stored = t.read("edges").where("u < v").withColumnsRenamed({"u": "aid1", "v": "aid2"}).drop("decision", "tree")
        both = self._newest(stored.join(growing(news), ["aid1", "aid2"], "full_outer"), F.col("n").isNotNull().alias("reviewed"))
        self._check(both.where("reviewed"))
        edges = staged(both.drop("reviewed"), "whole")
        records = t.read("nodes").select("aid").union(news.select(F.explode(F.array("aid1", "aid2"))))
        pcc = staged(connected_components(edges.where(F.col("decision") == POSTV), nodes=records, at_once=AT_ONCE), "pcc")
        labelled = staged(graph.with_labels(edges, pcc).drop("nid1", "nid2"), "labelled").withColumns({"nid1": F.least("na", "nb"), "nid2": F.greatest("na", "nb")})
        half = staged(labelled.groupBy("nid1", "nid2").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in graph.DECISIONS]), "meta")
        inner = half.where("nid1 = nid2").select(F.col("nid1").alias("nid"), F.col(POSTV).alias("n_pos"), F.col(NEGTV).alias("n_neg_inside"), F.col(INCMP).alias("n_incmp_inside"))
        summary = pcc.groupBy("nid").agg(F.count("*").alias("n_nodes")).join(inner, "nid", "left").na.fill(0)
        summary = staged(summary.withColumn("is_consistent", (F.col("n_nodes") <= 2) | (F.col("n_neg_inside") == 0)), "summary")
        held = growing(redundancy.positive_redundancy(labelled, pcc, self.k_pos, summary=summary))
        flags = summary.join(held, "nid", "left").select("nid", F.col("n_nodes").alias("size"), (F.col("n_neg_inside") > 0).alias("inconsistent"), F.coalesce("pos_redun", F.lit(False)).alias("pos_redundant"))
        self.searched = self.moved = None
        t.commit({
            "nodes": (None, pcc, None),
            "members": (None, pcc, None),
            "edges": (None, self._both_ends(self._with_tree(labelled, summary, columns), "u", "v"), None),
            "meta": (None, self._all_meta(half, summary), None),
            "flags": (None, flags, None),
        }, {"epoch": epoch})

    def _with_tree(self, labelled: DataFrame, summary: DataFrame, columns: list[str]) -> DataFrame:
        """All edges (u < v) with ``tree``: forests by a kernel for each component, and in rounds for those with more than `redundancy.KERNEL_EDGES` edges."""
        rows = labelled.select("na", F.col("aid1").alias("u"), F.col("aid2").alias("v"), *columns[2:-1])
        others = rows.where(~F.col("decision").eqNullSafe(POSTV)).withColumn("tree", F.lit(False)).select(*columns)
        rows = rows.where(F.col("decision") == POSTV)

        def mark(nid, group):
            return [(*r, taken) for r, taken in zip(group, kernels.forest((r[0], r[1]) for r in group), strict=True)]

        large = staged(summary.where(F.col("n_pos") > redundancy.KERNEL_EDGES).select(F.col("nid").alias("na")), "large")
        if large.isEmpty():
            return others.unionByName(by_group(rows, "na", mark, self.TABLES["edges"][0]))
        big = staged(rows.join(large, "na", "left_semi"), "big")
        taken = staged(spanning_forest(big, "u", "v", at_once=AT_ONCE).withColumn("tree", F.lit(True)), "taken")
        big = big.join(taken, ["u", "v"], "left").withColumn("tree", F.coalesce("tree", F.lit(False))).select(*columns)
        return others.unionByName(big).unionByName(by_group(rows.join(large, "na", "left_anti"), "na", mark, self.TABLES["edges"][0]))

    def _all_meta(self, half: DataFrame, summary: DataFrame) -> DataFrame:
        """Rows of meta from both sides, of counts with nid1 <= nid2; only where there are negative edges are sizes looked up."""
        asked = (F.col("nid1") != F.col("nid2")) & (F.col(NEGTV) > 0)
        side = lambda i: summary.select(F.col("nid").alias(f"nid{i}"), F.col("n_nodes").alias(f"size{i}"), (F.col("n_neg_inside") == 0).alias(f"good{i}"))
        weight = F.col(NEGTV)
        near = half.where(asked).join(side(1), "nid1").join(side(2), "nid2").withColumn("enough", (weight >= self.k_neg) | (weight == F.col("size1")) | (weight == F.col("size2")))
        near = near.select("nid1", "nid2", *graph.DECISIONS, (F.col("enough") & F.col("good1")).alias("r1"), (F.col("enough") & F.col("good2")).alias("r2"))
        rest = half.where(~asked).select("nid1", "nid2", *graph.DECISIONS, F.lit(False).alias("r1"), F.lit(False).alias("r2"))
        rows = near.unionByName(rest)
        one, two = (F.struct(F.col(a).alias("nid"), F.col(b).alias("other"), *graph.DECISIONS, F.col(r).alias("redundant")) for a, b, r in (("nid1", "nid2", "r1"), ("nid2", "nid1", "r2")))
        return rows.select(F.explode(F.when(F.col("nid1") == F.col("nid2"), F.array(one)).otherwise(F.array(one, two))).alias("x")).select("x.*")

    @staticmethod
    def _both_ends(rows: DataFrame, u: str, v: str) -> DataFrame:
        """Each row once more with its ends exchanged."""
        rest = [c for c in rows.columns if c not in (u, v)]
        one, two = (F.struct(F.col(a).alias(u), F.col(b).alias(v), *rest) for a, b in ((u, v), (v, u)))
        return rows.select(F.explode(F.array(one, two)).alias("x")).select("x.*")

    def _split(self, cut: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(aid, old, nid) of all members of components whose forest loses an edge, and the edges (u, v) that take its place in the forest."""
        t = self.tables
        torn = staged(cut.where("tree").join(label.toDF("aid1", "nid"), "aid1").select("nid").distinct(), "torn")
        self.searched = torn.count()
        if not self.searched:
            return self.spark.createDataFrame([], "aid long, old long, nid long"), self.spark.createDataFrame([], "u long, v long")
        inside = staged(t.matching("members", torn), "inside")
        gone = cut.select(F.col("aid1").alias("u"), F.col("aid2").alias("v"))
        rest = t.matching("edges", inside.select("aid")).where("tree AND u < v").select("u", "v").join(gone, ["u", "v"], "left_anti")
        pieces = staged(connected_components(rest, "u", "v", nodes=inside, component="piece", at_once=AT_ONCE).join(inside, "aid"), "pieces")
        sizes = pieces.groupBy("nid", "piece").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("nid").agg(F.max_by("piece", F.struct("n", "piece")).alias("piece"))
        small = staged(pieces.join(largest.select("piece"), "piece", "left_anti").select("aid", "piece"), "small")
        spare = t.matching("edges", small.select("aid")).where(f"decision = '{POSTV}' AND NOT tree").select("u", "v")
        spare = spare.join(gone.union(gone.select("v", "u")), ["u", "v"], "left_anti").join(small.toDF("u", "pu"), "u").join(pieces.select(F.col("aid").alias("v"), F.col("piece").alias("pv")), "v").where("pu <> pv")
        joining, links, _ = self._forest(spare.select("u", "v", "pu", "pv"))
        whole = connected_components(joining, "a", "b", nodes=pieces.select("piece"), node="piece", component="whole", at_once=AT_ONCE)
        return staged(pieces.join(whole, "piece").select("aid", F.col("nid").alias("old"), F.col("whole").alias("nid")), "apart"), links

    def _forest(self, crossing: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Of edges (u, v) between parts (pu, pv): the pairs of parts (a, b) of a spanning forest, an edge (u < v) for each, and how many pairs there were to choose from."""
        seen = Observation()
        best = crossing.groupBy(F.least("pu", "pv").alias("a"), F.greatest("pu", "pv").alias("b")).agg(F.min(F.struct(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).alias("e"))
        best = staged(best.observe(seen, F.count(F.lit(1)).alias("n")), "best")
        if not seen.get["n"]:
            return self.spark.createDataFrame([], "a long, b long"), self.spark.createDataFrame([], "u long, v long"), 0
        joining = staged(spanning_forest(best, "a", "b", at_once=AT_ONCE), "joining")
        return joining, best.join(joining, ["a", "b"]).select("e.u", "e.v"), seen.get["n"]

    def _merged(self, grown: DataFrame, label: DataFrame, apart: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(aid, old, nid) of all records whose label changes, and the new edges (u, v) that are in the forest."""
        now = label.join(apart.select("aid", F.col("nid").alias("then")), "aid", "left").select("aid", F.coalesce("then", "nid").alias("nid"))
        pairs = grown.join(now.toDF("aid1", "pu"), "aid1").join(now.toDF("aid2", "pv"), "aid2").where("pu <> pv")
        joining, links, n = self._forest(pairs.select(F.col("aid1").alias("u"), F.col("aid2").alias("v"), "pu", "pv"))
        target = self.spark.createDataFrame([], "nid long, to long")
        if n:
            target = staged(connected_components(joining, "a", "b", node="nid", component="to", at_once=AT_ONCE), "target")
        others = self.tables.matching("members", target.where("nid <> to").select("nid")).join(apart.select("aid"), "aid", "left_anti")
        placed = apart.unionByName(others.select("aid", F.col("nid").alias("old"), "nid")).unionByName(fresh.select("aid", F.lit(None).cast("long").alias("old"), F.col("aid").alias("nid")))
        placed = placed.join(target, "nid", "left").select("aid", "old", F.coalesce("to", "nid").alias("nid"))
        return staged(placed.where("NOT old <=> nid"), "moved"), links

    def _delta(self, folded: DataFrame, moved: DataFrame) -> DataFrame:
        """(nid, other, then a change for each decision): what edges that changed, or whose ends moved, do to the counts between components; from both sides."""
        t = self.tables
        beside = t.matching("edges", moved.where("old IS NOT NULL").select("aid")).select(F.least("u", "v").alias("aid1"), F.greatest("u", "v").alias("aid2"), F.col("decision").alias("was"))
        changed = folded.where("NOT was <=> decision").select("aid1", "aid2", "was")
        rows = beside.union(changed).distinct().join(folded.select("aid1", "aid2", "decision"), ["aid1", "aid2"], "left").withColumn("now", F.coalesce("decision", "was"))
        rows = staged(rows.select("aid1", "aid2", "was", "now"), "changed")
        ends = rows.select(F.explode(F.array("aid1", "aid2")).alias("aid")).distinct()
        held = t.matching("nodes", ends).join(moved.select("aid", F.col("nid").alias("to")), "aid", "left").select("aid", F.col("nid").alias("old"), F.coalesce("to", "nid").alias("new"))
        held = staged(held.union(moved.where("old IS NULL").select("aid", "old", "nid")), "held")
        both = rows.join(held.toDF("aid1", "o1", "n1"), "aid1").join(held.toDF("aid2", "o2", "n2"), "aid2")
        count = lambda x, y, d, n: both.where(F.col(d).isNotNull()).select(F.least(x, y).alias("nid"), F.greatest(x, y).alias("other"), F.col(d).alias("d"), F.lit(n).alias("n"))
        sums = count("o1", "o2", "was", -1).union(count("n1", "n2", "now", 1)).groupBy("nid", "other").agg(*[F.sum(F.when(F.col("d") == d, F.col("n")).otherwise(0)).alias(d) for d in graph.DECISIONS])
        sums = sums.where(" OR ".join(f"{d} <> 0" for d in graph.DECISIONS))
        return staged(sums.union(sums.where("nid <> other").select(F.col("other").alias("nid"), F.col("nid").alias("other"), *graph.DECISIONS)), "delta")

    def _counted(self, nids: DataFrame, delta: DataFrame) -> DataFrame:
        """Rows of meta for ``nids``, with the changes; ``redundant`` as before (null for a new row)."""
        old = self.tables.matching("meta", nids)
        mine = delta.join(nids.toDF("nid").distinct(), "nid", "left_semi").withColumnsRenamed({d: f"d_{d}" for d in graph.DECISIONS})
        sums = [(F.coalesce(d, F.lit(0)) + F.coalesce(f"d_{d}", F.lit(0))).alias(d) for d in graph.DECISIONS]
        return old.join(mine, ["nid", "other"], "full_outer").select("nid", "other", *sums, "redundant", F.greatest(*[F.col(f"d_{d}").isNotNull() for d in graph.DECISIONS]).alias("changed"))

    def _flags(self, folded: DataFrame, moved: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows of flags that are other than before, the components that are gone, and the members of touched ones."""
        t = self.tables
        shift = moved.select("nid", F.lit(1).alias("n")).union(moved.where("old IS NOT NULL").select("old", F.lit(-1))).groupBy("nid").agg(F.sum("n").alias("n"))
        shift = growing(shift)
        touched = staged(shift.select("nid").union(delta.where("nid = other").select("nid")).distinct(), "touched")
        sized = touched.join(t.matching("flags", touched).select("nid", "size"), "nid", "left").join(shift, "nid", "left").select("nid", (F.coalesce("size", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("size"))
        sized = staged(sized, "sized")
        inner = self._counted(touched, delta).where("nid = other").select("nid", (F.col(NEGTV) > 0).alias("bad"))
        members = t.matching("members", touched).join(moved.select("aid"), "aid", "left_anti").select("aid", "nid").union(moved.select("aid", "nid"))
        members = staged(members, "members")
        rows = t.matching("edges", members.select("aid")).where("u < v").select(F.col("u").alias("aid1"), F.col("v").alias("aid2"), "decision").join(folded.select("aid1", "aid2"), ["aid1", "aid2"], "left_anti")
        rows = staged(rows.union(folded.select("aid1", "aid2", "decision")), "inside")
        held = growing(redundancy.positive_redundancy(rows, members, self.k_pos))
        flags = sized.where("size > 0").join(inner, "nid", "left").join(held, "nid", "left")
        flags = staged(flags.select("nid", "size", F.coalesce("bad", F.lit(False)).alias("inconsistent"), F.coalesce("pos_redun", F.lit(False)).alias("pos_redundant")), "flags")
        return flags, sized.where("size = 0").select("nid"), members

    def _meta(self, delta: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of meta that are other than before, and the keys of those that are gone."""
        nids = staged(flags.select("nid").union(delta.select("nid")).distinct(), "nids")
        rows = self._counted(nids, delta)
        # Redundancy depends on both components; what one's flags change is changed in the other's row, too.
        mirrored = rows.where("nid <> other").select(F.col("other").alias("nid"), F.col("nid").alias("other"), *graph.DECISIONS)
        mirrored = mirrored.join(nids, "nid", "left_anti")
        there = self.tables.matching("meta", mirrored.select("nid")).select("nid", "other", "redundant")
        mirrored = mirrored.join(there, ["nid", "other"], "left").withColumn("changed", F.lit(None).cast("boolean"))
        rows = staged(rows.unionByName(mirrored), "meta")
        empty = " AND ".join(f"{d} = 0" for d in graph.DECISIONS)
        live = rows.where(f"NOT ({empty})")
        asked = live.select("nid").distinct()
        held = self.tables.matching("flags", asked).join(flags.select("nid"), "nid", "left_anti").select("nid", "size", "inconsistent").union(flags.select("nid", "size", "inconsistent"))
        held = staged(held, "held")
        both = live.join(held, "nid").join(held.select(F.col("nid").alias("other"), F.col("size").alias("size2")), "other")
        weight = F.col(NEGTV)
        flag = (F.col("nid") != F.col("other")) & (weight > 0) & ~F.col("inconsistent") & ((weight >= self.k_neg) | (weight == F.col("size")) | (weight == F.col("size2")))
        out = both.withColumn("flag", flag).where("coalesce(changed, false) OR NOT redundant <=> flag")
        return out.select("nid", "other", *graph.DECISIONS, F.col("flag").alias("redundant")), rows.where(empty).select("nid", "other")

    def _edge_rows(self, folded: DataFrame, tree: DataFrame) -> DataFrame:
        """Rows of edges from both ends: those reviewed, and those that are new in the forest."""
        columns = [c.split()[0] for c in self.TABLES["edges"][0].split(", ")]
        marked = tree.select("u", "v", F.lit(True).alias("taken")).distinct()
        seen = folded.withColumnsRenamed({"aid1": "u", "aid2": "v"}).join(marked, ["u", "v"], "left")
        seen = seen.withColumn("tree", F.coalesce("taken", F.col("tree") & (F.col("was") == POSTV) & (F.col("decision") == POSTV), F.lit(False))).select(*columns)
        others = marked.join(folded.select(F.col("aid1").alias("u"), F.col("aid2").alias("v")), ["u", "v"], "left_anti")
        old = self.tables.matching("edges", others.select("u")).join(others, ["u", "v"], "left_semi").withColumn("tree", F.lit(True)).select(*columns)
        rows = staged(seen.unionByName(old), "edges")
        return rows.union(rows.select(F.col("v"), F.col("u"), *columns[2:]))

    def follow(self, stream: DataFrame):
        """A streaming query that applies each micro-batch of ``stream``; its checkpoint lies beside the tables."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()


def replay(spark: SparkSession, reviews: DataFrame, annots: DataFrame, batches: int = 3) -> ReviewState:
    """Write a log in batches, in order of review_id, and follow them as a stream, one batch at a time."""
    folder = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    ends = reviews.agg(F.min("review_id").alias("lo"), F.max("review_id").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    width = max(1, -(-(hi - lo + 1) // batches))
    state = ReviewState(annots)
    for i in range(batches):
        reviews.where(F.floor((F.col("review_id") - lo) / width) == i).write.mode("append").parquet(folder)
        state.follow(spark.readStream.schema(reviews.schema).parquet(folder)).awaitTermination()
    return state
