"""Pairs worth reviewing: within names, between fragments, absent from a graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.codes import INCMP, NEGTV, POSTV, UNREV
from pairwright.operators import kernels
from pairwright.operators.components import AT_ONCE, connected_components
from pairwright.operators.graph import added
from pairwright.operators.redundancy import positive_augmentation
from pairwright.session import staged


#: Blocks that one side of all pairs of nodes is dealt out to.
FULL_BLOCKS = 64


def clique_pairs(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(aid1, aid2): pairs with one name that are unreviewed or have no edge.

    All pairs of a name are what is asked for, so the result has their number.
    """
    a, b = names.select("name", F.col("aid").alias("aid1")), names.select("name", F.col("aid").alias("aid2"))
    reviewed = edges.where(F.col("decision") != UNREV).select("aid1", "aid2")
    return a.join(b, "name").where("aid1 < aid2").select("aid1", "aid2").join(reviewed, ["aid1", "aid2"], "left_anti")


def complement(nodes: DataFrame, edges: DataFrame, group: str = "name") -> DataFrame:
    """(group, aid1, aid2): pairs of nodes of a group that have no edge.

    All such pairs are what is asked for, so the result has their number.
    """
    a, b = nodes.select(group, F.col("aid").alias("aid1")), nodes.select(group, F.col("aid").alias("aid2"))
    return a.join(b, group).where("aid1 < aid2").join(edges.select("aid1", "aid2"), ["aid1", "aid2"], "left_anti").select(group, "aid1", "aid2")


def fragment_links(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, aid1, aid2): pairs that would join the fragments of each name, if all were positive, as far as that can be.

    Fragments are the components of a name's positive edges. Pairs reviewed as different or
    incomparable are closed; two fragments all of whose pairs are closed cannot be linked. The
    links are a spanning forest of the fragments that can: from a fragment that can be linked
    with all others (the least), else level by level from the least fragment on, each to the
    least of the level before. A link is the least node that has an open partner, with the least
    of those. Names are joined by edges only; no pairs of nodes are made but for closed ones.
    """
    names = names.where("name IS NOT NULL").select("aid", "name")
    one, two = names.toDF("aid1", "name"), names.toDF("aid2", "name2")
    inner = edges.join(one, "aid1").join(two, "aid2").where("name = name2").select("name", "aid1", "aid2", "decision")
    members = staged(names.join(connected_components(inner.where(F.col("decision") == POSTV), nodes=names, component="f", at_once=AT_ONCE), "aid"), "fragments")
    sizes = members.groupBy("name", "f").agg(F.count("*").alias("n"), F.min("aid").alias("first"))
    of = members.select("aid", "f")
    shut = inner.where(F.col("decision").isin(NEGTV, INCMP)).select("name", "aid1", "aid2").distinct().join(of.toDF("aid1", "f1"), "aid1").join(of.toDF("aid2", "f2"), "aid2").where("f1 <> f2")
    counts = shut.groupBy("name", F.least("f1", "f2").alias("f"), F.greatest("f1", "f2").alias("p")).agg(F.count("*").alias("c"))
    counts = staged(counts.union(counts.select("name", "p", "f", "c")), "closed-pairs")
    full = counts.join(sizes.select("f", "n"), "f").join(sizes.select(F.col("f").alias("p"), F.col("n").alias("m")), "p").where("c >= n * m").select("name", "f", "p")
    free = sizes.join(full.select("f").distinct(), "f", "left_anti")
    hubs = free.groupBy("name").agg(F.min("f").alias("p"))
    star = sizes.join(hubs, "name").where("f <> p").select("name", "f", "p")

    def forest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = kernels.complement_forest(pdf["f"].unique().tolist(), zip(pdf["f"].tolist(), pdf["p"].tolist(), strict=True))
        return pd.DataFrame([(key[0], f, p) for f, p in rows], columns=["name", "f", "p"])

    # Names all of whose fragments have one that they cannot be linked with: what is grouped are those pairs.
    tight = full.join(hubs.select("name"), "name", "left_anti").groupBy("name").applyInPandas(forest, full.schema)
    links = star.unionByName(tight).join(counts, ["name", "f", "p"], "left").na.fill(0, ["c"])
    links = staged(links.join(sizes.select("f", "first"), "f").join(sizes.select(F.col("f").alias("p"), F.col("n").alias("m"), F.col("first").alias("first_p")), "p"), "links")
    plain = links.where("c = 0").select("name", F.col("first").alias("u"), F.col("first_p").alias("v"))
    # Of c closed pairs no more than c / m nodes can have all of their m partners closed, and none more than c of them.
    some = links.where("c > 0").select("name", "f", "p", (F.floor(F.col("c") / F.col("m")) + 1).alias("us"), (F.col("c") + 1).alias("vs"))
    asked = some.select("f").union(some.select("p")).distinct()
    ranked = members.join(asked, "f", "left_semi").select("f", "aid", F.row_number().over(Window.partitionBy("f").orderBy("aid")).alias("r"))
    pairs = some.join(ranked.toDF("f", "u", "ru"), "f").where("ru <= us").join(ranked.toDF("p", "v", "rv"), "p").where("rv <= vs")
    pairs = pairs.withColumns({"aid1": F.least("u", "v"), "aid2": F.greatest("u", "v")}).join(shut.select("aid1", "aid2"), ["aid1", "aid2"], "left_anti")
    best = pairs.groupBy("name", "f", "p").agg(F.min(F.struct("u", "v")).alias("b")).select("name", "b.u", "b.v")
    return plain.unionByName(best).select("name", F.least("u", "v").alias("aid1"), F.greatest("u", "v").alias("aid2"))


def ensured(edges: DataFrame, pairs: DataFrame, user_id: str) -> DataFrame:
    """``edges`` with those of ``pairs`` (aid1, aid2) that are new, unreviewed, put there by ``user_id``."""
    new = pairs.select(F.least("aid1", "aid2").alias("aid1"), F.greatest("aid1", "aid2").alias("aid2")).where("aid1 < aid2").distinct()
    return added(edges, new.withColumns({"decision": F.lit(UNREV), "user_id": F.lit(user_id)}), ["aid1", "aid2"])


def same_reviews(pairs: DataFrame, user_id: str) -> DataFrame:
    """Reviews (without ids) that guess each of ``pairs`` to be the same: no evidence, but the meta decision."""
    rows = pairs.select(F.least("aid1", "aid2").alias("aid1"), F.greatest("aid1", "aid2").alias("aid2")).where("aid1 < aid2").distinct()
    values = {"evidence_decision": UNREV, "meta_decision": "same", "confidence": "guessing", "user_id": user_id}
    return rows.withColumns({c: F.lit(v) for c, v in values.items()})


def reviewed_same(edges: DataFrame, pairs: DataFrame, user_id: str) -> DataFrame:
    """``edges`` after `same_reviews` of ``pairs``: those are POSTV then, with one review more; columns of reviews that edges lack are added."""
    reviews = same_reviews(pairs, user_id)
    news = reviews.select("aid1", "aid2", *[F.col(c).alias(f"_{c}") for c in reviews.columns if c not in ("aid1", "aid2")], F.lit(True).alias("_new"))
    for c in ("meta_decision", "confidence", "user_id"):
        edges = edges if c in edges.columns else edges.withColumn(c, F.lit(None).cast("string"))
    rows = edges.join(news, ["aid1", "aid2"], "full_outer")
    put = {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in reviews.columns if c in edges.columns and c not in ("aid1", "aid2")}
    put["decision"] = F.when(F.col("_new"), POSTV).otherwise(F.col("decision"))
    if "num_reviews" in edges.columns:
        put["num_reviews"] = F.coalesce("num_reviews", F.lit(0)) + F.when(F.col("_new"), 1).otherwise(0)
    return rows.select(*[put.get(c, F.col(c)).alias(c) for c in edges.columns])


def ensure_cliques(names: DataFrame, edges: DataFrame, meta_decision: str | None = None) -> DataFrame:
    """``edges`` and all unreviewed pairs within names: as edges to review or, with a meta decision ("same"), reviewed so by a guess."""
    if meta_decision not in (None, "same"):
        raise ValueError("cliques are of the same name")
    pairs = clique_pairs(names, edges)
    return ensured(edges, pairs, "algo:clique") if meta_decision is None else reviewed_same(edges, pairs, "algo:clique")


def ensure_full(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` and all pairs of ``nodes`` (aid) without one: the number of pairs is what is asked for."""
    # Each node meets the nodes of every block, so that no key holds all of them.
    blocked = nodes.select("aid", F.pmod(F.xxhash64("aid"), F.lit(FULL_BLOCKS)).alias("b")).distinct()
    one = blocked.select(F.col("aid").alias("aid1"), F.explode(F.sequence(F.lit(0), F.lit(FULL_BLOCKS - 1))).alias("b"))
    pairs = one.join(blocked.withColumnRenamed("aid", "aid2"), "b").where("aid1 < aid2").select("aid1", "aid2")
    return ensured(edges, pairs, "algo:full")


def ensure_mst(names: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` after a guess that the links of `fragment_links` are the same, so that each name is one component as far as it can be."""
    return reviewed_same(edges, fragment_links(names, edges), "algo:mst")


def connecting_edges(names: DataFrame, edges: DataFrame, k: int = 1) -> DataFrame:
    """(name, aid1, aid2): pairs that would make each name k-edge-connected; beyond k = 1 by the augmentation of its joined fragments."""
    links = fragment_links(names, edges)
    if k == 1:
        return links
    joined = edges.select("aid1", "aid2", "decision").join(links, ["aid1", "aid2"], "left_anti").unionByName(links.select("aid1", "aid2", F.lit(POSTV).alias("decision")))
    inner = joined.join(names.select(F.col("aid").alias("aid1"), F.col("name")), "aid1").join(names.select(F.col("aid").alias("aid2"), F.col("name").alias("name2")), "aid2").where("name = name2")
    more = positive_augmentation(inner.select("aid1", "aid2", "decision"), names.select("aid", F.col("name").alias("nid")), k)
    return links.unionByName(more.select(F.col("nid").alias("name"), "aid1", "aid2"))
