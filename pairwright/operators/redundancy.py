"""Positive and negative redundancy of components, and edges that would make them redundant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.codes import INCMP, NEGTV, POSTV, UNREV
from pairwright.operators import graph, kernels
from pairwright.operators.bridges import edge_labels, leaf_places
from pairwright.operators.components import AT_ONCE, connected_components, spanning_forest
from pairwright.operators.groups import by_group
from pairwright.session import growing, staged
from pairwright.sources.committed import union_all

#: Positive edges of a component that a kernel takes at once; larger ones are decided by labels, or by a kernel over a certificate.
KERNEL_EDGES = 50_000


def certificate(edges: DataFrame, k: int) -> DataFrame:
    """(aid1, aid2): k spanning forests, each of what the ones before leave.

    A cut of fewer than k edges is a cut of these, too, and they are at most k for each node; so whether a component
    is held together by k edges everywhere can be told from them.
    """
    rest, taken = edges.select("aid1", "aid2").distinct(), []
    for i in range(k):
        taken.append(staged(spanning_forest(rest), "forest"))
        if i + 1 < k:
            rest = staged(rest.join(taken[-1], ["aid1", "aid2"], "left_anti"), "rest")
    return union_all(taken)


def edge_connected(inner: DataFrame, k: int, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(nid, held) of the components of ``inner`` (nid, aid1, aid2), each connected by its edges: whether k edges must go before one falls apart.

    Of components with more than ``kernel_edges`` edges, no task holds one for k up to 3: an edge whose label is 0
    is a bridge, and two with one label are a cut of two. Beyond that, a task holds the certificate of one.
    """

    def decide(nid, pairs):
        return [(nid, kernels.connectivity_at_least({n for e in pairs for n in e}, pairs, k))]

    sizes = inner.groupBy("nid").agg(F.count("*").alias("m"))
    large = staged(sizes.where(F.col("m") > kernel_edges).select("nid"), "large")
    schema = "nid long, held boolean"
    small = by_group(inner.join(large, "nid", "left_anti").select("nid", "aid1", "aid2"), "nid", decide, schema)
    if not large.limit(1).count():
        return small
    big = staged(inner.join(large, "nid", "left_semi").select("nid", "aid1", "aid2"), "inner")
    if k > 3:
        kept = big.join(certificate(big, k), ["aid1", "aid2"], "left_semi").select("nid", "aid1", "aid2")
        return small.unionByName(by_group(kept, "nid", decide, schema))
    labels = big.join(edge_labels(big), ["aid1", "aid2"])
    counts = labels.groupBy("nid", "label").agg(F.count("*").alias("n"))
    weak = (F.col("label") == 0) | (F.col("n") > 1 if k == 3 else F.lit(False))
    return small.unionByName(counts.groupBy("nid").agg((~F.bool_or(weak)).alias("held")))


def positive_redundancy(edges: DataFrame, pcc: DataFrame, k: int = 2, relax: bool = True, only_consistent: bool = True, kernel_edges: int = KERNEL_EDGES, summary: DataFrame | None = None) -> DataFrame:
    """(nid, pos_redun): whether each (consistent) component is held together by k edges everywhere.

    With ``relax``, a component whose positive and incomparable edges fill the clique is. What numbers and
    degrees decide is decided by them, and what remains by `edge_connected`. ``summary``: `graph.pcc_summary`, if it is there.
    """
    summary = graph.pcc_summary(edges, pcc) if summary is None else summary
    if only_consistent:
        summary = summary.where("is_consistent")
    full = F.col("n_pos") + F.col("n_incmp_inside") == F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    quick = F.when(full & F.lit(relax), True).when(F.col("n_nodes") < k + 1, False).when(F.lit(k == 1), True)
    summary = growing(staged(summary.select("nid", "n_nodes", quick.alias("quick")), "summary"))
    inner = graph.edges_inside(edges.where(F.col("decision") == POSTV), pcc).select(F.col("nid1").alias("nid"), "aid1", "aid2")
    asked = growing(staged(inner.join(summary.where("quick IS NULL"), "nid", "left_semi"), "asked"))
    ends = asked.select("nid", F.explode(F.array("aid1", "aid2")).alias("aid")).groupBy("nid", "aid").agg(F.count("*").alias("d"))
    open_ = ends.groupBy("nid").agg(F.min("d").alias("least")).where(F.col("least") >= k).select("nid")
    held = edge_connected(growing(staged(asked.join(open_, "nid", "left_semi"), "open")), k, kernel_edges)
    return summary.join(held, "nid", "left").select("nid", F.coalesce("quick", "held", F.lit(False)).alias("pos_redun"))


def negative_redundancy(edges: DataFrame, pcc: DataFrame, k: int = 2) -> DataFrame:
    """(nid1, nid2): nid1 < nid2, nid1 consistent, with k negative edges between them or as many as either has nodes."""
    sizes = pcc.groupBy("nid").agg(F.count("*").alias("size"))
    meta = graph.neg_metagraph(edges, pcc).where("nid1 <> nid2")
    one, two = sizes.toDF("nid1", "size1"), sizes.toDF("nid2", "size2")
    rows = meta.join(one, "nid1").join(two, "nid2").where((F.col("weight") >= k) | (F.col("weight") == F.col("size1")) | (F.col("weight") == F.col("size2")))
    bad = graph.inconsistent(edges, pcc).select(F.col("nid").alias("nid1"))
    return rows.join(bad, "nid1", "left_anti").select("nid1", "nid2")


def non_redundant_pairs(edges: DataFrame, pcc: DataFrame, k: int = 2) -> DataFrame:
    """(nid1, nid2, weight): components with an edge of any kind between them but fewer than k negative ones.

    Components without an edge between them are not listed: their number is the square of that
    of the components.
    """
    rows = graph.edges_cross(edges, pcc).groupBy("nid1", "nid2").agg(F.count_if(F.col("decision") == NEGTV).alias("weight"))
    return rows.where(F.col("weight") < k)


def flagged(edges: DataFrame, pcc: DataFrame, pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Edges with ``redundant``: inside a positively or between a negatively redundant pair."""
    rows = graph.with_labels(edges, pcc)
    inside = pos.where("pos_redun").select(F.col("nid").alias("nid1"), F.col("nid").alias("nid2"))
    both = inside.union(neg.select("nid1", "nid2")).withColumn("redundant", F.lit(True))
    return rows.join(both, ["nid1", "nid2"], "left").select(*edges.columns, F.coalesce("redundant", F.lit(False)).alias("redundant"))


_PAIRS = "nid long, aid1 long, aid2 long, existing boolean"


def positive_augmentation(edges: DataFrame, pcc: DataFrame, k: int = 2, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(nid, aid1, aid2, existing): edges to review so that components become k-edge-connected.

    Unreviewed edges inside are tried alone; where they do not do, absent pairs too, as far as it goes. Components
    with more than ``kernel_edges`` edges that their positive ones connect go through `tree_augmentation` for k = 2;
    any other is one group.
    """
    wanted = growing(staged(positive_redundancy(edges, pcc, k, only_consistent=False).where("NOT pos_redun").select("nid"), "wanted"))
    inner = staged(graph.edges_inside(edges, pcc).select(F.col("nid1").alias("nid"), "aid1", "aid2", "decision").join(wanted, "nid", "left_semi"), "inner")
    nodes = pcc.join(wanted, "nid", "left_semi").where("aid IS NOT NULL").select("nid", "aid")
    large = inner.groupBy("nid").agg(F.count("*").alias("m")).where(F.col("m") > kernel_edges).select("nid")
    trees = None
    if k == 2 and not large.isEmpty():
        members = staged(nodes.join(large, "nid", "left_semi"), "members")
        parts = connected_components(inner.where(F.col("decision") == POSTV).join(large, "nid", "left_semi"), nodes=members, component="part")
        whole = staged(members.join(parts, "aid").groupBy("nid").agg(F.count_distinct("part").alias("parts")).where("parts = 1").select("nid"), "whole")
        trees = tree_augmentation(inner.join(whole, "nid", "left_semi"), members.join(whole, "nid", "left_semi"))
        inner, nodes = inner.join(whole, "nid", "left_anti"), nodes.join(whole, "nid", "left_anti")

    def augment(nid, rows):
        every = [a for a, _, d in rows if d == "member"]
        by = lambda *of: [(a, b) for a, b, d in rows if d in of]
        have, open_, closed = by(POSTV), by(UNREV), by(NEGTV, INCMP, "UNKWN")
        found = kernels.augmented(every, have, k, open_)
        if not found:
            found = kernels.augmented(every, have, k, closed=closed, partial=True)
        old = set(open_)
        return [(nid, a, b, (a, b) in old) for a, b in found]

    members = nodes.select("nid", F.col("aid").alias("aid1"), F.lit(None).cast("long").alias("aid2"), F.lit("member").alias("decision"))
    small = by_group(members.unionByName(inner), "nid", augment, _PAIRS)
    return small if trees is None else small.unionByName(trees)


def tree_augmentation(inner: DataFrame, members: DataFrame) -> DataFrame:
    """(nid, aid1, aid2, existing): edges to review so that components whose positive edges connect them have no bridge.

    ``inner``: (nid, aid1, aid2, decision) of all edges inside, ``members``: (nid, aid). Without the bridges a component
    falls into blocks, which the bridges join to a tree. If unreviewed edges alone do, a spanning forest of them over
    blocks is taken. Else the leaves of the tree are numbered along a tour, and each is linked with the one half
    of the leaves further on, so that (leaves + 1) / 2 edges do, the fewest possible; of the pairs between two blocks an
    unreviewed edge comes first, then the first absent one. A leaf whose partner reviews close off is tried with one block
    more than it has edges to others, and the tree of what is left again, until no leaf can be linked. Rounds are joins and aggregations; no task holds more than `AT_ONCE` edges.
    """
    inner = staged(inner.select("nid", "aid1", "aid2", F.when(F.col("decision").isin(POSTV, UNREV), F.col("decision")).otherwise(INCMP).alias("decision")), "inner")
    solid = inner.where(F.col("decision") == POSTV).select("nid", "aid1", "aid2")
    able = staged(edge_connected(inner.where(F.col("decision") != INCMP).select("nid", "aid1", "aid2"), 2, 0).where("held").select("nid"), "able")
    blocks, _ = _blocks(solid.join(able, "nid", "left_semi"), members.join(able, "nid", "left_semi"))
    crossing = staged(graph.edges_cross(inner.where(F.col("decision") == UNREV), blocks).groupBy("nid1", "nid2").agg(F.min(F.struct("nid", "aid1", "aid2")).alias("e")), "crossing")
    links = crossing.join(spanning_forest(crossing, "nid1", "nid2", AT_ONCE), ["nid1", "nid2"]).select("e.*", F.lit(True).alias("existing"))
    taken = [staged(links, "links")]

    solid, members = staged(solid.join(able, "nid", "left_anti"), "solid"), staged(members.join(able, "nid", "left_anti"), "members")
    other = staged(inner.join(able, "nid", "left_anti"), "other")
    while True:
        blocks, ways = _blocks(solid, members)
        if ways.isEmpty():
            break
        roots = staged(connected_components(ways, "u", "v", node="u", component="root", at_once=AT_ONCE), "roots")
        leaves = staged(leaf_places(ways, roots), "places")
        ahead = leaves.select("root", F.col("u").alias("v"), F.col("place").alias("there"))
        met = leaves.where("2 * place < n").withColumn("there", F.col("place") + F.floor(F.col("n") / 2)).join(ahead, ["root", "there"])
        found = _links(met.select("u", "v"), other, blocks)
        linked = found.select(F.explode(F.array("nid1", "nid2")).alias("u"))
        lone = staged(leaves.join(linked, "u", "left_anti"), "lone")
        if not lone.isEmpty():
            each = _links(_tries(lone, roots, other, blocks), other, blocks).withColumn("leaf", F.explode(F.array("nid1", "nid2"))).join(lone.select(F.col("u").alias("leaf")), "leaf", "left_semi")
            least = F.row_number().over(Window.partitionBy("leaf").orderBy("aid1", "aid2"))
            found = staged(found.unionByName(each.withColumn("r", least).where("r = 1").select(*found.columns)).distinct(), "found")
        if found.isEmpty():
            break
        named = staged(found.join(members.select("nid", F.col("aid").alias("aid1")), "aid1").select("nid", "aid1", "aid2", "existing"), "links")
        taken.append(named)
        solid = staged(solid.unionByName(named.drop("existing")), "solid")
    return union_all(taken)


def _blocks(solid: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aid, nid), nid being the block of a record, and the bridges between blocks in both directions (u, v)."""
    labels = staged(edge_labels(solid, AT_ONCE), "labels")
    cut = labels.where("tree AND label = 0")
    blocks = staged(connected_components(labels.where("NOT tree OR label <> 0"), nodes=members, at_once=AT_ONCE), "blocks")
    joined = graph.with_labels(cut, blocks)
    return blocks, staged(joined.selectExpr("nid1 AS u", "nid2 AS v").union(joined.selectExpr("nid2", "nid1")), "ways")


def _links(pairs: DataFrame, inner: DataFrame, blocks: DataFrame) -> DataFrame:
    """One edge to review for each of the pairs of blocks (u, v) that reviews do not close."""
    asked = pairs.select(F.least("u", "v").alias("nid1"), F.greatest("u", "v").alias("nid2")).where("nid1 < nid2").distinct()
    return staged(negative_augmentation(inner.select("aid1", "aid2", "decision"), blocks, staged(asked, "asked"), 1), "found")


def _tries(leaves: DataFrame, roots: DataFrame, inner: DataFrame, blocks: DataFrame) -> DataFrame:
    """(u, v): each leaf with the least other blocks of its component, one more than it has edges to any, so that one at least is free if one is."""
    crossing = graph.edges_cross(inner, blocks)
    has = crossing.select(F.explode(F.array("nid1", "nid2")).alias("u")).groupBy("u").agg(F.count("*").alias("c"))
    asks = staged(leaves.select("u", "root").join(has, "u", "left").na.fill(0, ["c"]), "asks")
    most = (asks.agg(F.max("c").alias("c")).first()["c"] or 0) + 2
    first = roots.withColumn("r", F.row_number().over(Window.partitionBy("root").orderBy("u"))).where(F.col("r") <= most)
    return asks.join(first.select("root", F.col("u").alias("v"), "r"), "root").where("u <> v AND r <= c + 2").select("u", "v")


def pair_at(i: Column, n1: Column, n2: Column) -> tuple[Column, Column]:
    """The i-th of the n1 * n2 pairs of ranks (from 0), along diagonals: both ranks go on with each pair, so that the first ones share no rank.

    A diagonal comes back to its start after the least common multiple of both; then the second rank skips one.
    """
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    # Euclid's algorithm takes no more than 92 steps on longs.
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(n1.alias("a"), n2.alias("b")), step)["a"]
    return i % n1, (i + F.floor(i / (n1 * n2 / gcd))) % n2


def negative_augmentation(edges: DataFrame, pcc: DataFrame, pairs: DataFrame, k: int = 2) -> DataFrame:
    """(nid1, nid2, aid1, aid2, existing): edges to review between the pairs of components asked for (nid1 < nid2), until each has k negative ones.

    Unreviewed edges that exist come first, in order of their ends, then absent pairs in the order of `pair_at` of the
    records ranked by id. As many pairs are made as are needed and as there are edges between the two, so that enough
    absent ones are among them; components without an edge between them may be asked for, too.
    """
    labelled = graph.with_labels(edges, pcc).join(pairs, ["nid1", "nid2"], "left_semi")
    have = labelled.groupBy("nid1", "nid2").agg(F.count_if(F.col("decision") == NEGTV).alias("n"), F.count_if(F.col("decision") == UNREV).alias("open"), F.count("*").alias("m"))
    need = pairs.select("nid1", "nid2").distinct().join(have, ["nid1", "nid2"], "left").na.fill(0, ["n", "open", "m"]).withColumn("need", F.lit(k) - F.col("n")).where("need > 0")
    order = Window.partitionBy("nid1", "nid2").orderBy("aid1", "aid2")
    open_ = labelled.where(F.col("decision") == UNREV).withColumn("r", F.row_number().over(order)).join(need.select("nid1", "nid2", "need"), ["nid1", "nid2"]).where("r <= need")
    sizes = pcc.groupBy("nid").agg(F.count("*").alias("size"))
    lacking = need.where("need > open").join(sizes.toDF("nid1", "n1"), "nid1").join(sizes.toDF("nid2", "n2"), "nid2").withColumn("lacks", F.col("need") - F.col("open"))
    made = lacking.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("lacks") + F.col("m"), F.col("n1") * F.col("n2")) - 1)))
    r1, r2 = pair_at(F.col("i"), F.col("n1"), F.col("n2"))
    asked = made.select("nid1", "nid2", "i", "lacks", r1.alias("r1"), r2.cast("long").alias("r2"))
    wanted = asked.select(F.col("nid1").alias("nid")).union(asked.select("nid2")).distinct()
    ranked = pcc.join(wanted, "nid", "left_semi").select("nid", "aid", (F.row_number().over(Window.partitionBy("nid").orderBy("aid")) - 1).alias("r"))
    side = lambda j: ranked.select(F.col("nid").alias(f"nid{j}"), F.col("aid").alias(f"x{j}"), F.col("r").cast("long").alias(f"r{j}"))
    absent = asked.join(side(1), ["nid1", "r1"]).join(side(2), ["nid2", "r2"]).select("nid1", "nid2", "i", "lacks", F.least("x1", "x2").alias("aid1"), F.greatest("x1", "x2").alias("aid2"))
    absent = absent.join(edges.select("aid1", "aid2"), ["aid1", "aid2"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("nid1", "nid2").orderBy("i"))).where("r <= lacks")
    out = lambda df, existing: df.select("nid1", "nid2", "aid1", "aid2", F.lit(existing).alias("existing"))
    return out(open_, True).union(out(absent, False))
