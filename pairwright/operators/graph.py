"""Edges under component labels: meta edges, consistency, inferred states, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.codes import INCMP, NEGTV, POSTV, UNKWN, UNREV, rectified

DECISIONS = (POSTV, NEGTV, INCMP, UNKWN, UNREV)


def canonical(pairs: DataFrame, u: str = "aid1", v: str = "aid2") -> DataFrame:
    """Pairs with the lesser end first; a self edge is an error."""
    bad = F.raise_error(F.concat(F.lit("self edge at "), F.col(u).cast("string")))
    first = F.when(F.col(u) == F.col(v), bad.cast("long")).otherwise(F.least(u, v))
    return pairs.withColumns({u: first, v: F.greatest(u, v)})


def latest_reviews(reviews: DataFrame, order: str = "review_id") -> DataFrame:
    """The last review of each edge by ``order``, with how many there were and the decision."""
    rest = [c for c in reviews.columns if c not in ("aid1", "aid2")]
    last = reviews.groupBy("aid1", "aid2").agg(F.max_by(F.struct(*rest), order).alias("r"), F.count("*").alias("num_reviews"))
    out = last.select("aid1", "aid2", *[F.col(f"r.{c}").alias(c) for c in rest if c != "num_reviews"], "num_reviews")
    return out.withColumn("decision", rectified(F.col("evidence_decision"), F.col("meta_decision")))


def with_ends(annots: DataFrame, edges: DataFrame, allow: bool = True) -> DataFrame:
    """(aid): the records, and ends of edges that are none of them; unless those are allowed, one is an error."""
    own = annots.select("aid").distinct()
    unseen = edges.select(F.explode(F.array("aid1", "aid2")).alias("aid")).distinct().join(own, "aid", "left_anti")
    if not allow:
        unseen = unseen.select(F.raise_error(F.concat(F.lit("no record "), F.col("aid").cast("string"))).cast("long").alias("aid"))
    return own.union(unseen)


def with_labels(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """Edges with the components of their ends: nid1 <= nid2, and those of aid1 and aid2 as na and nb.

    Edges that have them already (from here, for the same components) stay as they are.
    """
    if {"na", "nb", "nid1", "nid2"} <= set(edges.columns):
        return edges
    a = pcc.select(F.col("aid").alias("aid1"), F.col("nid").alias("na"))
    b = pcc.select(F.col("aid").alias("aid2"), F.col("nid").alias("nb"))
    return edges.join(a, "aid1").join(b, "aid2").withColumns({"nid1": F.least("na", "nb"), "nid2": F.greatest("na", "nb")})


def edges_inside(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    return with_labels(edges, pcc).where("nid1 = nid2")


def edges_cross(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    return with_labels(edges, pcc).where("nid1 <> nid2")


def edges_outgoing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with just one end in ``nodes`` (column aid)."""
    ends = nodes.select("aid").distinct()
    one = edges.join(ends.toDF("aid1"), "aid1", "left_semi").join(ends.toDF("aid2"), "aid2", "left_anti")
    two = edges.join(ends.toDF("aid2"), "aid2", "left_semi").join(ends.toDF("aid1"), "aid1", "left_anti")
    return one.unionByName(two)


def edges_between(edges: DataFrame, nodes1: DataFrame, nodes2: DataFrame | None = None) -> DataFrame:
    """Edges from a node of one set to a node of the other (default: the same set); sets may overlap."""
    a, b = nodes1.select("aid").distinct(), (nodes1 if nodes2 is None else nodes2).select("aid").distinct()
    way = lambda x, y: edges.join(x.toDF("aid1"), "aid1", "left_semi").join(y.toDF("aid2"), "aid2", "left_semi")
    return way(a, b) if nodes2 is None else way(a, b).unionByName(way(b, a)).distinct()


def meta_edges(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """(nid1, nid2, decision, n): edges between and within components by decision."""
    return with_labels(edges, pcc).groupBy("nid1", "nid2", "decision").agg(F.count("*").alias("n"))


def neg_metagraph(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """(nid1, nid2, weight): negative edges between components; a self loop marks an inconsistent one."""
    return with_labels(edges.where(F.col("decision") == NEGTV), pcc).groupBy("nid1", "nid2").agg(F.count("*").alias("weight"))


def neg_nid_freq(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """(nid, other, freq): negative edges from each component to each other one."""
    meta = neg_metagraph(edges, pcc).where("nid1 <> nid2")
    return meta.selectExpr("nid1 AS nid", "nid2 AS other", "weight AS freq").union(meta.selectExpr("nid2", "nid1", "weight"))


def pcc_summary(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """(nid, n_nodes, n_pos, n_neg_inside, n_incmp_inside, is_consistent) of each component."""
    sizes = pcc.groupBy("nid").agg(F.count("*").alias("n_nodes"))
    inside = edges_inside(edges, pcc).groupBy(F.col("nid1").alias("nid")).agg(*[F.count_if(F.col("decision") == d).alias(n) for d, n in ((POSTV, "n_pos"), (NEGTV, "n_neg_inside"), (INCMP, "n_incmp_inside"))])
    out = sizes.join(inside, "nid", "left").na.fill(0)
    return out.withColumn("is_consistent", (F.col("n_nodes") <= 2) | (F.col("n_neg_inside") == 0))


def inconsistent(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """(nid) of components with a negative edge inside."""
    return edges_inside(edges.where(F.col("decision") == NEGTV), pcc).select(F.col("nid1").alias("nid")).distinct()


def inferred_state(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """Edges with inferred_state: the state of an edge by what its components say of it."""
    labelled = with_labels(edges, pcc)
    bad = inconsistent(edges, pcc)
    neg = neg_metagraph(edges, pcc).select("nid1", "nid2", F.lit(True).alias("neg"))
    rows = labelled.join(bad.select(F.col("nid").alias("nid1"), F.lit(True).alias("bad1")), "nid1", "left").join(bad.select(F.col("nid").alias("nid2"), F.lit(True).alias("bad2")), "nid2", "left").join(neg, ["nid1", "nid2"], "left")
    same, either = F.col("nid1") == F.col("nid2"), F.coalesce("bad1", "bad2").isNotNull()
    state = F.when(same & either, "inconsistent_internal").when(same, "same").when(either, "inconsistent_external").when(F.col("neg"), "diff").when(F.col("decision").isin(INCMP, UNKWN), F.col("decision"))
    return rows.withColumn("inferred_state", state).select(*edges.columns, "nid1", "nid2", "inferred_state")


def status(edges: DataFrame, pcc: DataFrame, extended: bool = False) -> DataFrame:
    """One row of counts of nodes, components, edges by decision and, if extended, edges within and between."""
    count = lambda d: F.count_if(F.col("decision") == d)
    labelled = with_labels(edges, pcc)
    parts = [count(d).alias(f"n_{d.lower()}") for d in DECISIONS]
    if extended:
        parts += [F.count_if((F.col("decision") == d) & ((F.col("nid1") == F.col("nid2")) == w)).alias(f"n_{d.lower()}_{'within' if w else 'between'}") for d in (NEGTV, INCMP, UNREV) for w in (True, False)]
    sizes = pcc.groupBy("nid").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_pccs"), F.count_if(F.col("n") == 1).alias("n_singletons"))
    bad = inconsistent(edges, pcc).agg(F.count("*").alias("n_inconsistent"))
    return sizes.join(F.broadcast(bad)).join(F.broadcast(labelled.agg(F.count("*").alias("n_edges"), *parts)))


def edges_where(edges: DataFrame, key: str, op: str, value) -> DataFrame:
    """Edges whose attribute compares so with ``value``: eq, ne, lt, le, gt, ge; null equals null only."""
    c, v = F.col(key), F.lit(value)
    tests = {"eq": c.eqNullSafe(v), "ne": ~c.eqNullSafe(v), "lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}
    return edges.where(tests[op])


def attributes(asked: DataFrame, table: DataFrame, key: str, on_missing: str = "error", on_keyerr: str = "default", default=None, keys: tuple[str, ...] = ("aid1", "aid2")) -> DataFrame:
    """(keys, key) for the edges asked for, or for nodes with ``keys`` ("aid",).

    on_missing, for those that are not there, and on_keyerr, for nulls: error, default or filter.
    """
    found = asked.select(*keys).join(table.select(*keys, F.col(key), F.lit(True).alias("_there")), list(keys), "left")
    fail = lambda what: F.raise_error(F.concat_ws(" ", F.lit(what), *keys))
    kind, name = dict(table.dtypes)[key], "edge" if len(keys) > 1 else "node"
    for policy, lacks, what in ((on_missing, F.col("_there").isNull(), f"no {name}"), (on_keyerr, F.col("_there").isNotNull() & F.col(key).isNull(), "no value at")):
        if policy == "filter":
            found = found.where(~lacks)
        else:
            value = fail(what).cast(kind) if policy == "error" else F.lit(default).cast(kind)
            found = found.withColumn(key, F.when(lacks, value).otherwise(F.col(key)))
    return found.drop("_there")


def present(asked: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("aid1", "aid2")) -> DataFrame:
    """(keys, there): whether each edge or node asked for is in ``table``."""
    return asked.select(*keys).join(table.select(*keys, F.lit(True).alias("there")).distinct(), list(keys), "left").withColumn("there", F.coalesce("there", F.lit(False)))


def without_attribute(table: DataFrame, key: str, of: DataFrame | None = None, keys: tuple[str, ...] = ("aid1", "aid2")) -> DataFrame:
    """``table`` with null for an attribute, of all its rows or of those with the keys of ``of``; without the column where that leaves none."""
    if of is None:
        return table.drop(key)
    gone = of.select(*keys).distinct().withColumn("_gone", F.lit(True))
    rows = table.join(gone, list(keys), "left")
    return rows.select(*[F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c == key else F.col(c) for c in table.columns])


def with_value(table: DataFrame, key: str, keys: tuple[str, ...] = ("aid1", "aid2")) -> DataFrame:
    """(keys, key) of the rows that have a value: what is left when null attributes are deleted."""
    return table.where(F.col(key).isNotNull()).select(*keys, key)


def nonvisual(edges: DataFrame) -> DataFrame:
    """``edges`` without columns that only drawing needs."""
    return edges.drop(*[c for c in edges.columns if c in DRAWN])


#: Attributes of edges that are about their looks.
DRAWN = ("color", "label", "style", "linewidth", "alpha", "pos")


def pair_connection_info(pairs: DataFrame, edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """(nid1, nid2, aid1, aid2, decision, n_pos, n_neg, n_incmp): for each pair its edge, if any, and the edges between (or in) its components."""
    counts = with_labels(edges, pcc).groupBy("nid1", "nid2").agg(*[F.count_if(F.col("decision") == d).alias(n) for d, n in ((POSTV, "n_pos"), (NEGTV, "n_neg"), (INCMP, "n_incmp"))])
    rows = with_labels(pairs.select("aid1", "aid2"), pcc).select("nid1", "nid2", "aid1", "aid2").join(edges.select("aid1", "aid2", "decision"), ["aid1", "aid2"], "left")
    return rows.join(counts, ["nid1", "nid2"], "left").na.fill(0, ["n_pos", "n_neg", "n_incmp"]).select("nid1", "nid2", "aid1", "aid2", "decision", "n_pos", "n_neg", "n_incmp")


def updated(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``table`` with ``columns`` from ``changes`` where there is a row with the same keys and a value."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def added(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and those of ``rows`` whose keys it has not."""
    return table.unionByName(rows.dropDuplicates(keys).join(table, keys, "left_anti"), allowMissingColumns=True)


def removed_nodes(annots: DataFrame, edges: DataFrame, aids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annots and edges without the nodes ``aids``."""
    gone = aids.select("aid").distinct()
    left = edges.join(gone.toDF("aid1"), "aid1", "left_anti").join(gone.toDF("aid2"), "aid2", "left_anti")
    return annots.join(gone, "aid", "left_anti"), left


def subgraph(annots: DataFrame, edges: DataFrame, aids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annots and edges with all ends among ``aids``."""
    own = aids.select("aid").distinct()
    inner = edges.join(own.toDF("aid1"), "aid1", "left_semi").join(own.toDF("aid2"), "aid2", "left_semi")
    return annots.join(own, "aid", "left_semi"), inner


def same_component(pairs: DataFrame, pcc: DataFrame) -> DataFrame:
    """Pairs with ``connected``: both ends are known and share a component."""
    return with_labels(pairs, pcc).select(*pairs.columns, (F.col("nid1") == F.col("nid2")).alias("connected"))


def confident(edges: DataFrame, decision: str, least: int) -> DataFrame:
    """Edges of a decision made with a confidence of ``least`` or more.

    Two records are confidently separated by such an edge of their own: no path of other edges counts.
    """
    from pairwright.functions.codes import CONFIDENCE, coded

    level: Column = coded(F.col("confidence"), CONFIDENCE, 0)
    return edges.where((F.col("decision") == decision) & (level >= least))


def members_of(aids: DataFrame, pcc: DataFrame) -> DataFrame:
    """(aid, member): all members of the component of each node asked for, itself included."""
    own = aids.select("aid").distinct().join(pcc, "aid")
    return own.join(pcc.select("nid", F.col("aid").alias("member")), "nid").select("aid", "member")


def complete(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """(nid, complete): whether the edges inside each component are all the pairs of its nodes."""
    sizes = pcc.groupBy("nid").agg(F.count("*").alias("n"))
    inside = edges_inside(edges, pcc).select(F.col("nid1").alias("nid"), "aid1", "aid2").distinct().groupBy("nid").agg(F.count("*").alias("m"))
    return sizes.join(inside, "nid", "left").select("nid", (F.coalesce("m", F.lit(0)) * 2 == F.col("n") * (F.col("n") - 1)).alias("complete"))
