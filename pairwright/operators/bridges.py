"""Bridges and cuts of two edges over DataFrames, by labels that a spanning forest sums up.

Every edge outside a spanning forest has a 64-bit number of its own (a hash of its ends); an edge of
the forest has the XOR of those whose cycles it is in. An edge is a bridge if its number is 0, and two
edges are a cut if their numbers are equal, but for a chance of 2^-64 a pair. The sums are taken along
an Euler tour of the forest, by pointers that double their reach each round; so rounds grow with the
logarithm of a component, and no task ever holds one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.operators.components import connected_components, spanning_forest
from pairwright.session import staged

#: Neighbours of a node are ordered in so many blocks, so that no task sorts all of a hub's.
BLOCKS = 256
MOST_ROUNDS = 64


def edge_labels(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """(aid1, aid2, tree, label) of all distinct edges; self edges are left out."""
    rows = staged(edges.select(F.least("aid1", "aid2").alias("aid1"), F.greatest("aid1", "aid2").alias("aid2")).where("aid1 < aid2").distinct(), "edges")
    forest = staged(spanning_forest(rows, at_once=at_once), "forest")
    spare = staged(rows.join(forest, ["aid1", "aid2"], "left_anti").withColumn("label", F.xxhash64("aid1", "aid2")), "spare")
    sums = spare.select(F.explode(F.array("aid1", "aid2")).alias("u"), "label").groupBy("u").agg(F.bit_xor("label").alias("x"))
    ways = forest.toDF("u", "v").union(forest.select("aid2", "aid1"))
    roots = connected_components(forest, node="u", component="root", at_once=at_once)
    done = _suffixes(_tour(ways, sums), roots)
    one = done.where("u < v").select(F.col("u").alias("aid1"), F.col("v").alias("aid2"), "s")
    two = done.where("u > v").select(F.col("v").alias("aid1"), F.col("u").alias("aid2"), F.col("s").alias("s2"))
    inner = one.join(two, ["aid1", "aid2"]).select("aid1", "aid2", F.lit(True).alias("tree"), F.expr("s ^ s2").alias("label"))
    return inner.unionByName(spare.select("aid1", "aid2", F.lit(False).alias("tree"), "label"))


def _tour(ways: DataFrame, sums: DataFrame) -> DataFrame:
    """(u, v, nu, nv, y): each directed edge of the forest with the one that follows it; the number of a node goes to its first way out.

    After u -> v comes v -> w with the neighbour w of v that is next to u, in a circle. The circle is cut at one
    way of each tree: what leads to its least node and would go on with that node's first way out.
    """
    near = staged(ways.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(BLOCKS))), "ways")
    within = near.withColumn("next", F.lead("v").over(Window.partitionBy("u", "block").orderBy("v")))
    heads = near.groupBy("u", "block").agg(F.min("v").alias("head"))
    order = Window.partitionBy("u").orderBy("block")
    heads = heads.select("u", "block", F.lead("head").over(order).alias("after"), F.first("head").over(order).alias("first"))
    around = within.join(heads, ["u", "block"]).select("u", "v", F.coalesce("next", "after", "first").alias("next"), (F.col("v") == F.col("first")).alias("leads"), F.coalesce("next", "after").isNull().alias("last"))
    around = staged(around.join(sums, "u", "left").select("u", "v", "next", "last", F.when(F.col("leads"), F.coalesce("x", F.lit(0))).otherwise(0).alias("y")), "around")
    # The way u -> v is followed by v -> next, where next follows u around v.
    after = around.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("next").alias("w"), F.col("last").alias("wraps"))
    return around.select("u", "v", "y").join(after, ["u", "v"]).select("u", "v", F.col("v").alias("nu"), F.col("w").alias("nv"), "wraps", "y")


def leaf_places(ways: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, root, place, n): the leaves of trees, numbered from 0 along a tour around each tree, and how many its tree has.

    ``ways``: each edge of the trees in both directions (u, v); ``roots``: (u, root), a label for each tree. The
    leaves beyond any edge follow each other in the tour (in a circle).
    """
    leaves = staged(ways.groupBy("u").agg(F.count("*").alias("d")).where("d = 1").select("u", F.lit(1).cast("long").alias("x")), "leaves")
    done = _suffixes(_tour(ways, leaves), roots, "+").select("u", F.col("s").alias("place"))
    placed = leaves.select("u").join(done, "u").join(roots, "u")
    return placed.join(placed.groupBy("root").agg(F.count("*").alias("n")), "root").select("u", "root", "place", "n")


def _suffixes(tour: DataFrame, roots: DataFrame, plus: str = "^") -> DataFrame:
    """(u, v, s): the numbers of the ways behind each way, up to where its tree's circle is cut, put together by ``plus`` (XOR or sum)."""
    cut = F.col("wraps") & (F.col("v") == F.col("root"))
    ways = staged(tour.join(roots, "u").select("u", "v", F.when(~cut, F.col("nu")).alias("nu"), F.when(~cut, F.col("nv")).alias("nv"), "y"), "tour")
    # The sum behind a way starts with the number of the next one.
    follow = ways.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("y").alias("y2"))
    ways = staged(ways.join(follow, ["nu", "nv"], "left").select("u", "v", "nu", "nv", F.coalesce("y2", F.lit(0)).alias("s")), "suffix")
    for _ in range(MOST_ROUNDS):
        if not ways.where("nu IS NOT NULL").limit(1).count():
            return ways.select("u", "v", "s")
        on = ways.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("mu"), F.col("nv").alias("mv"), F.col("s").alias("s2"))
        ways = staged(ways.join(on, ["nu", "nv"], "left").select("u", "v", F.col("mu").alias("nu"), F.col("mv").alias("nv"), F.expr(f"s {plus} coalesce(s2, 0)").alias("s")), "suffix")
    raise RuntimeError("the tour did not settle")
