"""Connected components by contraction: each round takes every node to a neighbour and is staged."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pairwright.operators import kernels
from pairwright.session import growing, staged

MOST_ROUNDS = 60
#: Edges that a step joins in one task instead of in rounds, with the same rows as result.
AT_ONCE = 100_000


def connected_components(edges: DataFrame, u: str = "aid1", v: str = "aid2", nodes: DataFrame | None = None, node: str = "aid", component: str = "nid", at_once: int = 0) -> DataFrame:
    """(node, component): each node with the least node that it reaches.

    ``nodes`` adds nodes without edges. Self edges, repeated edges and edges with a null end
    change nothing. Each round takes every node to that of itself and its neighbours which comes first in an
    order of its own (a hash), and goes on with the edges between what is left. On paths that is half of the nodes,
    and less elsewhere; so what all rounds read and shuffle is a small multiple of the first one, and rounds grow
    with the logarithm of the longest path. Each is written to the shared folder. Once no more than ``at_once`` edges
    are left, one task joins them, which gives the same rows.
    """
    left, n = _counted(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a > b").distinct())
    moves: list[DataFrame] = []
    while n > at_once:
        if len(moves) == MOST_ROUNDS:
            raise RuntimeError("components did not settle")
        moves.append(_moves(left, len(moves)))
        one, two = moves[-1].toDF("a", "x"), moves[-1].toDF("b", "y")
        moved = left.join(one, "a").join(two, "b").where("x <> y")
        left, n = _counted(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if n:

        def join(parts):
            rows = pd.concat(parts)
            yield pd.DataFrame(kernels.stars(zip(rows["a"].tolist(), rows["b"].tolist(), strict=True)), columns=["a", "b"])

        moves.append(left.coalesce(1).mapInPandas(join, left.schema).toDF("n", "to"))
    if len(moves) == 1 and n:
        # The ends are the least nodes already.
        found = moves[0].union(moves[0].select("to", "to").distinct())
    elif moves:
        ends = moves.pop()
        for move in reversed(moves):
            on = ends.toDF("to", "end")
            ends = growing(staged(move.join(on, "to", "left").select("n", F.coalesce("end", "to").alias("to")), "ends"))
        found = ends.join(ends.groupBy("to").agg(F.min("n").alias("least")), "to").select("n", "least")
    else:
        found = left
    found = found.toDF(node, component)
    if nodes is None:
        nodes = edges.select(F.col(u).alias(node)).union(edges.select(F.col(v))).where(F.col(node).isNotNull())
    return nodes.select(node).distinct().join(growing(found), node, "left").select(node, F.coalesce(component, node).alias(component))


def _counted(pairs: DataFrame) -> tuple[DataFrame, int]:
    """``pairs`` staged, with their number, taken while they are written."""
    seen = Observation()
    rows = staged(pairs.observe(seen, F.count(F.lit(1)).alias("n")), "contracted")
    return growing(rows), seen.get["n"]


def _moves(pairs: DataFrame, salt: int) -> DataFrame:
    """(n, to): each end of ``pairs`` with the first, by a hash with ``salt``, of itself and its neighbours; of equal hashes any."""
    ways = pairs.select(F.col("a").alias("n"), F.col("b").alias("m")).union(pairs.select("b", "a"))
    near = ways.withColumn("h", F.xxhash64("m", F.lit(salt))).groupBy("n").agg(F.min_by("m", "h").alias("m"), F.min("h").alias("h"))
    return growing(staged(near.select("n", F.when(F.xxhash64("n", F.lit(salt)) <= F.col("h"), F.col("n")).otherwise(F.col("m")).alias("to")), "moves"))


def spanning_forest(edges: DataFrame, u: str = "aid1", v: str = "aid2", at_once: int = 0) -> DataFrame:
    """The (u, v) of a spanning forest: in each round every component takes its least edge that leaves it, and they join.

    Edges are ordered by a hash and their ends, so that the choices of a round close no cycle. Rounds grow with the
    logarithm of the number of nodes, as half at least of the components are gone after each. Self and repeated edges
    change nothing. Once no more than ``at_once`` edges are left, one task takes them in order, with the same result.
    """
    order = [F.xxhash64("u", "v").alias("h"), "u", "v"]
    left = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u < v").distinct()
    left = left.select(*order, F.col("u").alias("a"), F.col("v").alias("b"))
    taken = []
    for _ in range(MOST_ROUNDS):
        seen = Observation()
        left = growing(staged(left.observe(seen, F.count(F.lit(1)).alias("n")), "crossing"))
        n = seen.get["n"]
        if n <= at_once:
            if n:

                def take(parts):
                    rows = pd.concat(parts).sort_values(["h", "u", "v"])
                    chosen = kernels.forest(zip(rows["a"].tolist(), rows["b"].tolist(), strict=True))
                    yield rows.loc[chosen, ["u", "v"]]

                taken.append(left.coalesce(1).mapInPandas(take, left.select("u", "v").schema))
            break
        ends = left.select("a", F.struct("h", "u", "v", "a", "b").alias("e")).union(left.select("b", F.struct("h", "u", "v", "a", "b")))
        chosen = staged(ends.groupBy("a").agg(F.min("e").alias("e")).select("e.*").distinct(), "chosen")
        taken.append(chosen.select("u", "v"))
        labels = growing(connected_components(chosen, "a", "b", node="n", component="c", at_once=at_once))
        one, two = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        moved = left.join(one, "a").join(two, "b").where("ca <> cb")
        left = moved.select("h", "u", "v", F.col("ca").alias("a"), F.col("cb").alias("b"))
    out = taken[0] if taken else left.select("u", "v")
    for more in taken[1:]:
        out = out.union(more)
    return out.toDF(u, v)
