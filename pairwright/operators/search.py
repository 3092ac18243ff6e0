"""Searches from node to node, filters of the queue by local connectivity, and sampled products."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.codes import POSTV
from pairwright.operators import graph, kernels
from pairwright.operators.groups import by_group
from pairwright.session import growing, shared_dir, staged


def reached(edges: DataFrame, sources: DataFrame, most_steps: int = 1000, directed: bool = False) -> DataFrame:
    """(aid, step, came_from): nodes reached from ``sources`` (aid) along ``edges``, by least steps; of equals the least node before.

    Conditions on edges are filters of ``edges``. Each step joins the frontier only and writes
    only what is new. That more than ``most_steps`` steps are needed is an error.
    """
    spark = edges.sparkSession
    ways = edges.select(F.col("aid1").alias("u"), F.col("aid2").alias("v"))
    if not directed:
        ways = ways.union(ways.select("v", "u"))
    folder = f"{shared_dir(spark)}/reached-{uuid.uuid4().hex}"
    frontier = sources.select("aid", F.lit(0).alias("step"), F.lit(None).cast("long").alias("came_from")).where("aid IS NOT NULL").dropDuplicates(["aid"])
    schema, before = frontier.schema, []
    for step in range(most_steps + 2):
        path = f"{folder}/step-{step}"
        frontier.write.parquet(path)
        frontier = spark.read.schema(schema).parquet(path)
        if frontier.isEmpty():
            break
        if step > most_steps:
            raise RuntimeError(f"more than {most_steps} steps")
        before.append(path)
        seen = spark.read.schema(schema).parquet(*before)
        new = frontier.join(ways, frontier.aid == ways.u).groupBy("v").agg(F.min("u").alias("came_from")).select(F.col("v").alias("aid"), F.lit(step + 1).alias("step"), "came_from")
        frontier = new.join(seen, "aid", "left_anti")
    return spark.read.schema(schema).parquet(*(before or [path]))


def shortest_path(edges: DataFrame, source: int, target: int) -> list[int]:
    """Nodes from ``source`` to ``target``; empty if there is no way. One join for each step back; only the path comes to the driver."""
    spark = edges.sparkSession
    found = reached(edges, spark.createDataFrame([(source,)], "aid long"))
    end = found.where(F.col("aid") == target).first()
    if end is None:
        return []
    path = [target]
    while end["came_from"] is not None:
        path.append(end["came_from"])
        end = found.where((F.col("step") == end["step"] - 1) & (F.col("aid") == end["came_from"])).first()
    return path[::-1]


def source_nodes(edges: DataFrame) -> DataFrame:
    """(aid) that edges aid1 -> aid2 leave but none enters."""
    return edges.select(F.col("aid1").alias("aid")).distinct().join(edges.select(F.col("aid2").alias("aid")), "aid", "left_anti")


def sink_nodes(edges: DataFrame) -> DataFrame:
    """(aid) that edges aid1 -> aid2 enter but none leaves."""
    return edges.select(F.col("aid2").alias("aid")).distinct().join(edges.select(F.col("aid1").alias("aid")), "aid", "left_anti")


def not_locally_redundant(queue: DataFrame, edges: DataFrame, pcc: DataFrame, k: int = 2) -> DataFrame:
    """The queue without pairs inside a consistent component whose ends k positive paths connect already."""
    queue = growing(staged(queue, "queue"))
    inside = graph.edges_inside(queue.select("aid1", "aid2"), pcc).select(F.col("nid1").alias("nid"), "aid1", "aid2").join(graph.inconsistent(edges, pcc), "nid", "left_anti")
    inside = growing(staged(inside, "inside"))
    positive = graph.edges_inside(edges.where(F.col("decision") == POSTV), pcc).select(F.col("nid1").alias("nid"), "aid1", "aid2").join(inside.select("nid").distinct(), "nid", "left_semi")

    def connected(_nid, rows):
        unit = [(u, v, 1) for u, v, asked in rows if not asked]
        return [(u, v) for u, v, asked in rows if asked and unit and kernels.Flow(unit).push(u, v, k) >= k]

    rows = inside.withColumn("asked", F.lit(True)).unionByName(positive.withColumn("asked", F.lit(False)))
    needless = by_group(rows, "nid", connected, "aid1 long, aid2 long")
    return queue.join(needless, ["aid1", "aid2"], "left_anti")


def sampled_pairs(items: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """About ``n`` distinct unordered pairs of items by hashes, without making all pairs.

    Each item meets the items that fall in its bucket in each of as many rounds as needed;
    buckets hold a few items.
    """
    count = max(1, items.count())
    per = max(1, round(2 * n / count))
    buckets = max(1, count // 3)
    rounds = items.select(F.col(column).alias("x")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(per)))).withColumn("b", F.pmod(F.xxhash64("x", "r", F.lit(seed)), F.lit(buckets)))
    one, two = rounds.select("r", "b", F.col("x").alias("a")), rounds.select("r", "b", F.col("x").alias("c"))
    return one.join(two, ["r", "b"]).where("a < c").select("a", "c").distinct().orderBy(F.xxhash64("a", "c", F.lit(seed))).limit(n)
