"""Names for components with as few changes of names as possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.operators import kernels
from pairwright.operators.components import connected_components
from pairwright.operators.groups import by_group
from pairwright.session import staged


def trivial_names(names: DataFrame) -> DataFrame:
    """(nid, name) for components none of whose old names is in another: the commonest name, the least of equals.

    ``names``: (aid, nid, name), where a null name counts for nothing.
    """
    counts = names.where("name IS NOT NULL").groupBy("nid", "name").agg(F.count("*").alias("n"))
    shared = counts.groupBy("name").agg(F.count("*").alias("k")).where("k > 1")
    conflicted = counts.join(shared, "name", "left_semi").select("nid").distinct()
    free = counts.join(conflicted, "nid", "left_anti")
    best = F.row_number().over(Window.partitionBy("nid").orderBy(F.desc("n"), "name"))
    return free.withColumn("r", best).where("r = 1").select("nid", "name")


#: Ranges of component labels that are numbered apart.
RANGES = 4096


def rectified_names(names: DataFrame, prefix: str = "_extra_name") -> DataFrame:
    """(nid, name, is_extra): a name for every component; no two get the same.

    Components that share old names are solved together by an assignment whose profit is how
    often a component has a name, and one more; those that get none are given new names in the
    order of nid. Groups of such components are streamed through tasks, one at a time.
    """
    names = names.select("nid", F.col("name").cast("string").alias("name"))
    counts = staged(names.where("name IS NOT NULL").groupBy("nid", "name").agg(F.count("*").alias("n")), "name-counts")
    shared = counts.groupBy("name").agg(F.count("*").alias("k"), F.min("nid").alias("first")).where("k > 1").select("name", "first")
    ties = staged(counts.join(shared, "name").select("nid", "first"), "name-ties")
    groups = connected_components(ties, "nid", "first", node="nid", component="conflict")
    marked = staged(counts.join(groups, "nid", "left"), "name-groups")
    free = marked.where("conflict IS NULL").groupBy("nid").agg(F.min(F.struct((-F.col("n")).alias("k"), "name")).alias("b")).select("nid", F.col("b.name").alias("name"))

    def assign(_, group):
        rows, columns = sorted({r[0] for r in group}), sorted({r[1] for r in group})
        at, spot = {x: i for i, x in enumerate(rows)}, {x: j for j, x in enumerate(columns)}
        profit = [{} for _ in rows]
        for nid, name, n in group:
            profit[at[nid]][spot[name]] = n + 1
        return [(nid, columns[j]) for nid, j in zip(rows, kernels.sparse_assignment(profit, len(columns)), strict=True) if j is not None]

    solved = by_group(marked.where("conflict IS NOT NULL").select("conflict", "nid", "name", "n"), "conflict", assign, "nid long, name string")
    done = staged(free.unionByName(solved), "names-done")
    lacking = staged(names.select("nid").distinct().join(done, "nid", "left_anti"), "names-lacking")
    extra = _numbered(lacking).select("nid", F.concat(F.lit(prefix), F.col("i").cast("string")).alias("name"), F.lit(True).alias("is_extra"))
    return done.withColumn("is_extra", F.lit(False)).unionByName(extra)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with their place ``i`` in the order of nid, counted in ranges so that none is a task for all."""
    ends = rows.agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).first()
    low = ends["lo"] or 0
    width = max(1, -(-((ends["hi"] or 0) - low + 1) // RANGES))
    rows = rows.withColumn("_b", F.floor((F.col("nid") - low) / width))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("nid")) - 1
    return rows.withColumn("_i", inside).join(F.broadcast(before), "_b").select("nid", (F.col("_i") + F.col("_before")).alias("i"))
