"""Steps that went wrong, or did work twice, on large tables only."""

from pyspark.sql import functions as F

from pairwright.catalogue import _labelled, _needless, _state
from pairwright.operators import graph, redundancy
from pairwright.operators.delta import grouping_delta, unjustified_splits
from pairwright.operators.groups import by_group
from pairwright.operators.search import not_locally_redundant
from pairwright.sources import fixtures as fx


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_stay_whole_when_a_join_before_them_is_broadcast_at_run_time(spark):
    # Spark expects 24 MB of keys, so that it plans a sort merge join, and finds ten rows.
    keys = spark.range(3_000_000).where("id < 10").select(F.col("id").alias("nid")).distinct()
    items = spark.range(4000).repartition(7).select((F.col("id") % 20).alias("nid1"), "id").withColumn("nid", F.col("nid1"))
    asked = items.join(keys, "nid", "left_semi").select("nid", "id")
    groups = by_group(asked, "nid", lambda nid, members: [(nid, len(members))], "nid long, n long")
    assert rows(groups) == [(i, 200) for i in range(10)]


def test_labels_are_looked_up_once(spark, sf):
    edges, pcc = _labelled(spark, sf)
    plain, _ = _state(spark, sf)
    for step in (graph.pcc_summary, redundancy.negative_redundancy, redundancy.positive_redundancy, redundancy.positive_augmentation):
        assert rows(step(edges, pcc)) == rows(step(plain, pcc))
    assert plan(graph.edges_inside(edges, pcc)).count("Join") == 0
    every = redundancy.flagged(plain, pcc, redundancy.positive_redundancy(plain, pcc), redundancy.negative_redundancy(plain, pcc))
    assert rows(_needless(edges, pcc).select("aid1", "aid2")) == rows(every.where("redundant AND decision = 'UNREV'").select("aid1", "aid2"))


def test_kernels_of_groups_make_no_frame_for_each(spark, sf):
    edges, pcc = _labelled(spark, sf)
    queue = edges.where("decision = 'UNREV'").select("aid1", "aid2", F.lit(0.5).alias("priority"))
    for made in (not_locally_redundant(queue, edges, pcc), redundancy.positive_augmentation(edges, pcc)):
        assert "FlatMapCoGroups" not in plan(made)


def test_splits_do_not_join_the_tables_of_the_delta_again(spark, sf):
    old = fx.order_annots(spark, sf).select(F.col("aid").alias("item"), F.col("orig_name_label").alias("id"))
    delta = grouping_delta(old, fx.order_pcc(spark, sf).select(F.col("aid").alias("item"), F.col("nid").alias("id")))
    assert "FullOuter" not in plan(unjustified_splits(delta, fx.order_edges(spark, sf)))
