from pairwright.sources.committed import CommittedTables
from pairwright.streaming import reviews


def test_tables_of_a_batch_are_not_broadcast(spark, tmp_path):
    """Compressed ids are far smaller than their rows, so that their size says nothing of what the driver would get."""
    t = CommittedTables(spark, str(tmp_path / "t"), {"nodes": ("aid long, nid long", "aid")}, 4)
    t.upsert("nodes", spark.range(100).selectExpr("id AS aid", "id AS nid"), ["aid"])
    keys = reviews.staged(spark.range(50).toDF("aid"), "keys")
    found = t.matching("nodes", keys)
    both = found.join(keys.groupBy("aid").count(), "aid", "left").join(t.read("nodes").toDF("aid", "other"), "aid")
    assert both.count() == 50
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
