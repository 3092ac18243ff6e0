"""The queue without and with the insides of components, and what reviewers are asked."""

from pairwright.operators import graph, priority


def _state(spark):
    pcc = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "aid long, nid long")
    edges = spark.createDataFrame(
        [(1, 2, "POSTV", "not_sure", 1, 0.9), (1, 3, "UNREV", None, 0, None), (2, 3, "POSTV", "guessing", 2, 0.8), (3, 4, "UNREV", None, 0, 0.4), (4, 5, "POSTV", "not_sure", 1, 0.7)],
        "aid1 long, aid2 long, decision string, confidence string, num_reviews long, prob_match double",
    )
    return edges, pcc


def _rows(df):
    return sorted(tuple(r) for r in df.select("aid1", "aid2", "priority").collect())


def test_insides_leave_and_come_back(spark):
    edges, pcc = _state(spark)
    nids = spark.createDataFrame([(1,)], "nid long")
    queue = priority.queue(edges, edges.limit(0), edges.limit(0))
    assert _rows(queue) == [(1, 3, priority.NO_SCORE), (3, 4, 0.4)]
    left = priority.without_internal(queue, pcc, nids)
    assert _rows(left) == [(3, 4, 0.4)]
    assert _rows(priority.with_internal(left, edges, pcc, nids)) == _rows(queue)
    assert _rows(priority.with_internal(queue, edges, pcc, nids)) == _rows(queue)
    assert _rows(priority.skipped(queue, edges.where("aid1 = 3"))) == [(1, 3, priority.NO_SCORE)]
    assert _rows(priority.reinstated(queue.limit(0), edges.where("aid1 = 3"))) == [(3, 4, 0.4)]


def test_requests(spark):
    edges, pcc = _state(spark)
    queue = priority.queue(edges, edges.limit(0), edges.limit(0))
    got = [tuple(r) for r in priority.requests(queue, edges, pcc, 1).collect()]
    assert got == [(3, 4, 0.4, 1, 4, "UNREV", None, 0, 2, 2)]
    assert priority.requests(queue.limit(0), edges, pcc, 5).count() == 0


def test_members_and_complete(spark):
    edges, pcc = _state(spark)
    asked = spark.createDataFrame([(5,), (5,), (9,), (None,)], "aid long")
    assert sorted(tuple(r) for r in graph.members_of(asked, pcc).collect()) == [(5, 4), (5, 5)]
    twice = edges.union(edges)
    assert dict(graph.complete(twice, pcc).collect()) == {1: True, 4: True}
    assert dict(graph.complete(edges.where("aid1 <> 2"), pcc).collect()) == {1: False, 4: True}
