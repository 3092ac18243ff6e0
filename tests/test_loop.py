import pytest
from pyspark.sql import functions as F

from pairwright.config import Config
from pairwright.operators import actions, delta, graph, metrics, priority, simulate
from pairwright.plans.infer import infer, with_measures
from pairwright.plans.loop import ReviewLoop


def test_generated_graphs(spark):
    annots, edges = simulate.generated(spark, n_pccs=20, p_incon=0.3, p_pair_unrev=0.2, seed=3)
    i = infer(annots, with_measures(edges))
    assert annots.count() == 100 and i.pcc.select("nid").distinct().count() == 20
    assert metrics.bad_edges(edges).count() == metrics.not_disjoint(edges).count() == 0
    bad = edges.where("decision = 'NEGTV' AND truth = 'POSTV'").count()
    assert i.summary.where("NOT is_consistent").count() == bad > 0
    assert metrics.meta_violations(edges, i.pcc).count() == 0
    k = simulate.generated(spark, n_pccs=9, size=7, pos_redun=(2,), p_pair_neg=0.0, p_pair_incmp=0.0)
    assert {r.pos_redun for r in infer(k[0], with_measures(k[1])).pos_redundant.collect()} == {True}


def test_probabilities_sum_to_one(spark):
    _, edges = simulate.generated(spark, seed=1)
    for r in simulate.simulated_probs(edges).collect():
        assert abs(r.POSTV + r.NEGTV + r.INCMP - 1) < 1e-9 and r[r.truth] > 0.5


def test_loop_finds_the_truth(spark):
    annots, edges = simulate.generated(spark, n_pccs=6, size=4, p_incon=0.5, p_pair_neg=0.2, p_pair_incmp=0.0, p_pair_unrev=0.5, pos_redun=(1,), seed=5)
    truth = annots.select(F.col("aid").alias("a"), F.col("name_label").alias("n"))

    def true(pairs):
        rows = pairs.join(truth.toDF("aid1", "n1"), "aid1").join(truth.toDF("aid2", "n2"), "aid2")
        return rows.withColumn("truth", F.when(F.col("n1") == F.col("n2"), "POSTV").otherwise("NEGTV"))

    loop = ReviewLoop(annots, edges.drop("truth"), lambda p: simulate.simulated_probs(true(p)), lambda p: true(p).select("aid1", "aid2", F.col("truth").alias("decision"), F.lit("absolutely_sure").alias("confidence")), Config(thresholds={"POSTV": 0.9, "NEGTV": 0.9, "INCMP": 0.9}))
    history = loop.run()
    assert {h["phase"] for h in history} >= {"ranking", "recovery", "positive"}
    found = {frozenset(r.m) for r in loop.inference.pcc.groupBy("nid").agg(F.collect_list("aid").alias("m")).collect()}
    assert found == {frozenset(r.m) for r in annots.groupBy("name_label").agg(F.collect_list("aid").alias("m")).collect()}
    assert loop.inference.summary.where("NOT is_consistent").count() == 0
    assert loop.inference.pos_redundant.where("NOT pos_redun").count() == 0


def test_hard_cases_are_asked_once_and_confident_ones_never(spark):
    annots = spark.createDataFrame([(i,) for i in range(1, 7)], "aid long")
    edges = spark.createDataFrame([(1, 2, "POSTV", "guessing"), (2, 3, "POSTV", "absolutely_sure"), (3, 4, "NEGTV", "guessing"), (5, 6, "NEGTV", "pretty_sure"), (1, 5, "UNREV", None)], "aid1 long, aid2 long, decision string, confidence string")
    asked = []

    def oracle(pairs):
        asked.extend(sorted((r.aid1, r.aid2) for r in pairs.collect()))
        return pairs.select("aid1", "aid2", F.when(F.col("aid1") == 3, "POSTV").otherwise("NEGTV").alias("decision"), F.lit("absolutely_sure").alias("confidence"))

    verifier = lambda p: p.select("aid1", "aid2", F.lit(0.5).alias("POSTV"), F.lit(0.3).alias("NEGTV"), F.lit(0.2).alias("INCMP"))
    off = dict(ranking_enabled=False, redun_enabled=False, autoreview_enabled=False, algo_hardcase=True)
    loop = ReviewLoop(annots, edges, verifier, oracle, Config(queue_conf_thresh="pretty_sure", **off))
    assert loop.run() == [{"phase": "hardcase", "reviews": 2}] and sorted(set(asked)) == [(1, 2), (3, 4)]
    assert {(r.aid1, r.aid2): r.decision for r in loop.inference.edges.collect()} == {(1, 2): "NEGTV", (2, 3): "POSTV", (3, 4): "POSTV", (5, 6): "NEGTV", (1, 5): "UNREV"}
    with pytest.raises(ValueError):
        ReviewLoop(annots, edges, verifier, oracle, Config(algo_hardcase=True)).run()


def test_filters_of_the_queue(spark):
    pcc = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "aid long, nid long")
    edges = spark.createDataFrame([(1, 2, "POSTV", "pretty_sure"), (2, 3, "POSTV", "guessing"), (3, 4, "NEGTV", "absolutely_sure"), (4, 5, "POSTV", "pretty_sure")], "aid1 long, aid2 long, decision string, confidence string")
    queue = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.4), (3, 4, 0.3), (2, 4, 0.2), (4, 5, 11.0)], "aid1 long, aid2 long, priority double")
    kept = lambda **how: sorted((r.aid1, r.aid2) for r in priority.filtered(queue, edges, pcc, **how).collect())
    assert kept() == [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)]
    assert kept(conf_thresh="pretty_sure") == [(1, 3), (2, 4), (4, 5)]
    assert kept(conf_thresh="guessing") == [(2, 4), (4, 5)]
    assert kept(mode="split") == [(1, 2), (1, 3), (4, 5)] and kept(mode="merge") == [(2, 4), (3, 4)]
    preds = spark.createDataFrame([(1, 3, "NEGTV"), (3, 4, "NEGTV"), (2, 4, "POSTV"), (4, 5, "POSTV")], "aid1 long, aid2 long, pred string")
    assert kept(mode="predict", preds=preds) == [(1, 3), (2, 4), (4, 5)]


def test_review_actions(spark):
    pcc = lambda groups: spark.createDataFrame([(x, min(g)) for g in groups for x in g], "aid long, nid long")
    changed = spark.createDataFrame([(1, 2, "POSTV"), (3, 4, "NEGTV"), (5, 6, "NEGTV"), (7, 8, "POSTV"), (1, 5, "UNKWN")], "aid1 long, aid2 long, decision string")
    got = {(r.aid1, r.aid2): (r.side, r.action) for r in actions.review_actions(pcc([[1], [2], [3, 4], [5], [6], [7, 8]]), pcc([[1, 2], [3], [4], [5], [6], [7, 8]]), changed).collect()}
    assert got == {(1, 2): ("between", "merge"), (3, 4): ("within", "split"), (5, 6): ("between", "neg-evidence"), (7, 8): ("within", "pos-evidence"), (1, 5): ("between", "other-evidence")}


def test_edge_sets(spark):
    edges = spark.createDataFrame([(1, 2, "POSTV"), (2, 3, "NEGTV"), (3, 4, "POSTV"), (1, 4, "UNREV")], "aid1 long, aid2 long, decision string")
    nodes = lambda *x: spark.createDataFrame([(i,) for i in x], "aid long")
    pairs = lambda df: sorted((r.aid1, r.aid2) for r in df.collect())
    assert pairs(graph.edges_between(edges, nodes(1, 2, 3))) == [(1, 2), (2, 3)]
    assert pairs(graph.edges_between(edges, nodes(1, 2), nodes(2, 3))) == [(1, 2), (2, 3)]
    assert pairs(graph.edges_outgoing(edges, nodes(1, 2))) == [(1, 4), (2, 3)]
    a, e = graph.removed_nodes(nodes(1, 2, 3, 4), edges, nodes(2))
    assert a.count() == 3 and pairs(e) == [(1, 4), (3, 4)]
    assert pairs(graph.subgraph(nodes(1, 2, 3, 4), edges, nodes(3, 4))[1]) == [(3, 4)]


def test_names_without_known_records_are_left_out(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, None), (5, "b")], "aid long, name string")
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c"), (4, "c"), (5, "d")], "aid long, name string")
    every = {(2, None, "a"), (3, None, "c"), (4, None, "c"), (5, "b", "d")}
    assert set(map(tuple, delta.name_delta(old, new).collect())) == every
    assert set(map(tuple, delta.name_delta(old, new, ignore_unknown=True).collect())) == {(2, None, "a"), (5, "b", "d")}


def test_sizes_by_kind(spark):
    rows = [(1, 1, 10, "split"), (2, 1, 11, "split"), (3, 1, 11, "split"), (4, None, 12, "added"), (5, 2, None, "removed")]
    df = spark.createDataFrame(rows, "item long, old_id long, new_id long, kind string")
    got = {(r.kind, r.side): tuple(r)[2:] for r in delta.delta_sizes(df).collect()}
    assert got == {("split", "old"): (1, 3, 3, 3, 3.0), ("split", "new"): (2, 3, 1, 2, 1.5), ("added", "new"): (1, 1, 1, 1, 1.0), ("removed", "old"): (1, 1, 1, 1, 1.0)}
    assert delta.delta_sizes(df.limit(0)).count() == 0
