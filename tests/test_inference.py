import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pairwright.config import Config
from pairwright.functions import tags
from pairwright.operators import candidates, feedback, graph, rectify, search, truth
from pairwright.operators.delta import grouping_delta, unjustified_splits
from pairwright.plans.infer import infer, infer_reviews
from pairwright.sources import tables
from pairwright.streaming.reviews import ReviewState, latest_stream

LOG = "review_id long, aid1 long, aid2 long, evidence_decision string, meta_decision string"
EDGES = "aid1 long, aid2 long, decision string, num_reviews double, prob_match double, confidence string"
WORLDS, STRIDE = 60, 100


def reviews_of(seed):
    """A random log over a few records: (review_id, aid1, aid2, evidence, meta) in order."""
    rng = random.Random(seed)
    nodes = list(range(rng.randint(2, 8)))
    log = []
    for i in range(rng.randint(1, 18)):
        u, v = sorted(rng.sample(nodes, 2))
        evidence = rng.choice(["POSTV"] * 4 + ["NEGTV"] * 2 + ["INCMP", "UNKWN", "UNREV"])
        meta = rng.choice(["null"] * 6 + (["same"] if evidence != "NEGTV" else []) + (["diff"] if evidence != "POSTV" else []))
        log.append((i, u, v, evidence, meta))
    return nodes, log


def parts_of(nodes, positive):
    """Each record's component: all that paths of positive edges reach."""
    label = {}
    for n in nodes:
        if n not in label:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = n
                    todo += [b if a == x else a for a, b in positive if x in (a, b)]
    return label


def plain_inference(nodes, log):
    """Decisions, components and states of edges, straight from the rules."""
    decision = {}
    for _, u, v, evidence, meta in log:
        open_ = evidence in ("INCMP", "UNKWN", "UNREV")
        decision[u, v] = {"same": "POSTV", "diff": "NEGTV"}.get(meta, evidence) if open_ else evidence
    label = parts_of(nodes, [e for e, d in decision.items() if d == "POSTV"])
    negative = [e for e, d in decision.items() if d == "NEGTV"]
    bad = {label[u] for u, v in negative if label[u] == label[v]}
    apart = {frozenset((label[u], label[v])) for u, v in negative}
    state = {}
    for (u, v), d in decision.items():
        a, b = label[u], label[v]
        if a == b:
            state[u, v] = "inconsistent_internal" if a in bad else "same"
        elif a in bad or b in bad:
            state[u, v] = "inconsistent_external"
        elif frozenset((a, b)) in apart:
            state[u, v] = "diff"
        else:
            state[u, v] = d if d in ("INCMP", "UNKWN") else None
    return decision, label, state


@pytest.fixture(scope="module")
def world(spark):
    """All logs in one graph, each with ids of its own."""
    nodes, rows = [], []
    for seed in range(WORLDS):
        own, log = reviews_of(seed)
        at = STRIDE * seed
        nodes += [(at + n,) for n in own]
        rows += [(at + r, at + u, at + v, d, m) for r, u, v, d, m in log]
    return spark.createDataFrame(nodes, "aid long"), spark.createDataFrame(rows, LOG)


def test_states_equal_the_rules(world):
    annots, log = world
    got = infer_reviews(annots, log)
    states = {(r.aid1, r.aid2): (r.decision, r.inferred_state) for r in got.states.collect()}
    labels = {r.aid: r.nid for r in got.pcc.collect()}
    want, parts = {}, {}
    for seed in range(WORLDS):
        decision, label, state = plain_inference(*reviews_of(seed))
        at = STRIDE * seed
        want |= {(at + u, at + v): (d, state[u, v]) for (u, v), d in decision.items()}
        parts |= {at + n: at + x for n, x in label.items()}
    assert states == want and labels == parts
    assert {s for _, s in states.values()} == {"same", "diff", "inconsistent_internal", "inconsistent_external", "INCMP", "UNKWN", None}


def test_suspected_errors_equal_brute_force(spark):
    rng = random.Random(17)
    rows, want = [], set()
    for seed in range(40):
        at, n = 50 * seed, rng.randint(3, 7)
        pairs = list(combinations(range(n), 2))
        edges = {e: (rng.choice(["POSTV", "POSTV", "NEGTV", "UNREV"]), rng.randint(0, 4), rng.choice([None, "not_sure", "absolutely_sure"])) for e in rng.sample(pairs, rng.randint(2, len(pairs)))}
        weight = {e: r + {None: 0.0, "not_sure": 0.2, "absolutely_sure": 4.0}[c] for e, (_, r, c) in edges.items()}
        positive = [e for e, (d, *_) in edges.items() if d == "POSTV"]
        label = parts_of(range(n), positive)
        rows += [(at + u, at + v, d, float(r), None, c) for (u, v), (d, r, c) in edges.items()]
        found = {}
        for s, t in sorted(e for e, (d, *_) in edges.items() if d == "NEGTV" and label[e[0]] == label[e[1]]):
            own = [e for e in positive if label[e[0]] == label[s]]
            others = [x for x in range(n) if label[x] == label[s] and x not in (s, t)]
            sides = [{t, *extra} for k in range(len(others) + 1) for extra in combinations(others, k)]
            crossing = lambda side, own=own: [e for e in own if (e[0] in side) != (e[1] in side)]
            cost = lambda side: round(sum(weight[e] for e in crossing(side)), 9)
            least = min(map(cost, sides))
            if weight[s, t] < least - 1e-9:
                found[s, t] = "POSTV"
            else:
                found |= dict.fromkeys(crossing(min((x for x in sides if cost(x) == least), key=len)), "NEGTV")
        want |= {(at + label[u], at + u, at + v, h) for (u, v), h in found.items()}
    annots = spark.createDataFrame([(50 * seed + i,) for seed in range(40) for i in range(7)], "aid long")
    assert {tuple(r) for r in infer(annots, spark.createDataFrame(rows, EDGES)).errors.collect()} == want


def test_fragment_links_span_what_can_be_linked(spark):
    rng = random.Random(23)
    names, rows, worlds = [], [], []
    for w in range(60):
        at, n = 50 * w, rng.randint(1, 7)
        share = rng.choice([0.1, 0.4, 0.8, 1.0])
        edges = {e: rng.choice(["POSTV", "NEGTV", "NEGTV", "INCMP", "UNREV", "UNKWN"]) for e in combinations(range(n), 2) if rng.random() < share}
        names += [(at + i, w) for i in range(n)]
        rows += [(at + u, at + v, d) for (u, v), d in edges.items()]
        worlds.append((at, n, edges))
    # Edges that leave their name change nothing.
    rows += [(50 * w, 50 * w + 50, "POSTV") for w in range(59)]
    got = defaultdict(list)
    for r in candidates.fragment_links(spark.createDataFrame(names, "aid long, name long"), spark.createDataFrame(rows, EDGES.split(", num")[0])).collect():
        got[r.name].append((r.aid1 - 50 * r.name, r.aid2 - 50 * r.name))
    for w, (_, n, edges) in enumerate(worlds):
        positive = [e for e, d in edges.items() if d == "POSTV"]
        open_ = [e for e in combinations(range(n), 2) if edges.get(e) not in ("NEGTV", "INCMP")]
        before, after = parts_of(range(n), positive), parts_of(range(n), positive + got[w])
        assert set(got[w]) <= set(open_) and after == parts_of(range(n), positive + open_)
        assert len(got[w]) == len(set(before.values())) - len(set(after.values()))


def test_unreviews_undo_and_commits_stay(spark):
    rng = random.Random(5)
    log = [(i, 1, rng.randint(2, 6), rng.choice(["POSTV", "NEGTV", "UNREV"]), "null") for i in range(60)]
    reviews = spark.createDataFrame(log, LOG)
    want, items = [], defaultdict(list)
    for r in log:
        if r[3] == "UNREV":
            items[r[2]].clear()
        items[r[2]].append(r[0])
    want = sorted(i for x in items.values() for i in x)
    assert sorted(r.review_id for r in feedback.effective(reviews).collect()) == want
    undone = next(r for r in log if r[3] == "UNREV")
    with pytest.raises(Exception, match="cannot be undone"):
        feedback.effective(reviews, spark.createDataFrame([(1, undone[2])], "aid1 long, aid2 long")).collect()
    assert feedback.effective(reviews, spark.createDataFrame([(8, 9)], "aid1 long, aid2 long")).count() == len(want)
    committed = spark.createDataFrame([(i,) for i in range(10)], "review_id long")
    assert sorted(r.review_id for r in feedback.reset_feedback(reviews, committed).collect()) == list(range(10))
    blank = feedback.with_defaults(spark.createDataFrame([(1, 1, 2, None, None)], LOG)).first()
    assert (blank.evidence_decision, blank.meta_decision, blank.confidence) == ("UNREV", "null", "unspecified")
    annots = spark.createDataFrame([(3, 7, 8)], "aid long, name_label long, orig_name_label long")
    assert feedback.reset_names(annots).first().name_label == 8 and feedback.cleared_names(annots).first().name_label == -3
    edges = spark.createDataFrame([(1, 2, "POSTV", 3)], "aid1 long, aid2 long, decision string, num_reviews int")
    assert tuple(feedback.cleared_edges(edges).first()) == (1, 2, "UNREV", None)


def test_node_attributes_and_ensured_edges(spark):
    nodes = spark.createDataFrame([(1, "x"), (2, None)], "aid long, k string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "aid long")
    got = graph.attributes(asked, nodes, "k", on_missing="default", on_keyerr="filter", default="d", keys=("aid",)).collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (3, "d")]
    assert sorted(map(tuple, graph.present(asked, nodes, ("aid",)).collect())) == [(1, True), (2, True), (3, False)]
    assert [tuple(r) for r in graph.with_value(nodes, "k", ("aid",)).collect()] == [(1, "x")]
    assert sorted(map(tuple, graph.without_attribute(nodes, "k", asked.where("aid = 1"), ("aid",)).collect())) == [(1, None), (2, None)]
    names = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "aid long, name long")
    edges = spark.createDataFrame([(1, 2, "POSTV")], "aid1 long, aid2 long, decision string")
    pairs = lambda df: sorted((r.aid1, r.aid2) for r in df.collect())
    assert pairs(candidates.ensure_cliques(names, edges)) == pairs(candidates.ensure_full(names, edges)) == [(1, 2), (1, 3), (2, 3)]
    assert pairs(candidates.ensure_mst(names, edges)) == [(1, 2), (1, 3)]
    guessed = candidates.ensure_mst(names, edges.withColumns({"num_reviews": F.lit(2), "meta_decision": F.lit("null")}).union(spark.createDataFrame([(2, 3, "UNREV", 0, "null")], "aid1 long, aid2 long, decision string, num_reviews int, meta_decision string")))
    assert sorted((r.aid1, r.aid2, r.decision, r.num_reviews, r.meta_decision, r.confidence, r.user_id) for r in guessed.collect()) == [(1, 2, "POSTV", 2, "null", None, None), (1, 3, "POSTV", 1, "same", "guessing", "algo:mst"), (2, 3, "UNREV", 0, "null", None, None)]
    assert {r.decision for r in candidates.ensure_cliques(names, edges, "same").collect()} == {"POSTV"}
    with pytest.raises(ValueError):
        candidates.ensure_cliques(names, edges, "diff")


def test_truth(spark):
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "aid long, name string")
    pairs = spark.createDataFrame([(1, 2, True), (1, 3, True), (2, 3, False), (1, 9, True)], "aid1 long, aid2 long, c boolean")
    got = {(r.aid1, r.aid2): (r.truth, r.POSTV, r.NEGTV, r.INCMP) for r in truth.match_state(pairs, names, "c").collect()}
    assert got == {(1, 2): ("POSTV", 1, 0, 0), (1, 3): ("NEGTV", 0, 1, 0), (2, 3): ("INCMP", 0, 0, 1), (1, 9): (None, None, None, None)}
    edges = spark.createDataFrame([(1, 3, ["Photobomb"]), (2, 3, []), (1, 2, ["photobomb"])], "aid1 long, aid2 long, tags array<string>")
    assert sorted(map(tuple, truth.photobomb_samples(edges, names).collect())) == [(1, 3, True), (2, 3, False)]


def test_tag_predicates(spark):
    rows = [(0, ["ab", "AB"]), (1, ["ab", "c"]), (2, []), (3, None), (4, ["xab"])]
    df = spark.createDataFrame(rows, "i int, tags array<string>")
    hits = lambda **k: [r.i for r in df.where(tags.tag_filter(F.col("tags"), **k)).orderBy("i").collect()]
    assert hits(min_num=2) == [1] and hits(max_num=0) == [2, 3]
    assert hits(any_match="A.") == [0, 1] and hits(none_match=["ab", "x"]) == [2, 3]
    assert hits(any_endswith="B") == [0, 1, 4] and hits(in_any="a") == [0, 1, 4] and hits(has_all=["ab", "c"]) == [1]
    assert hits() == [0, 1, 2, 3, 4] and hits(logic="or") == [] and hits(logic="or", min_num=2, max_num=0) == [1, 2, 3]


def test_search_says_when_it_stops(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "aid1 long, aid2 long")
    start = spark.createDataFrame([(0,)], "aid long")
    assert search.reached(chain, start).count() == 7 and search.reached(chain, start, most_steps=6).count() == 7
    with pytest.raises(RuntimeError, match="more than 5"):
        search.reached(chain, start, most_steps=5)
    assert search.shortest_path(chain, 1, 5) == [1, 2, 3, 4, 5] and search.shortest_path(chain, 1, 99) == []
    assert search.reached(chain, start.limit(0)).count() == 0


def test_contradiction_and_self_edge_are_errors(spark):
    log = spark.createDataFrame([(1, 1, 2, "NEGTV", "same")], LOG)
    with pytest.raises(Exception, match="contradicts"):
        graph.latest_reviews(log).collect()
    with pytest.raises(Exception, match="self edge"):
        tables.from_pairs(spark, [(3, 3)]).collect()


def test_attribute_policies(spark):
    edges = spark.createDataFrame([(1, 2, "x"), (3, 4, None)], "aid1 long, aid2 long, k string")
    asked = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "aid1 long, aid2 long")
    got = lambda **p: sorted(map(tuple, graph.attributes(asked, edges, "k", **p).collect()))
    assert got(on_missing="default", on_keyerr="default", default="d") == [(1, 2, "x"), (3, 4, "d"), (5, 6, "d")]
    assert got(on_missing="filter", on_keyerr="filter") == [(1, 2, "x")]
    with pytest.raises(Exception, match="no edge"):
        got()
    with pytest.raises(Exception, match="no value"):
        got(on_missing="filter", on_keyerr="error")


def test_grouping_delta(spark):
    rows = lambda groups: spark.createDataFrame([(x, i) for i, g in enumerate(groups) for x in g], "item long, id long")
    old, new = rows([[1, 2], [3, 4, 5], [6], [7], [8, 9, 10], [11]]), rows([[1, 2], [3, 4], [5], [6, 7], [8, 9, 12], [10]])
    kinds = {r.item: r.kind for r in grouping_delta(old, new).collect()}
    assert kinds == {1: "unchanged", 2: "unchanged", 3: "split", 4: "split", 5: "split", 6: "merge", 7: "merge", 8: "split", 9: "split", 10: "split", 11: "removed", 12: "added"}
    mixed = {r.item: r.kind for r in grouping_delta(rows([[1, 2, 3], [4, 5]]), rows([[1, 2], [3, 4], [5]])).collect()}
    assert mixed == {1: "hybrid", 2: "hybrid", 3: "hybrid", 4: "hybrid", 5: "hybrid"} or mixed[3] == mixed[4] == "hybrid"


def test_all_pairs_of_parts_need_a_reason(spark):
    old, new = (spark.createDataFrame(list(zip(range(1, 5), ids)), "item long, id long") for ids in ((1, 1, 1, 1), (1, 2, 3, 3)))
    edges = spark.createDataFrame([(1, 2, "NEGTV"), (2, 3, "INCMP"), (3, 4, "NEGTV")], "aid1 long, aid2 long, decision string")
    assert [tuple(r) for r in unjustified_splits(grouping_delta(old, new), edges).collect()] == [(1, 1, 3)]


def test_names(spark):
    groups = [["a", "a", "b"], ["c"], ["b", "b"], [None], ["d", "e"], ["e"]]
    rows = [(100 * i + j, i, x) for i, g in enumerate(groups) for j, x in enumerate(g)]
    names = spark.createDataFrame(rows, "aid long, nid long, name string")
    assert {tuple(r) for r in rectify.trivial_names(names).collect()} == {(1, "c")}
    got = {r.nid: (r.name, r.is_extra) for r in rectify.rectified_names(names).collect()}
    assert len({n for n, _ in got.values()}) == len(groups)
    assert {i: n for i, (n, _) in got.items() if i != 3} == {0: "a", 1: "c", 2: "b", 4: "d", 5: "e"} and got[3] == ("_extra_name0", True)


def test_tables(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, 2, "POSTV", "null", "user:a", "not_sure", ["x", "y"]), (2, 1, 3, "UNREV", "same", "algo:b", "unspecified", [])], "review_id long, aid1 long, aid2 long, evidence_decision string, meta_decision string, user_id string, confidence string, tags array<string>")
    rows = tables.to_staging(log)
    assert sorted(map(tuple, tables.read_staging(rows).collect())) == sorted(map(tuple, log.select("review_id", "aid1", "aid2", "evidence_decision", "meta_decision", "user_id", "confidence", "tags").collect()))
    path = str(tmp_path / "staging")
    tables.append(rows, path)
    with pytest.raises(ValueError):
        tables.append(rows, path)
    both = spark.createDataFrame([(1, 2, 1, "NEGTV", ["a"]), (2, 1, 2, None, ["b"]), (5, 4, 3, "POSTV", ["c"])], "aid1 long, aid2 long, rowid long, evidence_decision string, tags array<string>")
    assert sorted(map(tuple, tables.undirected(both).collect())) == [(1, 2, 1, "NEGTV", ["a", "b"]), (4, 5, 3, "POSTV", ["c"])]


def test_stateful_stream(spark, tmp_path):
    log = spark.createDataFrame([(i, i % 3, 5, ["POSTV", "NEGTV"][i % 2], "null") for i in range(12)], LOG)
    log.where("review_id < 6").coalesce(1).write.parquet(str(tmp_path / "in"))
    log.where("review_id >= 6").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = latest_stream(stream).writeStream.outputMode("update").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = {(r.aid1, r.aid2): (r.review_id, r.num_reviews) for r in spark.sql("SELECT aid1, aid2, max(review_id) AS review_id, max(num_reviews) AS num_reviews FROM latest GROUP BY aid1, aid2").collect()}
    assert got == {(0, 5): (9, 4), (1, 5): (10, 4), (2, 5): (11, 4)}


def test_state_goes_on_after_a_restart(spark, tmp_path):
    annots = spark.createDataFrame([(i,) for i in range(5)], "aid long")
    log = spark.createDataFrame([(1, 0, 1, "POSTV", "null"), (2, 1, 2, "POSTV", "null"), (3, 0, 1, "NEGTV", "null")], LOG)
    first = ReviewState(annots, str(tmp_path / "state"))
    first.apply(log.where("review_id < 3"), 0)
    again = ReviewState(annots, str(tmp_path / "state"))
    again.apply(log.where("review_id < 3"), 0)
    again.apply(log.where("review_id = 3"), 1)
    assert sorted((r.aid1, r.aid2, r.decision, r.num_reviews) for r in again.edges.collect()) == [(0, 1, "NEGTV", 2), (1, 2, "POSTV", 1)]
    assert sorted(map(tuple, again.pcc.collect())) == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 4)]


def test_config():
    c = Config().with_params(**{"redun.pos": 3})
    assert c.subparams("redun") == {"enabled": True, "pos": 3, "neg": 2, "enforce_pos": True, "enforce_neg": True, "neg_only_auto": True}
