import random

import pytest
from pyspark.sql import functions as F

from pairwright.config import Config
from pairwright.operators.components import connected_components, spanning_forest
from pairwright.plans.infer import infer_reviews
from pairwright.sources.committed import CommittedTables, Conflict
from pairwright.streaming.reviews import ReviewState

LOG = "review_id long, aid1 long, aid2 long, evidence_decision string, meta_decision string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def log_of(spark, reviews, start=0):
    return spark.createDataFrame([(start + i, u, v, d, "null") for i, (u, v, d) in enumerate(reviews)], LOG)


def agrees(state, annots, log):
    """All tables of the state are what the batch plan makes of the whole log, and the forest spans the positive edges."""
    batch = infer_reviews(annots, log)
    assert rows(state.pcc.select("aid", "nid")) == rows(batch.pcc.select("aid", "nid"))
    columns = ["aid1", "aid2", "decision", "num_reviews"]
    assert rows(state.edges.select(columns)) == rows(batch.edges.select(columns))
    assert rows(state.neg_metagraph) == rows(batch.neg_metagraph)
    assert rows(state.inconsistent) == rows(batch.summary.where("n_neg_inside > 0").select("nid"))
    assert rows(state.pos_redundant) == rows(batch.pos_redundant.where("pos_redun").select("nid"))
    assert rows(state.neg_redundant) == rows(batch.neg_redundant)
    members = state.tables.read("members").select("aid", "nid")
    assert rows(members) == rows(batch.pcc.select("aid", "nid"))
    sizes = {r.nid: r["count"] for r in members.groupBy("nid").count().collect()}
    assert {r.nid: r.size for r in state.tables.read("flags").collect()} == sizes
    tree = state.edges.where("tree")
    assert tree.where("decision <> 'POSTV'").count() == 0 and tree.count() == sum(sizes.values()) - len(sizes)
    assert rows(connected_components(tree, nodes=annots)) == rows(batch.pcc.select("aid", "nid"))


def test_random_logs_in_batches(spark):
    rng, reviews, nodes = random.Random(5), [], []
    for world in range(25):
        own = [100 * world + i for i in range(rng.randint(2, 9))]
        nodes += own
        for _ in range(rng.randint(1, 26)):
            u, v = rng.sample(own, 2)
            reviews.append((u, v, rng.choice(["POSTV"] * 5 + ["NEGTV"] * 3 + ["INCMP", "UNKWN", "UNREV"])))
    rng.shuffle(reviews)
    annots, log = spark.createDataFrame([(n,) for n in nodes], "aid long"), log_of(spark, reviews).cache()
    state = ReviewState(annots, buckets=8)
    third = len(reviews) // 3
    for k in range(3):
        state.apply(log.where(F.least(F.floor(F.col("review_id") / third), F.lit(2)) == k), k)
    agrees(state, annots, log)


def test_large_batches_make_the_same_tables_anew(spark, monkeypatch):
    rng, reviews, nodes = random.Random(8), [], []
    for world in range(40):
        own = [100 * world + i for i in range(rng.randint(2, 9))]
        nodes += own
        for _ in range(rng.randint(1, 26)):
            u, v = rng.sample([*own, own[0] + 50], 2)
            reviews.append((u, v, rng.choice(["POSTV"] * 5 + ["NEGTV"] * 3 + ["INCMP", "UNKWN", "UNREV"])))
    rng.shuffle(reviews)
    annots, log = spark.createDataFrame([(n,) for n in nodes], "aid long"), log_of(spark, reviews).cache()
    everyone = annots.union(log.select(F.explode(F.array("aid1", "aid2")))).distinct()
    state = ReviewState(annots, buckets=8, renew_least=100)
    # Components with more than 5 edges go by rounds.
    monkeypatch.setattr("pairwright.operators.redundancy.KERNEL_EDGES", 5)
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    last, ways = len(reviews) - 20, []
    half = last // 2
    for k, (lo, hi) in enumerate(((0, half), (half, last), (last, len(reviews)))):
        spark.sparkContext.setJobGroup(f"batch {k}", "")
        state.apply(log.where(f"review_id >= {lo} AND review_id < {hi}"), k)
        ways.append(state.searched is None)
    assert ways == [True, True, False]
    assert max(jobs("batch 0"), jobs("batch 1")) < jobs("batch 2")
    agrees(state, everyone, log)


# Each batch: what it shows, and its reviews.
STEPS = [
    ("parts join; negatives between them, twice for one pair", [(0, 1, "POSTV"), (2, 3, "POSTV"), (4, 5, "POSTV"), (0, 2, "NEGTV"), (1, 3, "NEGTV"), (3, 4, "NEGTV")]),
    ("a merge makes a part inconsistent, its negatives to a third part move along", [(1, 2, "POSTV"), (0, 3, "POSTV"), (0, 2, "INCMP"), (3, 5, "NEGTV"), (5, 6, "POSTV")]),
    ("corrections make it consistent and redundant within; another part splits", [(1, 3, "POSTV"), (0, 2, "POSTV"), (5, 4, "NEGTV")]),
    ("everything is apart again, but for a new record that no annotation names", [(0, 1, "UNREV"), (1, 2, "NEGTV"), (0, 3, "INCMP"), (1, 3, "UNKWN"), (2, 3, "NEGTV"), (0, 2, "UNREV"), (5, 6, "NEGTV"), (3, 9, "POSTV"), (9, 0, "NEGTV")]),
]


def test_parts_join_and_fall_apart(spark):
    annots, log, state = spark.createDataFrame([(n,) for n in range(8)], "aid long"), [], None
    state = ReviewState(annots, buckets=4)
    for epoch, (_, reviews) in enumerate(STEPS):
        state.apply(log_of(spark, reviews, len(log)), epoch)
        log += reviews
        if epoch in (1, 3):
            everyone = annots.union(spark.createDataFrame([(9,)], "aid long")) if epoch == 3 else annots
            agrees(state, everyone, log_of(spark, log))


def changed(before, after, table):
    old, new = before["files"][table], after["files"][table]
    return {b for b in set(old) | set(new) if old.get(b) != new.get(b)}


def test_only_what_a_batch_touches_is_computed_and_written(spark):
    ring = [(100 * w + i, 100 * w + (i + 1) % 6, "POSTV") for w in range(12) for i in range(6)]
    annots = spark.createDataFrame([(100 * w + i,) for w in range(12) for i in range(6)], "aid long")
    state = ReviewState(annots, buckets=64)
    state.apply(log_of(spark, ring), 0)
    spare = state.edges.where("NOT tree AND aid1 < 6").first()
    before = state.tables.manifest
    # An edge outside the forest goes: no component is searched, no record gets another label.
    state.apply(log_of(spark, [(spare.aid1, spare.aid2, "UNREV")], 1000), 1)
    assert (state.searched, state.moved) == (0, 0)
    assert not changed(before, state.tables.manifest, "nodes") and not changed(before, state.tables.manifest, "members")
    assert len(changed(before, state.tables.manifest, "edges")) <= 2 and len(changed(before, state.tables.manifest, "flags")) == 1
    assert rows(state.pos_redundant.where("nid = 0")) == []
    # One inside it goes: its component falls in two. Another component's forest edge finds a replacement.
    inside, other = state.edges.where("tree AND aid1 < 6").first(), state.edges.where("tree AND aid1 BETWEEN 100 AND 106").first()
    before = state.tables.manifest
    state.apply(log_of(spark, [(inside.aid1, inside.aid2, "NEGTV"), (other.aid1, other.aid2, "INCMP")], 2000), 2)
    assert state.searched == 2 and 0 < state.moved < 6
    assert len(changed(before, state.tables.manifest, "nodes")) <= state.moved and len(changed(before, state.tables.manifest, "flags")) <= 3
    assert state.pcc.select("nid").distinct().count() == 13
    log = ring + [(spare.aid1, spare.aid2, "UNREV"), (inside.aid1, inside.aid2, "NEGTV"), (other.aid1, other.aid2, "INCMP")]
    agrees(state, annots, log_of(spark, log))


def test_of_two_writers_one_wins(spark, tmp_path):
    annots = spark.createDataFrame([(1,), (2,), (3,)], "aid long")
    one = ReviewState(annots, str(tmp_path / "s"), buckets=2)
    two = ReviewState(annots, str(tmp_path / "s"), buckets=2)
    commit = two.tables.commit
    # The other writer commits between this one's reading and its own commit.
    two.tables.commit = lambda *a: (one.apply(log_of(spark, [(1, 2, "POSTV")]), 0), commit(*a))
    with pytest.raises(Conflict):
        two.apply(log_of(spark, [(2, 3, "POSTV")]), 0)
    assert rows(ReviewState(annots, str(tmp_path / "s")).pcc) == [(1, 1), (2, 1), (3, 3)]


def test_unseen_records_and_committed_reviews(spark, tmp_path):
    annots, log = spark.createDataFrame([(1,), (2,)], "aid long"), log_of(spark, [(1, 2, "POSTV"), (2, 7, "POSTV")])
    assert rows(infer_reviews(annots, log).pcc) == [(1, 1), (2, 1), (7, 1)]
    with pytest.raises(Exception, match="no record 7"):
        infer_reviews(annots, log, Config(allow_unseen_nodes=False)).pcc.count()
    fixed = spark.createDataFrame([(1, 2)], "aid1 long, aid2 long")
    undo = log.union(log_of(spark, [(1, 2, "UNREV")], 10))
    assert rows(infer_reviews(annots, undo).edges.select("aid1", "decision")) == [(1, "UNREV"), (2, "POSTV")]
    with pytest.raises(Exception, match="committed"):
        infer_reviews(annots, undo, committed=fixed).edges.count()
    state = ReviewState(annots, str(tmp_path / "c"), buckets=2, committed=fixed)
    with pytest.raises(ValueError, match="committed"):
        state.apply(undo, 0)
    assert state.epoch == -1 and state.edges.count() == 0


def test_committed_tables(spark, tmp_path):
    make = lambda: CommittedTables(spark, str(tmp_path / "t"), {"t": ("k long, v string", "k"), "other": ("k long, v string", "k")}, 8)
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    a, b = make(), make()
    assert rows(a.read("t")) == []
    a.append("t", frame((1, "a"), (2, "b"), (3, None), (None, "n")), ["k"])
    with pytest.raises(Conflict):
        b.upsert("t", frame((1, "z")), ["k"])
    assert rows(b.read("t")) == [] and b.refresh().version == 0
    before = b.manifest
    b.upsert("t", frame((1, "z")), ["k"])
    assert len(changed(before, b.manifest, "t")) == 1 and not changed(before, b.manifest, "other")
    for repeated in (frame((3, "q")), frame((7, "x"), (7, "y"))):
        with pytest.raises(ValueError):
            b.append("t", repeated, ["k"])
    b.commit({"t": (["k"], frame((9, "i")), frame((2, "")).select("k"))}, {"note": 1})
    assert sorted(map(tuple, make().read("t").collect()), key=str) == sorted([(1, "z"), (3, None), (9, "i"), (None, "n")], key=str)
    assert make().manifest["notes"] == {"note": 1}


def test_spanning_forest_is_the_same_in_rounds_and_at_once(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(50)] + [(3, 3), (None, 4)], "aid1 long, aid2 long")
    rounds = rows(spanning_forest(edges))
    assert rounds == rows(spanning_forest(edges, at_once=1000)) == rows(spanning_forest(edges, at_once=15))
    whole = connected_components(edges)
    assert rows(connected_components(spark.createDataFrame(rounds, "aid1 long, aid2 long"), nodes=whole)) == rows(whole) == rows(connected_components(edges, at_once=1000))
    assert len(rounds) == whole.count() - whole.select("nid").distinct().count()
    assert spanning_forest(edges.limit(0)).count() == 0
