import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.llm.clustering import Tree, cluster_vectors, nearest
from pairwright.llm.queries import ORACLES, QUERIES

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k, rounds, dim, scale=256):
    """(rows in COLUMNS order, sorted) by comparing each vector with each centroid in Python integers."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        found = [min((gap(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, found, strict=True) if m == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    by = [sum(d for d, m in found if m == n) for n in range(len(centroids))]
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, m, d, by[m], sum(by), text[m]) for (i, _), (d, m) in zip(kept, found, strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_query_equals_brute_force_and_sql(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = got(QUERIES["op11_centroid_clustering"](spark, sf))
    assert found == brute(rows, 40, 5, 64)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    assert found == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_centroid_clustering']})").fetchall(), key=str)


def test_odd_rows(spark):
    one, nan, inf = [0.5, 0.25, -0.1], float("nan"), float("inf")
    rows = [(1, one, "x"), (1, one, "y"), (2, None, "x"), (3, [], "x"), (4, [1.0, 2.0], "x"), (5, [1.0, None, 2.0], "x"), (6, [nan, 0.0, 0.0], "x"), (7, [inf, 0.0, 0.0], "x"), (8, [-inf, 0.0, 0.0], "x"), (None, [0.0, 0.0, 0.0], "x"), (9, [9.0, 9.0, 9.0], None), (10, [9.0, 9.0, 9.0], "z"), (11, [0.5, 0.0, 1e3], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    plain = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows]
    for k, tree in ((2, 2), (3, 3), (40, 2048)):
        assert got(cluster_vectors(df, k, 3, 3, tree_rows=tree)) == brute(plain, k, 3, 3)
    assert cluster_vectors(df.limit(0), 2, 3, 3).columns == COLUMNS and cluster_vectors(df.limit(0), 2, 3, 3).count() == 0
    other = df.withColumnRenamed("vec_id", "h").withColumnRenamed("embedding", "ids").withColumnRenamed("cluster", "vec_id")
    assert got(cluster_vectors(other, 3, 3, 3, id_col="h", vector_col="ids")) == brute(plain, 3, 3, 3)


def test_partitions_and_a_hot_vector_do_not_matter(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [0.25, 0.5] if i % 3 else [float(x) for x in np.float32(rng.normal(size=2))]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 6, 4, 2)
    for parts, tree in ((1, 64), (7, 2048)):
        assert got(cluster_vectors(df.repartition(parts), 6, 4, 2, tree_rows=tree)) == want


def test_vectors_beyond_the_range_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        cluster_vectors(df, 2, 1, 1).count()


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_filtered_centroids_are_the_nearest_ones(data):
    dim = data.draw(st.integers(1, 4))
    number = st.integers(-6, 6) if data.draw(st.booleans()) else st.integers(-(1 << 26), 1 << 26)
    vectors = np.array(data.draw(st.lists(st.lists(number, min_size=dim, max_size=dim), min_size=1, max_size=60)), np.int64)
    centroids = np.array(data.draw(st.lists(st.lists(number, min_size=dim, max_size=dim), min_size=1, max_size=8)), np.int64)
    order, tree = Tree.build(vectors, leaf=2)
    tree = Tree.load(tree.dump(), dim)
    which, seen = np.full(len(vectors), -1), np.zeros(len(vectors), int)
    for node, a, b, w in tree.filter(centroids):
        which[order[a:b]] = w
        seen[a:b] += 1
        assert (tree.total[node] == tree.vectors[a:b].sum(axis=0)).all()
    want = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))[1] for v in vectors]
    assert (seen == 1).all() and which.tolist() == want == nearest(vectors, centroids).tolist()
