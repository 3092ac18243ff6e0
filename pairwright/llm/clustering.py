"""Clustering around centroids with kd-trees that filter the centroids.

Vectors become integers. Each task packs its vectors into kd-trees, which hold for every node
the number of vectors, their sum and their box, and are written to the shared folder once. A
round walks the trees level by level: a centroid that is farther than another from all of a
node's box is dropped there, a node with one centroid left is assigned whole by its count and
sum, and leaves are resolved exactly. All figures are integers, so that neither partitions nor
their order matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import map_arrow
from pairwright.session import staged

#: Vectors of a tree, and of a leaf (fewer where all of a node are equal).
TREE_ROWS = 2048
LEAF_ROWS = 32
#: Integers beyond this would have squared distances that a long cannot hold.
MOST = 1 << 26
#: Up to this, sums of products are exact in double precision.
EXACT = 1 << 21


@dataclass
class Tree:
    """Vectors in the order of the leaves, and nodes in the order of their making (a child comes after its parent)."""

    vectors: np.ndarray  # rows x dim
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray  # the first of two neighbouring children; 0 for a leaf
    low: np.ndarray  # nodes x dim
    high: np.ndarray
    total: np.ndarray

    FIELDS = ("vectors", "begin", "end", "child", "low", "high", "total")

    @classmethod
    def build(cls, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, Tree]:
        """The order of the rows in the tree, and the tree: nodes are halved at the median of their widest side."""
        order = np.arange(len(vectors))
        begin, end, child, low, high, total = [0], [len(vectors)], [], [], [], []
        at = 0
        while at < len(begin):
            a, b = begin[at], end[at]
            rows = vectors[order[a:b]]
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            total.append(rows.sum(axis=0))
            wide = high[-1] - low[-1]
            side = int(wide.argmax())
            if b - a <= leaf or not wide[side]:
                child.append(0)
            else:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, side], half)]
                child.append(len(begin))
                begin += [a, a + half]
                end += [a + half, b]
            at += 1
        return order, cls(vectors[order], np.array(begin), np.array(end), np.array(child), np.array(low), np.array(high), np.array(total))

    def dump(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f), np.int64 if f == "total" else np.int32).tobytes() for f in self.FIELDS]

    @classmethod
    def load(cls, parts: list[bytes], dim: int) -> Tree:
        flat = [np.frombuffer(p, np.int64 if f == "total" else np.int32).astype(np.int64) for f, p in zip(cls.FIELDS, parts, strict=True)]
        return cls(*(x.reshape(-1, dim) if f in ("vectors", "low", "high", "total") else x for f, x in zip(cls.FIELDS, flat, strict=True)))

    def filter(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, int | np.ndarray]]:
        """(node, begin, end, which): nodes whose vectors all go to one centroid, and leaves with a centroid for each vector.

        The candidate next to the middle of a node's box drops every other one that is strictly farther
        from the corner of the box which lies farthest in its direction, and so from all of the box.
        """
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        square = (centroids * centroids).sum(axis=1)
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            far = square - (low + high) @ centroids.T
            far = np.where(open_, far, np.iinfo(np.int64).max)
            best = far.argmin(axis=1)
            for i in range(0, len(nodes), 64):
                part = slice(i, i + 64)
                ways = centroids[None] - centroids[best[part]][:, None]
                both = centroids[None] + centroids[best[part]][:, None]
                corner = np.where(ways > 0, high[part][:, None], low[part][:, None])
                open_[part] &= np.einsum("nkd,nkd->nk", ways, both - 2 * corner) <= 0
            left = open_.sum(axis=1)
            child = self.child[nodes]
            for i in np.flatnonzero(left == 1):
                yield int(nodes[i]), int(self.begin[nodes[i]]), int(self.end[nodes[i]]), int(best[i])
            for i in np.flatnonzero((left > 1) & (child == 0)):
                a, b = int(self.begin[nodes[i]]), int(self.end[nodes[i]])
                among = np.flatnonzero(open_[i])
                yield int(nodes[i]), a, b, among[nearest(self.vectors[a:b], centroids[among])]
            on = np.flatnonzero((left > 1) & (child > 0))
            nodes, open_ = np.concatenate([child[on], child[on] + 1]), np.concatenate([open_[on], open_[on]])


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, the first of equal ones; exact."""
    square = (centroids * centroids).sum(axis=1)
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        products = (vectors.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        products = vectors @ centroids.T
    return (square[None] - 2 * products).argmin(axis=1)


def _read(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, Tree]]:
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        yield row, Tree.load([row[f][0].as_py() for f in Tree.FIELDS], dim)


def build_trees(vectors: DataFrame, dim: int, rows: int = TREE_ROWS) -> DataFrame:
    """A row for each tree of ``vectors`` (vec_id, v array<int>): its ids in the tree's order, and its arrays as bytes."""
    schema = "ids array<long>, " + ", ".join(f"{f} binary" for f in Tree.FIELDS)

    def run(batches):
        ids, held, n = [], [], 0

        def tree():
            matrix, names = np.concatenate(held), pa.concat_arrays(ids)
            if max(matrix.max(), -matrix.min()) > MOST:
                raise ValueError(f"an integer is beyond {MOST}: a long cannot hold its distances")
            order, made = Tree.build(matrix)
            listed = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), names.take(pa.array(order)))
            return pa.RecordBatch.from_arrays([listed, *(pa.array([x], pa.binary()) for x in made.dump())], names=["ids", *Tree.FIELDS])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - n)
                ids.append(part["vec_id"])
                held.append(part["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64))
                at, n = at + part.num_rows, n + part.num_rows
                if n == rows:
                    yield tree()
                    ids, held, n = [], [], 0
        if n:
            yield tree()

    return vectors.mapInArrow(run, schema)


def _sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, their exact sum), from whole nodes and leaves; the driver sees a row for each cluster and component."""
    dim = centroids.shape[1]

    def run(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, tree in _read(batch, dim):
                for node, a, b, which in tree.filter(centroids):
                    if isinstance(which, int):
                        count[which] += b - a
                        total[which] += tree.total[node]
                    else:
                        np.add.at(count, which, 1)
                        np.add.at(total, which, tree.vectors[a:b])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.repeat(dim)), pa.array(np.tile(np.arange(dim), len(some))), pa.array(count[some].repeat(dim)), pa.array(total[some].ravel())], names=["cluster", "i", "n", "total"])

    parts = trees.mapInArrow(run, "cluster long, i long, n long, total long")
    out: dict = {}
    for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out.setdefault(r.cluster, (r.n, [0] * dim))[1][r.i] = int(r.total)
    return out


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dim = centroids.shape[1]

    def task():
        def work(batch: pa.RecordBatch):
            for row, tree in _read(batch, dim):
                which = np.empty(len(tree.vectors), np.int64)
                for _, a, b, w in tree.filter(centroids):
                    which[a:b] = w
                gap = tree.vectors - centroids[which]
                yield pa.table([row["ids"].flatten(), pa.array(which.astype(np.int32)), pa.array((gap * gap).sum(axis=1))], names=["vec_id", "cluster", "distance"])

        return work

    return map_arrow(trees, task, "vec_id long, cluster int, distance long")


def cluster_vectors(
    rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding", tree_rows: int = TREE_ROWS
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of ``dim`` components, none null or non-finite; a component x counts as floor(scale * x).
    The first centroids are the ``k`` kept vectors with the least SHA-256 of ``seed`` and id (equal ones by
    their components); with fewer vectors there are as many centroids. Repeated rows and ids are a vector
    each, and a null id is hashed as an empty one. Equal distances go to the smaller number; a centroid without
    vectors stays. An empty table gives no rows; other columns are not read. Integers beyond 2^26 are
    an error, as a long could not hold their distances.

    A round reads the trees once and brings at most k * dim sums to the driver; nothing else leaves the executors.
    """
    v = F.col(vector_col)
    sound = F.expr(f"size(`{vector_col}`) = {dim} AND forall(`{vector_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('infinity'))")
    # What is beyond the range here is an error in `build_trees`.
    most = F.lit(float(2 * MOST))
    made = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, most), -most)).cast("int"))
    kept = rows.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), made.alias("v"))
    trees = staged(build_trees(kept, dim, tree_rows), "trees")
    first = kept.withColumn("h", F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)).orderBy("h", "v").limit(k).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        for cluster, (n, total) in _sums(trees, centroids).items():
            centroids[cluster] = [t // n for t in total]
    found = staged(_assigned(trees, centroids), "clusters")
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # At most k rows.
    known = rows.sparkSession.createDataFrame([(c, d, sum(inertia.values()), shas[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
