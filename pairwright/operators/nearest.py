"""Nearest vectors by rounded cosine: blocks of queries meet blocks of vectors as products of matrices, and what may rank is scored exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries that one task's step holds at once, and queries whose products with a block it makes at once.
HELD, ASKED, STRIPE = 8192, 2048, 256
DIGITS = 6
_UNIT = 10.0**DIGITS
#: Two products further apart than this differ when rounded, whatever the order of their sums.
_SLACK = 1.1 / _UNIT


def nearest(queries: DataFrame, vectors: DataFrame, k: int, held: int = HELD, asked: int = ASKED) -> DataFrame:
    """(qaid, daid, score, rank): for each of ``queries`` (id, e) the k of the other ``vectors`` (id, e) with the greatest cosine, rounded to 6 digits; ties by id.

    All pairs are scored, so the work is the product of both numbers; a task holds one block of each side, and gives out
    what may be among the k of a query in its block. Sums run from the first component to the last in
    double precision. A pair with a null (a vector, a component, or one that only one of them has) has no score and comes last.
    """
    blocks = lambda df, size: max(1, -(-df.count() // size))
    qs, vs = blocks(queries, asked), blocks(vectors, held)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = queries.select("id", "e", block(qs).alias("q")).withColumn("v", every(vs))
    # Names of its own: a cogroup of two sides with columns in common loses those of one.
    two = vectors.select(F.col("id").alias("id2"), F.col("e").alias("e2"), block(vs).alias("v")).withColumn("q", every(qs))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        # A side without rows comes without columns.
        found = [part for part in _meet(left, right, k) if len(part)] if left.num_rows and right.num_rows else []
        rows = pd.concat(found) if found else pd.DataFrame({"qaid": [], "daid": [], "score": []})
        score = pa.array(rows["score"].to_numpy(dtype="float64"), mask=rows["none"].to_numpy(dtype=bool) if found else None)
        return pa.table({"qaid": pa.array(rows["qaid"].to_numpy(dtype="int64")), "daid": pa.array(rows["daid"].to_numpy(dtype="int64")), "score": score})

    near = one.groupBy("q", "v").cogroup(two.groupBy("q", "v")).applyInArrow(meet, "qaid long, daid long, score double")
    order = Window.partitionBy("qaid").orderBy(F.desc("score"), "daid")
    ranked = near.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qaid", "daid", "score", F.col("rank").cast("long").alias("rank"))


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length the ids and components of vectors that are whole; -1: the ids of the others."""
    out: dict[int, tuple] = {}
    ids, vectors = table.column(0).to_numpy(), table.column(1).combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    if flat.null_count:
        owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
        sizes = sizes.copy()
        own = sizes.copy()
        sizes[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    else:
        own = sizes
    starts = np.concatenate([[0], np.cumsum(np.maximum(own, 0))])[:-1].astype("int64")
    values = flat.to_numpy(zero_copy_only=False).astype("float64")
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        rows = np.empty((len(mine), 0)) if size < 1 else values[starts[mine][:, None] + np.arange(size)]
        out[int(size)] = ids[mine], rows
    return out


def _norms(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += rows[:, j] * rows[:, j]
    return np.sqrt(total)


def _meet(left: pa.Table, right: pa.Table, k: int):
    """(qaid, daid, score, none) of pairs that may be among the k of a query, in parts."""
    asked, held = _matrices(left), _matrices(right)
    ids = right.column(0).to_numpy()
    for size, (qids, q) in asked.items():
        vids, v = held[size] if size in held and size >= 0 else (ids[:0], np.empty((0, q.shape[1])))
        others = np.concatenate([ids[:0], *[i for s, (i, _) in held.items() if s != size or size < 0]])
        if len(others):
            rest = np.sort(others)[: k + 1]
            rows = pd.DataFrame({"qaid": np.repeat(qids, len(rest)), "daid": np.tile(rest, len(qids)), "score": 0.0, "none": True})
            yield rows[rows["qaid"] != rows["daid"]]
        if len(vids):
            with np.errstate(all="ignore"):
                qn, vn = _norms(q), _norms(v)
                usual = np.isfinite(vn) & (vn > 0)
                scaled = np.where(usual[:, None], v / vn[:, None], np.nan).T
                for i in range(0, len(qids), STRIPE):
                    yield _best(qids[i : i + STRIPE], q[i : i + STRIPE], qn[i : i + STRIPE], vids, v, vn, scaled, k)


def _best(qids, q, qn, vids, v, vn, scaled, k: int) -> pd.DataFrame:
    near = np.nan_to_num((q / qn[:, None]) @ scaled, nan=np.inf)
    near[~(np.isfinite(qn) & (qn > 0))] = np.inf
    near[qids[:, None] == vids[None, :]] = -np.inf
    if len(vids) > k:
        kth = np.partition(near, len(vids) - k, axis=1)[:, len(vids) - k]
        r, c = np.nonzero((near >= kth[:, None] - _SLACK) & (near > -np.inf) | (near == np.inf))
    else:
        r, c = np.nonzero(near > -np.inf)
    total = np.zeros(len(r))
    for j in range(q.shape[1]):
        total += q[r, j] * v[c, j]
    score = total / (qn[r] * vn[c])
    # A rounded score is one of two numbers of units, which differ only where half a unit is near. NaN is the greatest.
    units = np.clip(np.nan_to_num(score * _UNIT, nan=1e302), -1e301, None)
    units = np.where(np.isposinf(score), 1e301, units)
    rows = pd.DataFrame({"row": r, "qaid": qids[r], "daid": vids[c], "score": score, "none": False, "low": np.floor(units + 0.499), "high": np.floor(units + 0.501)})
    rows = rows.sort_values(["row", "low", "daid"], ascending=[True, False, True])
    place = rows.groupby("row").cumcount()
    least = rows[place == k - 1].set_index("row")["low"]
    rows = rows[~(rows["high"] < rows["row"].map(least))]
    # Of those that are equal for sure, the k least ids are enough.
    same = np.where(rows["low"] == rows["high"], 0.0, rows["score"])
    return rows[rows.assign(same=same).groupby(["row", "low", "high", "same"]).cumcount() < k][["qaid", "daid", "score", "none"]]
