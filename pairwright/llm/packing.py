"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan depends on how many pieces there are of each length, never on the pieces
themselves, so the driver sees one count for each length up to the capacity. Martello and
Toth's dominance criterion permanently fixes small sets of lengths that no other choice can
beat; what is left is packed by best fit in falling length. Every piece then finds its place
by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.byte_bpe import ByteBpe, default_path
from pairwright.llm.common import map_arrow, slices
from pairwright.session import staged

CAPACITY = 2048
SEPARATOR = 0
#: Pieces that are ranked together in one group.
RANKED_TOGETHER = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only documents over ``capacity`` are cut."""
    n = len(ids) // 4
    first = n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def pieces_of(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document, each document ending in SEPARATOR."""
    path = tokenizer_path or default_path()
    end = np.array([SEPARATOR], "<u4").tobytes()

    def task():
        bpe = ByteBpe(path)

        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                rows = [(d, *p) for d, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True) for p in cut(bpe.encode(t) + end, capacity)]
                yield pa.table(list(map(list, zip(*rows, strict=True))), names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return work

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), task, PIECES)


class _Lengths:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.order.remove(length)

    def largest_to(self, room: int, without: int) -> int | None:
        """The largest length up to ``room``, once one piece of ``without`` is gone."""
        i = bisect_left(self.order, room + 1) - 1
        while i >= 0 and self.order[i] == without and self.count[without] < 2:
            i -= 1
        return self.order[i] if i >= 0 else None

    def least_pair(self, without: int) -> int:
        """The least sum of two pieces, once one piece of ``without`` is gone."""
        got: list[int] = []
        for x in self.order:
            got += [x] * min(2, self.count[x] - (x == without))
            if len(got) >= 2:
                return got[0] + got[1]
        return 1 << 60

    def least(self, n: int, without: int) -> int:
        """The least sum of ``n`` pieces, once one piece of ``without`` is gone."""
        total = 0
        for x in self.order:
            take = min(n, self.count[x] - (x == without))
            total, n = total + take * x, n - take
            if not n:
                return total
        return 1 << 60

    def greatest_pair(self, room: int, without: int) -> int:
        """The greatest sum of two pieces up to ``room``, once one piece of ``without`` is gone."""
        have = {x: n for x in self.order if (n := self.count[x] - (x == without))}
        lengths = list(have)
        lo, hi, best = 0, len(lengths) - 1, 0
        while lo <= hi:
            a, b = lengths[lo], lengths[hi]
            if a + b > room:
                hi -= 1
                continue
            if lo < hi or have[a] > 1:
                best = max(best, a + b)
            lo += 1
        return best


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets fixed by dominance, each with how often, and the counts that remain.

    For the largest piece j, a set {j} or {j, k} with k the largest that fits is fixed if every
    other set that fits beside j can be exchanged for it: nothing fits, k fills the sequence,
    no two pieces fit together, or no three do and no two that fit are more than k, so that
    they find room where k was. Then the next smaller length is tried, and all again until
    nothing changes.
    """
    left, fixed, changed = _Lengths(counts), [], True
    while changed:
        changed = False
        for j in reversed(list(left.order)):
            while left.count.get(j):
                room = capacity - j
                k = left.largest_to(room, j) if room else None
                if k is None:
                    fixed.append(((j,), left.count[j]))
                    left.take(j, left.count[j])
                    changed = True
                elif k == room or left.least_pair(j) > room or (left.least(3, j) > room and left.greatest_pair(room, j) <= k):
                    n = left.count[j] // 2 if k == j else min(left.count[j], left.count[k])
                    fixed.append(((j, k), n))
                    left.take(j, n)
                    left.take(k, n)
                    changed = True
                else:
                    break
    return fixed, dict(left.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in falling length, for all sequences with the same contents at once."""
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [contents, how many]
    rooms: list[int] = []

    def put(contents: tuple[int, ...], n: int, room: int) -> None:
        if n:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append([contents, n])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                put((length,) * each, n // each, capacity - each * length)
                if n % each:
                    put((length,) * (n % each), 1, capacity - n % each * length)
                break
            room = rooms[i]
            contents, have = open_[room][-1]
            m = min(n, have)
            open_[room][-1][1] -= m
            if have == m:
                open_[room].pop()
                if not open_[room]:
                    rooms.pop(i)
            put((*contents, length), m, room - length)
            n -= m
    return [(contents, n) for groups in open_.values() for contents, n in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For runs of ranks of a length (length, rank): the sequence of the first and the offset."""
    fixed, rest = reduced(counts, capacity)
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for contents, n in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for length in contents:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": rows[:, 0], "rank": rows[:, 1], "sequence": rows[:, 2], "offset": rows[:, 3], "sequences": np.array([sequence])}


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Martello and Toth's L2: sequences that any packing needs."""
    best = -(-sum(k * v for k, v in counts.items()) // capacity)
    for least in [0, *sorted(k for k in counts if k <= capacity // 2)]:
        big = sum(v for k, v in counts.items() if k > capacity - least)
        mid = {k: v for k, v in counts.items() if capacity // 2 < k <= capacity - least}
        small = sum(k * v for k, v in counts.items() if least <= k <= capacity // 2)
        room = sum((capacity - k) * v for k, v in mid.items())
        best = max(best, big + sum(mid.values()) + max(0, -(-(small - room) // capacity)))
    return best


_RANK_BITS = 48


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the separator alone. Repeated rows and ids are packed one by one;
    equal pieces may change places with one another. An empty table gives no rows; other
    columns are not read. The pieces' lengths are staged in the shared folder, the driver
    gets ``capacity`` counts at most, and ranks are counted in groups of bounded size.
    """
    pieces = staged(pieces_of(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = plan(counts, capacity)
    groups = max(1, -(-sum(counts.values()) // RANKED_TOGETHER))
    grouped = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    sizes = grouped.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = sizes.select("length", "g", (F.sum("n").over(Window.partitionBy("length").orderBy("g")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = grouped.withColumn("inside", inside).join(before, ["length", "g"]).withColumn("rank", F.col("before") + F.col("inside")).drop("g", "inside", "before")
    keys = places["length"] << _RANK_BITS | places["rank"]

    def task():
        def work(batch: pa.RecordBatch):
            length, rank = (np.asarray(batch[c], dtype=np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << _RANK_BITS | rank, side="right") - 1
            sequence = places["sequence"][at] + rank - places["rank"][at]
            yield pa.table([batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [sequence, places["offset"][at]], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        return work

    return map_arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), task, PIECES + ", sequence_id long, offset long")
