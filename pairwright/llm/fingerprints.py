"""Document fingerprints by consistent weighted sampling.

Each sample draws, for every word of a text with its count as weight, a value from gamma and
uniform variables that depend on the word and the sample alone, and keeps the least. Two
texts agree in a sample with a probability equal to the generalised Jaccard similarity of
their weighted words: the sum of the lesser weights over the sum of the greater.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import map_arrow, slices, words_of
from pairwright.session import staged

SAMPLES = 128
#: Terms whose values a task keeps; the table starts anew when it is full.
TERMS = 1 << 17
#: Terms whose values are made at once, few enough to stay in a core's cache.
BLOCK = 256
#: Documents that are put in one range of ids, as long as there are no more than so many ranges.
RANGE_ROWS, MOST_RANGES = 8000, 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 (public constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """Values of a gamma variable of shape 2 at probabilities: where 1 - exp(-x) (1 + x) = p, by halving."""
    low, high = np.zeros_like(p), np.full_like(p, 64.0)
    for _ in range(80):
        x = (low + high) / 2
        below = -np.expm1(-x) - x * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return high


#: Steps of the tables that turn uniform numbers into gamma variables.
_STEPS = 1 << 12
_R = _gamma_quantiles((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
# By the root of the probability, in which the quantile is smooth at 0; beyond the last step it goes on as in the step before.
_C = _gamma_quantiles((np.arange(_STEPS + 1) / _STEPS).clip(0, 1 - 0.25 / _STEPS) ** 2).astype(np.float32)
_C_RISE = np.append(np.diff(_C), np.float32(0))


def variables(hashes: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and c, gamma variables of shape 2, and beta, uniform (each terms x samples), from one 64-bit number for each term and sample."""
    with np.errstate(over="ignore"):
        bits = _mixed(hashes[:, None] + np.arange(samples, dtype=np.uint64)[None, :] * _STEP)
    low = bits.astype(np.uint32)
    r = _R[low & np.uint32(0xFFFF)]
    beta = ((low >> np.uint32(16)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
    at = np.sqrt((bits >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(_STEPS * 2.0**-16)
    step = np.minimum(at.astype(np.int32), _STEPS - 1)
    return r, _C[step] + (at - step) * _C_RISE[step], beta


def sample_values(hashes: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Logarithms of the values (terms x samples) that compete for the least."""
    r, c, beta = variables(hashes, samples)
    beta -= 1
    heavy = np.flatnonzero(weights != 1)
    if len(heavy):
        # The floor is 0 for a weight of 1.
        log_w = np.log(weights[heavy].astype(np.float32))[:, None]
        beta[heavy] -= np.floor(log_w / r[heavy] + (beta[heavy] + 1))
    beta *= r
    beta += np.log(c, out=c)
    return beta


class Sampler:
    """Fingerprints of texts, with a bounded table of the terms seen before."""

    def __init__(self, samples: int = SAMPLES, terms: int = TERMS):
        self.samples, self.most = samples, terms
        self.at: dict = {}
        self.table = np.empty((terms, samples), np.float32)

    def _learn(self, bags: list[Counter]) -> None:
        new = [t for t in set().union(*(b.items() for b in bags)) if t not in self.at]
        if len(self.at) + len(new) > self.most:
            self.at.clear()
            new = list(set().union(*(b.items() for b in bags)))
            if len(new) > len(self.table):
                self.table = np.empty((len(new), self.samples), np.float32)
        n = len(self.at)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w, _ in new], np.uint64)
        weights = np.array([c for _, c in new], np.int64)
        for i in range(0, len(new), BLOCK):
            self.table[n + i : n + i + len(weights[i : i + BLOCK])] = sample_values(hashes[i : i + BLOCK], weights[i : i + BLOCK], self.samples)
        self.at.update(zip(new, range(n, n + len(new)), strict=True))

    def fingerprints(self, texts: list[str]) -> list[np.ndarray | None]:
        """For each text its samples as 16-bit numbers; None for a text without words."""
        bags = [Counter(words_of(t)) for t in texts]
        self._learn(bags)
        return [self._least(b) if b else None for b in bags]

    def _least(self, bag: Counter) -> np.ndarray:
        rows = np.fromiter(map(self.at.__getitem__, bag.items()), np.int64, len(bag))
        least = np.minimum.reduce([self.table[rows[i : i + 8192]].min(axis=0) for i in range(0, len(rows), 8192)])
        with np.errstate(over="ignore"):
            return (least.view(np.uint32) * np.uint32(2654435761) >> np.uint32(16)).astype(np.uint16)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of samples that agree; texts without words are like each other only."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def written(fingerprint: np.ndarray | None) -> str:
    return "" if fingerprint is None else fingerprint.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points from the start of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


FIGURES = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, fingerprint) of every text; null is empty, and a text without words has an empty fingerprint.

    Repeated rows and ids are each fingerprinted, equal texts alike; an empty table gives no
    rows; other columns are not read.
    """

    def task():
        sampler = Sampler(samples)

        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text", 2 << 20):
                texts = [t or "" for t in part["text"].to_pylist()]
                yield pa.table([part["doc_id"], [len(words_of(t)) for t in texts], list(map(written, sampler.fingerprints(texts)))], names=["doc_id", "n_words", "fingerprint"])

        return work

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), task, "doc_id long, n_words long, fingerprint string")


class Comparer:
    """Figures of texts and their edited texts, a bounded run of rows at a time."""

    def __init__(self, samples: int):
        self.sampler = Sampler(samples)

    def __call__(self, rows: list[tuple[int, str, str]]) -> list[tuple]:
        """For (doc_id, text, following text) the row of doc_id and FIGURES."""
        # What follows a row is as a rule the next row, whose fingerprint is needed anyway.
        lone = [i for i, (_, _, x) in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][1] is not x]
        changed_texts, m = [edited(t, x) for _, t, x in rows], len(rows)
        prints = self.sampler.fingerprints([t for _, t, _ in rows] + changed_texts + [rows[i][2] for i in lone])
        afters = prints[1:m] + [None] + prints[2 * m :]
        for j, i in enumerate(lone):
            afters[i] = prints[2 * m + j]
        made = []
        for i, (d, t, _) in enumerate(rows):
            own, after, changed = prints[i], afters[i], prints[m + i]
            sha = hashlib.sha256(changed_texts[i].encode()).hexdigest()
            made.append((d, len(t), sha, written(own), written(changed), likeness(own, changed), likeness(own, after)))
        return made


#: Characters that are compared at once, and parts whose neighbours are found together.
RUN_CHARS = 1 << 19
PART_BLOCK = 256


def _next_parts(parts: DataFrame) -> DataFrame:
    """(part, after): each part with the next one that has rows, the last with the first; in blocks of PART_BLOCK numbers."""
    parts = parts.select("part", F.floor(F.col("part") / PART_BLOCK).alias("block"))
    inside = parts.withColumn("after", F.lead("part").over(Window.partitionBy("block").orderBy("part")))
    starts = parts.groupBy("block").agg(F.min("part").alias("start"))
    first = starts.agg(F.min("start").alias("first"))
    starts = starts.select("block", F.lead("start").over(Window.orderBy("block")).alias("start"))
    return inside.join(starts, "block").join(F.broadcast(first)).select("part", F.coalesce("after", "start", "first").alias("after"))


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES, range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are: doc_id and FIGURES.

    The next document is the one with the next id (after the last: the first); rows with one
    id follow each other in an order that their texts fix, and a null id comes first. A document
    that is alone follows itself. Null texts are empty. An empty table gives no rows; other
    columns are not read. Texts are shuffled once, by ranges of id and text. What follows the last
    row of a range is the first of the next: these rows, two for each range, are joined by the
    ranges' numbers.
    """
    names = ["doc_id", *[c.split()[0] for c in FIGURES.split(", ")]]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = min(max(1, -(-docs.count() // range_rows)), MOST_RANGES)
    order = ("key", "h", "text")

    def run(batches):
        part, compare = TaskContext.get().partitionId(), Comparer(samples)
        pending, held, size = None, [], 0

        def made(done):
            return pa.RecordBatch.from_pydict(dict(zip([*names, "kind", "part", "text"], [*map(list, zip(*done, strict=True)), *[[x] * len(done) for x in (0, part, None)]], strict=True)), schema=schema)

        def end(kind, row):
            values = [row[0], *[None] * (len(names) - 1), kind, part, row[1]]
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, [[v] for v in values], strict=True)), schema=schema)

        for batch in batches:
            for piece in slices(batch, "text", RUN_CHARS):
                for row in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist(), strict=True):
                    if pending is None:
                        yield end(1, row)
                    else:
                        held.append((*pending, row[1]))
                        size += len(row[1])
                        if size > RUN_CHARS:
                            yield made(compare(held))
                            held, size = [], 0
                    pending = row
        if held:
            yield made(compare(held))
        if pending is not None:
            yield end(2, pending)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in names[2:5]], *[(c, pa.float64()) for c in names[5:]], ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])
    kinds = f"doc_id long, {FIGURES}, kind int, part int, text string"
    placed = rows.repartitionByRange(n, "key", "h").sortWithinPartitions(*order)
    found = staged(placed.select("doc_id", "text").mapInArrow(run, kinds), "fingerprints")
    firsts, lasts = (found.where(F.col("kind") == k).select("part", "doc_id", "text") for k in (1, 2))
    ends = lasts.join(_next_parts(firsts.select("part")), "part").join(firsts.select(F.col("part").alias("after"), F.col("text").alias("following")), "after")

    def task():
        compare = Comparer(samples)

        def work(batch: pa.RecordBatch):
            for piece in slices(batch, "text", RUN_CHARS):
                done = compare(list(zip(*(piece[c].to_pylist() for c in ("doc_id", "text", "following")), strict=True)))
                yield pa.table(list(map(list, zip(*done, strict=True))), names=names)

        return work

    return found.where("kind = 0").select(*names).unionByName(map_arrow(ends.select("doc_id", "text", "following"), task, "doc_id long, " + FIGURES))
