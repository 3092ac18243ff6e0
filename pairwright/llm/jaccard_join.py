"""Near-duplicate classes by an exact n-gram Jaccard join with adaptive multi-match prefixes.

If two sets reach the threshold they share, for every l, at least l of the tokens in their
l-prefixes: the first (size - least overlap + l) tokens in one global order. Longer prefixes
cost more postings but leave fewer candidates, so each document gets the l with the least
estimated cost, and a pair is counted by the lesser l of the two.

1. Sets of hashed shingles, with a signature of the whole set. Prefixes in hash order, which
   needs no counts, tell which documents could have a partner at all.
2. Only for those (one of each signature), tokens are counted, and prefixes in order of
   rising frequency with an l of their own are laid out as postings.
3. Each document is verified against one pivot: that of the tokens it shares most, a pivot
   being the document of a posting list with the fewest tokens of its own. This joins large
   groups of near copies with as many pairs as documents.
4. What is left are pairs of different components that share enough prefix tokens and pass
   bounds on length and position; they are verified, all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import WordCache, map_arrow, slices, unused
from pairwright.operators.components import connected_components
from pairwright.session import staged

SHINGLE = 5
#: Similarity from which two documents link, in percent.
PERCENT = 75
#: In the first step l is this part of a set's size.
FIRST_L = 0.10
#: l that step 2 chooses from, and what verifying one candidate costs, in postings.
CHOICES = (1, 2, 3, 4, 6, 8, 12, 16)
VERIFY_COST = 0.5
#: 64-bit words of the bitmap that each posting has of the tokens before it.
MAP_WORDS = 8
#: Postings that a task gathers before it gives them out; one document may have more.
POSTINGS_AT_ONCE = 1 << 16
#: Bits for each id of the filter that tells which documents may have a partner, and the least and most of all; it may let more through.
FILTER_BITS_EACH = 16
FILTER_BITS = 1 << 22, 1 << 27

_M = np.uint64(0x9E3779B97F4A7C15)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.hashes = WordCache(xxhash.xxh64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        self.hashes.trim()
        words = text.encode().lower().split() if text else []
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        m = min(n, self.size)
        h = np.full(n - m + 1, m, np.uint64)
        for j in range(m):
            h = h * _M + _finish(w[j : n - m + 1 + j])
        return np.unique(_finish(h))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of ``n`` shares with any that links to it."""
    return -(-percent * n // 100)


def first_l(n: int) -> int:
    return max(1, int(np.ceil(FIRST_L * n)))


def prefix_length(n: int, l: int, percent: int = PERCENT) -> int:  # noqa: E741
    return min(n, n - least_overlap(n, percent) + l)


def pair_overlap_sql(a: str, b: str, percent: int) -> str:
    """Tokens that two sets of these sizes share if they link: the least o with 100 o >= percent (a + b - o)."""
    return f"ceil({percent} * ({a} + {b}) / {100 + percent}D - 1e-9)"


def _sets(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """doc_id, n, sig (of the whole set), need (shared prefix tokens without which it has no partner), prefix."""

    def task():
        shingles = Shingler(size)

        def row(text):
            h = shingles(text)
            n = len(h)
            need = first_l(least_overlap(n, percent)) if n else 0
            return n, hashlib.blake2b(h.tobytes(), digest_size=16).digest(), need, h[: prefix_length(n, first_l(n), percent) if n else 0].view(np.int64)

        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                rows = [row(t) for t in part["text"].to_pylist()]
                n, sig, need, prefix = zip(*rows, strict=True)
                yield pa.table([part["doc_id"], list(n), list(sig), list(need), _lists(prefix)], names=["doc_id", "n", "sig", "need", "prefix"])

        return work

    return map_arrow(docs, task, "doc_id long, n long, sig binary, need long, prefix array<long>")


def _lists(arrays) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _may_link(sets: DataFrame) -> DataFrame:
    """One document (the least id) of each set that shares enough prefix tokens with other sets: rep, n."""
    tokens = sets.where("n > 0").select(F.xxhash64("sig").alias("s"), F.explode("prefix").alias("token")).repartition("token")
    shared = tokens.groupBy("token").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("token")
    counts = tokens.join(shared, "token").groupBy("s").agg(F.count("*").alias("shared"))
    reps = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("need").alias("need"))
    return reps.withColumn("s", F.xxhash64("sig")).join(counts, "s").where("shared >= need").select("rep", "n")


def filter_bits(n: int) -> int:
    return min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (FILTER_BITS_EACH * n).bit_length()))


def id_filter(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for the hash of each id; ``bits`` / 64 numbers at most come to the driver."""
    slot = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(s, 64) AS int))")).alias("b")).toPandas()
    words = np.zeros(bits // 64, np.int64)
    words[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return words


def _whole_sets(docs: DataFrame, words: np.ndarray, size: int) -> DataFrame:
    """id, n and the sorted tokens of the documents that the filter lets through."""

    def task():
        shingles = Shingler(size)

        def work(batch: pa.RecordBatch):
            s = np.asarray(batch["s"], dtype=np.int64)
            batch = batch.filter(pa.array((words[s >> 6] >> (s & 63)) & 1 == 1))
            for part in slices(batch, "text"):
                sets = [shingles(t).view(np.int64) for t in part["text"].to_pylist()]
                yield pa.table([part["doc_id"], list(map(len, sets)), _lists(sets)], names=["id", "n", "tokens"])

        return work

    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(len(words) * 64)).alias("s"))
    return map_arrow(rows, task, "id long, n long, tokens array<long>")


def choose_l(df: np.ndarray, n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(l, tokens of the prefix that others share) with the least estimated cost.

    ``df``: frequencies of the shared tokens of a set of ``n``, rising; those it alone has come
    before them. Each posting costs its list's length; at most that sum / l are candidates.
    """
    own = n - len(df)
    sums = np.concatenate([[0], np.cumsum(df - 1)])
    best = None
    for l in CHOICES:  # noqa: E741
        if best and l > least_overlap(n, percent):
            break
        k = max(0, prefix_length(n, l, percent) - own)
        if k < l:
            # Fewer shared tokens than l: no partner.
            return l, 0
        cost = sums[k] * (1 + VERIFY_COST / l)
        if best is None or cost < best[0]:
            best = (cost, l, k)
    return best[1], best[2]


def maps_before(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token a bitmap of those before it, and by how many these are more than the bits set.

    Of the tokens before two postings of one token, no more are shared than bits are set in
    both maps, plus the lesser of the two excesses.
    """
    k = len(tokens)
    spot = (tokens.view(np.uint64) * _M >> np.uint64(32)) % np.uint64(64 * MAP_WORDS)
    maps = np.zeros((k + 1, MAP_WORDS), np.uint64)
    maps[np.arange(1, k + 1), (spot >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (spot & np.uint64(63))
    maps = np.bitwise_or.accumulate(maps, axis=0)[:k]
    return maps.view(np.int64), np.arange(k) - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)


_MAPS = [f"b{i}" for i in range(MAP_WORDS)]


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """token, id, n, own (tokens that it alone has), pos (place in the global order), l, excess and maps."""
    tokens = sets.select("id", "n", F.explode("tokens").alias("token")).repartition("token")
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(counts, "token").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))

    def rows_of(parts):
        rows = np.concatenate(parts)
        return pa.table([rows[:, j] for j in range(rows.shape[1])], names=columns)

    def task():
        def work(batch: pa.RecordBatch):
            out, held = [], 0
            lists = batch["shared"]
            flat, ends = lists.flatten(), np.asarray(lists.value_lengths(), dtype=np.int64).cumsum()
            dfs, toks = (np.asarray(flat.field(c), dtype=np.int64) for c in ("df", "token"))
            for i, (d, n) in enumerate(zip(batch["id"].to_pylist(), batch["n"].to_pylist(), strict=True)):
                a, b = (ends[i - 1] if i else 0), ends[i]
                own = n - (b - a)
                l, k = choose_l(dfs[a:b], n, percent)  # noqa: E741
                maps, excess = maps_before(toks[a : a + k])
                out.append(np.column_stack([toks[a : a + k], np.full(k, d), np.full(k, n), np.full(k, own), own + np.arange(k), np.full(k, l), excess, maps]))
                held += k
                if held >= POSTINGS_AT_ONCE:
                    yield rows_of(out)
                    out, held = [], 0
            if out:
                yield rows_of(out)

        return work

    columns = ["token", "id", "n", "own", "pos", "l", "excess", *_MAPS]
    return map_arrow(shared, task, ", ".join(f"{c} long" for c in columns))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) those whose sets reach the threshold."""
    x, y = sets.select(F.col("id").alias("x"), F.col("tokens").alias("tx")), sets.select(F.col("id").alias("y"), F.col("tokens").alias("ty"))

    def task():
        def work(batch: pa.RecordBatch):
            sides = []
            for c in ("tx", "ty"):
                ends = np.concatenate([[0], np.asarray(batch[c].value_lengths(), dtype=np.int64).cumsum()])
                sides.append((np.asarray(batch[c].flatten()).view(np.uint64), ends))
            (tx, ex), (ty, ey) = sides
            keep = []
            for i in range(batch.num_rows):
                a, b = tx[ex[i] : ex[i + 1]], ty[ey[i] : ey[i + 1]]
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                o = int((b[at] == a).sum())
                keep.append(100 * o >= percent * (len(a) + len(b) - o))
            yield pa.table([batch["x"], batch["y"]], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

        return work

    return map_arrow(pairs.join(x, "x").join(y, "y").select("x", "y", "tx", "ty"), task, "x long, y long")


def _pivots(postings: DataFrame) -> DataFrame:
    """(x, y): each id with the pivot that it shares most prefix tokens with."""
    rank = F.struct((F.col("own") * 1000 / F.col("n")).cast("long").alias("r"), F.col("id").alias("y"))
    pivot = postings.groupBy("token").agg(F.min(rank).alias("p")).select("token", F.col("p.y").alias("y"))
    shared = postings.join(pivot, "token").where("id <> y").groupBy(F.col("id").alias("x"), "y").agg(F.count("*").alias("c"))
    return shared.groupBy("x").agg(F.max(F.struct("c", (-F.col("y")).alias("m"))).alias("b")).select("x", (-F.col("b.m")).alias("y"))


def _crossing(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different components that could reach the threshold.

    Within a posting list, members of its largest component meet only those outside it.
    """
    in_component = lambda p: p.join(labels, "id", "left").withColumn("c", F.coalesce("c", "id"))
    sizes = in_component(postings.select("token", "id")).groupBy("token", "c").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("token").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("cs")).where("cs > 1").select("token", F.col("top.c").alias("top"))
    p = in_component(postings.join(mixed, "token"))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "own", "pos", "l", "excess", *_MAPS, "c")]
    outside = p.where("c <> top").select("token", *side("x"))
    every = p.select("token", *side("y"), (F.col("c") != F.col("top")).alias("out_y"))
    least = pair_overlap_sql("n_x", "n_y", percent)
    within = lambda s: f"pos_{s} < n_{s} - ceil({percent} * n_{s} / 100D - 1e-9) + least(l_x, l_y)"
    rest = "least(n_x - pos_x - 1, n_y - pos_y - 1)"
    common = " + ".join(f"bit_count({b}_x & {b}_y)" for b in _MAPS) + " + least(excess_x, excess_y)"
    before = f"least(pos_x - own_x, pos_y - own_y, {common})"
    meets = f"c_x <> c_y AND (NOT out_y OR id_x < id_y) AND {within('x')} AND {within('y')} AND least(pos_x - own_x, pos_y - own_y) + 1 + {rest} >= {least} AND {before} + 1 + {rest} >= {least}"
    pair = [F.least("id_x", "id_y").alias("x"), F.greatest("id_x", "id_y").alias("y")]
    figures = [F.expr(rest).alias("rest"), F.expr("least(l_x, l_y)").alias("l"), F.expr(least).alias("least")]
    # A pair arises both ways round, as either component is the largest of a list.
    rows = outside.join(every, "token").where(meets).select(*pair, *figures).groupBy("x", "y")
    counts = rows.agg(F.count("*").alias("m"), F.min("rest").alias("rest"), F.first("l").alias("l"), F.first("least").alias("least"))
    return counts.where("m >= l AND m + rest >= least").select("x", "y")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are lower-cased (A-Z) and cut at ASCII white space; a set holds the distinct runs of
    ``size`` words, or the whole text as one where there are fewer. Sets link when their
    similarity is ``percent`` or more; component_id is the least id reachable by links. Texts
    without words link with nothing. Rows with one id are one document that links like any of
    them; a null id links with nothing and has a null component. An empty table gives no rows;
    other columns are not read. No link between different sets is lost: pairs are left out
    only within a component or by a bound that rules them out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = staged(_sets(docs, percent, size), "sets")
    named = sets.where("n > 0 AND doc_id IS NOT NULL")
    reps = staged(_may_link(named), "reps")
    whole = staged(_whole_sets(docs.where("doc_id IS NOT NULL"), id_filter(reps, "rep", filter_bits(reps.count())), size).where("n > 0"), "whole")
    postings = staged(_postings(whole, percent), "postings")
    starred = staged(_verified(_pivots(postings), whole, percent), "links")
    labels = connected_components(starred, "x", "y", node="id", component="c")
    links = starred.union(_verified(_crossing(postings, labels, percent), whole, percent))
    classes = named.select("sig", "doc_id").join(named.groupBy("sig").agg(F.min("doc_id").alias("rep")), "sig").where("doc_id <> rep").select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
    found = connected_components(links.union(classes), "x", "y", node="doc_id", component="component_id")
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose group has a lesser id; all other rows stay, with all columns, whatever their names.

    Rows with one id are one document and stay or go together; null ids stay, as do texts
    without words. An empty table stays empty. Only rows that a filter of bounded size marks are
    shuffled to be looked up.
    """
    groups = near_duplicates(docs, percent, size, id_col, text_col)
    slot, lost = unused("slot", docs), unused("gone", docs)
    gone = staged(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(lost)).distinct(), "gone")
    words = id_filter(gone, lost, filter_bits(gone.count()))
    key = F.xxhash64(F.col(id_col).cast("long"))

    def task():
        def work(batch: pa.RecordBatch):
            s = np.asarray(batch[slot], dtype=np.int64)
            yield pa.Table.from_batches([batch]).set_column(batch.schema.get_field_index(slot), slot, pa.array((words[s >> 6] >> (s & 63)) & 1))

        return work

    marked = docs.withColumn(slot, F.pmod(key, F.lit(len(words) * 64)))
    marked = map_arrow(marked, task, marked.schema)
    sure = marked.where(F.col(slot) == 0).drop(slot)
    asked = marked.where(F.col(slot) == 1).drop(slot)
    return sure.unionByName(asked.join(gone, asked[id_col].cast("long") == gone[lost], "left_anti"))
