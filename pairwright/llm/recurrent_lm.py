"""Scores of texts by a gated recurrent language model with a class-factored softmax.

Words are counted over all training documents. The most frequent ones (the head) get weights
of their own, in classes of equal size; all other words (the tail) fall in classes by how they
end, and share their class's probability by their counts, with one more share for words never
seen. The network reads words one by one, carries its state from window to window through a
whole document, and gives the probability of the next class and, in the head, of the word in
its class. It is trained by truncated backpropagation, in numpy, in rounds: each trains groups
of documents side by side, and the mean of their weights starts the next.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from heapq import heapreplace
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import crc32_of, slices
from pairwright.session import shared_dir, staged

#: Head symbols (the end among them), words in a head class, tail classes, and units of the network.
HEAD = 1024
CLASS_WORDS = 64
TAIL_CLASSES = 48
UNITS = 16
#: Tokens of a window, lanes side by side in training and in scoring.
WINDOW = 16
TRAIN_LANES = 256
SCORE_LANES = 512
#: Tokens that scoring reads in a window, if it has few lanes, and rows that a softmax makes at once, which a core's cache holds.
SCORE_WINDOW_TOKENS = 8192
SOFTMAX_ROWS = 512
#: Training cuts longer documents in stretches of so many tokens, each with a state of its own; scoring never does.
STRETCH = 1024
#: Tokens that one task learns from between two averages of the weights, and the least number of rounds.
GROUP_TOKENS = 1 << 20
LEAST_ROUNDS = 2
#: Small groups have so few lanes that this many windows are learned from, if they can.
LEAST_STEPS = 256
#: Rows that are summed in one group.
FAN_IN = 64
LEARNING_RATE = 0.15
BIAS_RATE = 0.1
SMOOTH = 0.1
#: Bytes of text that share one dictionary.
DICTIONARY_BYTES = 24 << 20
MARKS = ".,;:!?"


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; the end is not among them."""
    return text.encode().lower().split() if text else []


def ending(word: bytes) -> str:
    return word.decode().rstrip(MARKS)[-3:]


_ENDING = f"right(trim(TRAILING '{MARKS}' FROM word), 3)"


@dataclass
class Vocabulary:
    """head: words in falling frequency (symbol 0 is the end); endings: tail class of each; and counts."""

    head: dict[bytes, int]
    head_counts: np.ndarray
    endings: dict[str, int]
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    train_tokens: int
    distinct: int

    @property
    def head_classes(self) -> int:
        return HEAD // CLASS_WORDS

    def symbol(self, word: bytes) -> int:
        found = self.head.get(word)
        return found if found is not None else HEAD + self.endings.get(ending(word), TAIL_CLASSES - 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTH) / (self.train_tokens + SMOOTH * (self.distinct + 1)))

    def in_tail(self, symbol: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Logarithms of the shares of tail words in their classes; 0 for the head."""
        k = np.maximum(symbol - HEAD, 0)
        share = np.log((c + SMOOTH) / (self.tail_tokens[k] + SMOOTH * (self.tail_words[k] + 1)))
        return np.where(symbol >= HEAD, share, 0.0)


# The network ---------------------------------------------------------------------------


def initial(v: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; biases that give the words their frequencies."""
    rng = np.random.default_rng(7)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    counts = v.head_counts + SMOOTH
    classes = np.concatenate([counts.reshape(-1, CLASS_WORDS).sum(axis=1), v.tail_tokens + SMOOTH * (v.tail_words + 1)])
    return {
        "E": small(HEAD + TAIL_CLASSES, 3 * UNITS), "U": small(UNITS, 3 * UNITS) * np.float32(2), "C": small(UNITS, v.head_classes + TAIL_CLASSES), "c": np.log(classes / classes.sum()).astype(np.float32),
        "W": small(v.head_classes, UNITS, CLASS_WORDS), "w": np.log(counts.reshape(-1, CLASS_WORDS) / counts.reshape(-1, CLASS_WORDS).sum(axis=1, keepdims=True)).astype(np.float32),
    }


def _scaled(p):
    """Inputs (symbols x gates) and transposed recurrent weights, so that exp gives the gates: sigmoid(x) is 1 / (1 + exp(-x)), tanh(x) is 1 - 2 / (1 + exp(2 x))."""
    scale = np.repeat(np.array([-1, -1, 2], p["E"].dtype), UNITS)
    return p["E"] * scale, np.ascontiguousarray((p["U"] * scale).T)


def _states(e, u, h, x, train: bool = False):
    """States (steps + 1 x units x lanes, ``h`` first) while each lane reads its column of ``x``, where a text's start drops its
    lane's state; and what the way back needs: gates, what r gates, and where states are kept (None at steps that keep all)."""
    steps, lanes = x.shape
    gates, states = np.empty((steps, 3 * UNITS, lanes), e.dtype), np.empty((steps + 1, UNITS, lanes), e.dtype)
    inner = np.empty((steps if train else 1, UNITS, lanes), e.dtype)
    states[0] = h
    goes_on = x != 0
    kept = [None if whole else goes_on[t].astype(e.dtype) for t, whole in enumerate(goes_on.all(axis=1).tolist())]
    sums, gated = np.empty((3 * UNITS, lanes), e.dtype), np.empty((UNITS, lanes), e.dtype)
    # exp may be infinite, which gives 0 or 1.
    with np.errstate(over="ignore"):
        for t in range(steps):
            before = states[t] if kept[t] is None else states[t] * kept[t]
            np.matmul(u, before, out=sums)
            np.copyto(gates[t], e.take(x[t], axis=0).T)
            zr, n, new = gates[t, : 2 * UNITS], gates[t, 2 * UNITS :], states[t + 1]
            zr += sums[: 2 * UNITS]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[UNITS:], sums[2 * UNITS :], out=gated)
            n += gated
            np.exp(n, out=n)
            n += 1
            np.divide(-2, n, out=n)
            n += 1
            np.subtract(before, n, out=new)
            new *= zr[:UNITS]
            new += n
            if train:
                np.multiply(sums[2 * UNITS :], 0.5, out=inner[t])
    return states, gates, inner, kept


def _blocks(bounds: list[int]):
    """Rows in blocks of at most SOFTMAX_ROWS, each a list of (k, start, end) of rows between ``bounds`` k and k + 1."""
    block, room = [], SOFTMAX_ROWS
    for k, (a, end) in enumerate(pairwise(bounds)):
        while a < end:
            b = min(end, a + room)
            block.append((k, a, b))
            room, a = room - (b - a), b
            if not room:
                yield block
                block, room = [], SOFTMAX_ROWS
    if block:
        yield block


def _softmax(h, weights, bias, bounds, at, got, grads=None, dh=None):
    """Add log-probabilities at ``at`` of each row to ``got``; rows of ``h`` between ``bounds`` k and k + 1 meet ``weights[k]``.

    Gradients of weights and bias are added to ``grads``, those of ``h`` to ``dh``, if asked. Logits are far from
    overflow; the exponentials of biases are factors, as they are the same in all rows.
    """
    factors, classes = np.exp(bias), weights.shape[2]
    if grads is not None:
        g_weights, g_bias, own_weights = np.zeros_like(weights.transpose(0, 2, 1), order="C"), np.zeros_like(bias), np.ascontiguousarray(weights.transpose(0, 2, 1)) * factors[..., None]
    for block in _blocks(bounds):
        first, last = block[0][1], block[-1][2]
        e, total, own_bias = np.empty((last - first, classes), h.dtype), np.empty(last - first, h.dtype), np.empty(last - first, h.dtype)
        own = at[first:last]
        parts = [(k, slice(a, b), slice(a - first, b - first)) for k, a, b in block]
        for k, rows, here in parts:
            np.matmul(h[rows], weights[k], out=e[here])
            bias[k].take(own[here], out=own_bias[here], mode="clip")
        flat, own = e.reshape(-1), own + np.arange(0, e.size, classes)
        log = flat.take(own)
        log += own_bias
        np.exp(e, out=e)
        for k, _, here in parts:
            np.matmul(e[here], factors[k], out=total[here])
        log -= np.log(total)
        got[first:last] += log
        if grads is not None:
            # The sums that divide each row are put to what the row meets.
            flat[own] -= total * np.exp(-own_bias)
            share = 1 / total
            met = h[first:last] * share[:, None]
            for k, rows, here in parts:
                g_weights[k] += np.dot(e[here].T, met[here])
                g_bias[k] += share[here] @ e[here]
                back = e[here] @ own_weights[k]
                back *= share[here, None]
                dh[rows] += back
    if grads is not None:
        g_weights *= factors[..., None]
        g_bias *= factors
        grads[0] += g_weights.transpose(0, 2, 1)
        grads[1] += g_bias


def _classes(targets):
    return np.where(targets < HEAD, targets // CLASS_WORDS, HEAD // CLASS_WORDS + targets - HEAD)


def _outputs(p, hs, targets, grads=None):
    """Log-probabilities of the targets given states; adds to ``grads`` and gives the states' gradient if asked."""
    cls = _classes(targets)
    # In the order of their classes, so that those of a class are one slice.
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cls, word, h = cls.take(order), targets.take(order) % CLASS_WORDS, hs.take(order, axis=0)
    got, dh = np.zeros(len(h)), None if grads is None else np.zeros_like(h)
    bounds = np.searchsorted(cls, np.arange(HEAD // CLASS_WORDS + 1)).tolist()
    into = (None, None) if grads is None else ([grads["C"][None], grads["c"][None]], [grads["W"], grads["w"]])
    _softmax(h, p["C"][None], p["c"][None], [0, len(h)], cls, got, into[0], dh)
    _softmax(h, p["W"], p["w"], bounds, word, got, into[1], dh)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return got.take(back), dh if dh is None else dh.take(back, axis=0)


@dataclass
class Layout:
    """Texts laid out in lanes of about equal length, one after the other in a lane.

    symbols: lanes x steps, the fullest lanes first; loads: steps of each lane; lane and start:
    where each text lies. A text is read behind a 0, and 0 resets the state.
    """

    symbols: np.ndarray
    read: np.ndarray
    loads: np.ndarray
    lane: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray], lanes: int) -> Layout:
        lengths = np.array(list(map(len, texts)), np.int64)
        lanes = int(max(1, min(lanes, lengths.sum() // max(1, lengths.max(initial=1)), len(texts))))
        heap = [(0, i) for i in range(lanes)]
        lane, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for j in np.argsort(-lengths, kind="stable").tolist():
            load, i = heap[0]
            lane[j], start[j] = i, load
            heapreplace(heap, (load + int(lengths[j]), i))
        loads = np.bincount(lane, weights=lengths, minlength=lanes).astype(np.int64)
        order = np.argsort(-loads, kind="stable")
        rank = np.empty(lanes, np.int64)
        rank[order] = np.arange(lanes)
        lane, loads = rank[lane], loads[order]
        symbols = np.zeros((lanes, int(loads.max(initial=0))), np.int16)
        for text, i, at in zip(texts, lane.tolist(), start.tolist(), strict=True):
            symbols[i, at : at + len(text)] = text
        read = np.zeros_like(symbols)
        read[:, 1:] = symbols[:, :-1]
        read[lane, start] = 0
        return cls(symbols, read, loads, lane, start)

    def windows(self, size: int):
        """For each window its first step, lanes that go on at each of its steps, what they read, and what comes next."""
        for s in range(0, self.symbols.shape[1], size):
            steps = np.arange(s, min(s + size, self.symbols.shape[1]))
            going = np.searchsorted(-self.loads, -steps, side="left")
            x, y = (np.ascontiguousarray(side[: int(going[0]), s : s + size].T, dtype=np.int64) for side in (self.read, self.symbols))
            yield s, going.tolist(), x, y


def _keep_freed() -> None:
    """The C library keeps freed memory up to twice the largest array freed, and otherwise asks for fresh pages in each window."""
    np.empty(24 << 20, np.uint8)


def score(p: dict, texts: list[np.ndarray], lanes: int = SCORE_LANES, size: int | None = None) -> np.ndarray:
    """Natural log-probability of each text (symbols that end in 0) but for the shares within tail classes."""
    if not texts:
        return np.zeros(0)
    _keep_freed()
    layout = Layout.of(texts, lanes)
    logs = np.zeros(layout.symbols.shape, np.float32)
    h, weights = np.zeros((UNITS, len(layout.loads)), np.float32), _scaled(p)
    for s, going, x, y in layout.windows(size or max(2 * WINDOW, SCORE_WINDOW_TOKENS // len(layout.loads))):
        steps, g = x.shape
        states = _states(*weights, h[:, :g], x)[0]
        h, own = states[-1], _read(going, g)
        got = np.zeros(steps * g, np.float32)
        got[own] = _outputs(p, _by_token(states[1:])[own], y.reshape(-1)[own])[0]
        logs[:g, s : s + steps] = got.reshape(steps, g).T
    return np.array([logs[i, a : a + len(x)].sum(dtype=np.float64) for x, i, a in zip(texts, layout.lane.tolist(), layout.start.tolist(), strict=True)])


def _by_token(states: np.ndarray) -> np.ndarray:
    """States (steps x units x lanes) as rows of tokens."""
    return np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, states.shape[1])


def _read(going: list[int], lanes: int) -> slice | np.ndarray:
    """Which of a window's tokens, step by step, belong to lanes that still go on."""
    return slice(None) if going[-1] == lanes else np.flatnonzero(np.arange(lanes) < np.array(going)[:, None])


def gradients(p: dict, h: np.ndarray, going: list[int], x: np.ndarray, y: np.ndarray):
    """(log-probability, gradients of its negative, states after the window), back through the window only.

    Lanes that have ended are read on as if they began a text; as nothing follows from that, their gradients are 0.
    """
    grads = {k: np.zeros_like(v) for k, v in p.items() if k != "E"}
    steps, lanes = x.shape
    states, gates, inner, kept = _states(*_scaled(p), h[:, :lanes], x, train=True)
    own, d_out = _read(going, lanes), np.zeros((steps * lanes, UNITS), states.dtype)
    got, d_out[own] = _outputs(p, _by_token(states[1:])[own], y.reshape(-1)[own], grads)
    dh = np.ascontiguousarray(d_out.reshape(steps, lanes, UNITS).transpose(0, 2, 1))
    for t, k in enumerate(kept):
        if k is not None:
            # The state that a step has read; that of the step before it is not needed any more.
            states[t] *= k
    before, z, r, n = states[:-1], gates[:, :UNITS], gates[:, UNITS : 2 * UNITS], gates[:, 2 * UNITS :]
    # Slopes of what z, r and the recurrent part of n take in, by the new state; slope_n: of n's own input.
    keep = 1 - z
    slope_n = 1 - n * n
    slope_n *= keep
    slopes = np.empty((steps, 3, UNITS, lanes), states.dtype)
    np.subtract(before, n, out=slopes[:, 0])
    slopes[:, 0] *= z
    slopes[:, 0] *= keep
    np.multiply(slope_n, r, out=slopes[:, 2])
    np.multiply(slopes[:, 2], inner, out=slopes[:, 1])
    slopes[:, 1] *= 1 - r
    rows, carried, more = slopes.reshape(steps, 3 * UNITS, lanes), np.zeros((UNITS, lanes), states.dtype), np.empty((UNITS, lanes), states.dtype)
    for t in range(steps - 1, -1, -1):
        dh[t] += carried
        slopes[t] *= dh[t]
        np.multiply(dh[t], z[t], out=carried)
        carried += np.matmul(p["U"], rows[t], out=more)
        if kept[t] is not None:
            carried *= kept[t]
    grads["U"] += np.matmul(before, rows.transpose(0, 2, 1)).sum(axis=0)
    np.multiply(dh, slope_n, out=slopes[:, 2])
    read = x.reshape(-1)
    order = np.argsort(read.astype(np.int16), kind="stable")
    read = read.take(order)
    starts = np.flatnonzero(np.diff(read, prepend=-1))
    grads["E"] = read[starts], np.add.reduceat(_by_token(rows).take(order, axis=0), starts, axis=0)
    return got.sum(), grads, states[-1]


class Trainer:
    """Adagrad over windows of texts laid out in lanes; ``state``: weights, and sums of squared gradients under "2" and their names."""

    def __init__(self, state: dict, rate: float = LEARNING_RATE):
        self.rate, self.seen = rate, 0
        self.p = {k: v.copy() for k, v in state.items() if k[0] != "2"}
        self.squares = {k: state["2" + k].copy() for k in self.p}

    @property
    def state(self) -> dict:
        return self.p | {"2" + k: v for k, v in self.squares.items()}

    def learn(self, texts: list[np.ndarray]) -> None:
        parts = [t[i : i + STRETCH] for t in texts for i in range(0, len(t), STRETCH)]
        layout = Layout.of(parts, min(TRAIN_LANES, max(8, sum(map(len, parts)) // (LEAST_STEPS * WINDOW))))
        h = np.zeros((UNITS, len(layout.loads)), np.float32)
        _keep_freed()
        for _, going, x, y in layout.windows(WINDOW):
            _, grads, h = gradients(self.p, h, going, x, y)
            n = sum(going)
            self.seen += n
            scale = np.float32(8.0 / max(n, 256))
            for k, g in grads.items():
                at, g = (g[0], g[1]) if k == "E" else (slice(None), g)
                g *= scale
                squares = self.squares[k][at] + g * g
                self.squares[k][at] = squares
                # Biases hold the words' frequencies over the whole corpus from the start.
                rate = np.float32(self.rate * (BIAS_RATE if k in "cw" else 1.0))
                g *= rate
                g /= np.sqrt(squares, out=squares)
                self.p[k][at] -= g


def begun(v: Vocabulary) -> dict:
    p = initial(v)
    return p | {"2" + k: np.full_like(x, 0.02) for k, x in p.items()}


def rounds_of(train_tokens: int, group_tokens: int = GROUP_TOKENS) -> list[int]:
    """Groups that each round trains side by side; both their number and that of rounds grow with the corpus."""
    groups = -(-max(1, train_tokens) // group_tokens)
    rounds = max(LEAST_ROUNDS, math.ceil(math.log2(groups)))
    return [max(1, -(-groups // rounds))] * rounds


_BLOCK = 4096


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def _added(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of blocks of weights, by group."""
    schema = ", ".join(f"{c} int" for c in by) + ", weight double, block_values array<double>"

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x.values) for x in table["block_values"]], axis=0)
        weight = float(np.sum(table["weight"].to_numpy()))
        return pa.table({**{c: pa.array([table[c][0].as_py()], pa.int32()) for c in by}, "weight": [weight], "block_values": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return rows.select(*by, "weight", "block_values").groupBy(*by).applyInArrow(add, schema)


def train_round(rows: DataFrame, state: dict) -> dict:
    """Train from ``state`` on each group of ``rows`` (g, key, z); the mean of what they learned, weighted by tokens.

    A group reads its documents in an order that they fix themselves, so that how rows are laid
    out in partitions changes nothing.
    """

    def learn(table: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor().decompress
        trainer = Trainer(state)
        trainer.learn([np.frombuffer(unpress(z), "<i2") for _, z in sorted(zip(table["key"].to_pylist(), table["z"].to_pylist(), strict=True))])
        flat = _flat(trainer.state).astype(np.float64) * trainer.seen
        values = [flat[i : i + _BLOCK].tolist() for i in range(0, len(flat), _BLOCK)]
        n, g = len(values), table["g"][0].as_py()
        return pa.table({"block": pa.array(range(n), pa.int32()), "g": pa.array([g] * n, pa.int32()), "weight": [float(trainer.seen)] * n, "block_values": pa.array(values, pa.list_(pa.float64()))})

    learned = rows.select("g", "key", "z").groupBy("g").applyInArrow(learn, "block int, g int, weight double, block_values array<double>")
    # Sums go up a tree with FAN_IN rows in each of its groups.
    sums, groups = learned, rows.agg(F.max("g")).first()[0]
    if groups is None:
        return state
    while groups >= FAN_IN:
        sums, groups = _added(sums.withColumn("g", F.floor(F.col("g") / FAN_IN).cast("int")), "block", "g"), groups // FAN_IN
    done = _added(sums, "block").collect()
    flat = np.concatenate([np.array(r["block_values"]) / r["weight"] for r in sorted(done, key=lambda r: r["block"])])
    return _shaped(flat, state)


# The corpus ----------------------------------------------------------------------------

_PACKED = "g long, doc_id long, held_out boolean, key long, ids binary, word string, lid int, n long"
_SYMBOLS = "doc_id long, held_out boolean, key long, n_tokens long, n_known long, base_score double, share double, z binary"
#: Tokens that a task scores at once, but for longer documents.
SCORE_TOKENS = 1 << 22


def packed(docs: DataFrame) -> DataFrame:
    """Two kinds of rows for each dictionary g: documents as word numbers (compressed), and words with their training counts."""

    def run(batches):
        made, press = 0, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "text", DICTIONARY_BYTES):
                numbers: dict[bytes, int] = defaultdict()
                numbers.default_factory = numbers.__len__
                ids, learned = [], []
                for text, out in zip(part["text"], part["held_out"].to_pylist(), strict=True):
                    words = tokens_of(text.as_py())
                    own = np.fromiter(map(numbers.__getitem__, words), "<u4", len(words))
                    ids.append(press(own.tobytes()))
                    if not out:
                        learned.append(own)
                counts = np.bincount(np.concatenate([*learned, np.zeros(0, np.uint32)]), minlength=len(numbers))
                del learned
                g = TaskContext.get().partitionId() << 24 | made
                made += 1
                n, m = part.num_rows, len(numbers)
                null = pa.nulls
                yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.int64()), part["doc_id"], part["held_out"], part["key"], pa.array(ids, pa.binary()), null(n, pa.string()), null(n, pa.int32()), null(n, pa.int64())], schema=schema)
                every = iter(numbers)
                for i in range(0, m, 1 << 16):
                    words = [w.decode() for w in islice(every, 1 << 16)]
                    k = len(words)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * k, pa.int64()), null(k, pa.int64()), null(k, pa.bool_()), null(k, pa.int64()), null(k, pa.binary()), pa.array(words, pa.string()), pa.array(range(i, i + k), pa.int32()), pa.array(counts[i : i + k])], schema=schema)

    schema = pa.schema([("g", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("key", pa.int64()), ("ids", pa.binary()), ("word", pa.string()), ("lid", pa.int32()), ("n", pa.int64())])
    return docs.mapInArrow(run, _PACKED)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """From (word, c) of all training words; the driver gets the head, and sums for each tail class."""
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD - 1).collect()
    head = {r["word"].encode(): i + 1 for i, r in enumerate(top)}
    head_counts = np.zeros(HEAD)
    head_counts[0] = ends
    head_counts[1 : len(top) + 1] = [r["c"] for r in top]
    names = counts.sparkSession.createDataFrame([(r["word"],) for r in top], "word string")
    tail = counts.join(F.broadcast(names), "word", "left_anti").withColumn("ending", F.expr(_ENDING))
    sums = tail.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("words"))
    kept = sums.orderBy(F.desc("c"), "ending").limit(TAIL_CLASSES - 1).collect()
    total = sums.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    tokens, words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for i, r in enumerate(kept):
        tokens[i], words[i] = r["c"], r["words"]
    tokens[-1], words[-1] = total["c"] - tokens.sum(), total["words"] - words.sum()
    return Vocabulary(head, head_counts, {r["ending"]: i for i, r in enumerate(kept)}, tokens, words, int(head_counts.sum() + total["c"]), len(top) + int(total["words"]) + (ends > 0))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def with_symbols(counts: DataFrame, v: Vocabulary) -> DataFrame:
    """``counts`` (word, c) with the symbol of each word, as `Vocabulary.symbol` gives it."""
    spark = counts.sparkSession
    head = spark.createDataFrame([(w.decode(), i) for w, i in v.head.items()], "word string, own int")
    tail = spark.createDataFrame(list(v.endings.items()), "ending string, class int")
    rows = counts.withColumn("ending", F.expr(_ENDING)).join(F.broadcast(head), "word", "left").join(F.broadcast(tail), "ending", "left")
    return rows.select("word", "c", F.coalesce("own", F.lit(HEAD) + F.coalesce("class", F.lit(TAIL_CLASSES - 1))).cast("short").alias("symbol"))


def symbol_table(rows: DataFrame, counts: DataFrame, v: Vocabulary, rounds: list[int]) -> DataFrame:
    """_SYMBOLS of each document of ``rows`` (`packed`), with what does not need the network, and the round and group g that learn from it, by hashes of its key; round -1 for those held out.

    Each distinct word gets its count and symbol once, and goes back to the dictionaries that have it.
    """
    words = rows.where("word IS NOT NULL").select("g", "word", "lid")
    entries = words.join(with_symbols(counts, v), "word").select(F.col("g").alias("of"), "lid", "c", "symbol")

    def look_up(documents: pa.Table, entries: pa.Table) -> pa.Table:
        order = np.argsort(entries["lid"].to_numpy())
        c, symbol = entries["c"].to_numpy()[order].astype(np.float64), entries["symbol"].to_numpy()[order].astype("<i2")
        base, share, known = v.base(c), v.in_tail(symbol.astype(np.int64), c), c > 0
        unpress, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        ids = [np.frombuffer(unpress(x), "<u4") for x in documents["ids"].to_pylist()]
        ends = v.head_counts[0]
        return pa.table(
            {
                "doc_id": documents["doc_id"], "held_out": documents["held_out"], "key": documents["key"], "n_tokens": [len(x) + 1 for x in ids], "n_known": [int(known[x].sum()) + int(ends > 0) for x in ids],
                "base_score": [float(base[x].sum() + v.base(ends)) for x in ids], "share": [float(share[x].sum()) for x in ids], "z": [press(np.append(symbol[x], np.int16(0)).astype("<i2").tobytes()) for x in ids],
            }
        )

    documents = rows.where("word IS NULL").select("g", "doc_id", "held_out", "key", "ids")
    found = documents.groupBy("g").cogroup(entries.groupBy("of")).applyInArrow(look_up, _SYMBOLS)
    turn = F.pmod("key", F.lit(len(rounds))).cast("int")
    groups = F.element_at(F.array(*map(F.lit, rounds)), turn + 1)
    return found.withColumns({"round": F.when(F.col("held_out"), F.lit(-1)).otherwise(turn), "g": F.pmod(F.xxhash64("key", F.lit("group")), groups).cast("int")})


def trained(read: Callable[[], DataFrame], v: Vocabulary, rounds: list[int]) -> dict:
    """Weights after all rounds over the `symbol_table` that ``read`` gives; each document is learned from once, in one of them."""
    state = begun(v)
    for i in range(len(rounds)):
        state = train_round(read().where(F.col("round") == i), state)
    return {k: x for k, x in state.items() if k[0] != "2"}


def _scored(rows: DataFrame, p: dict, train_tokens: int) -> DataFrame:
    """SCORES of the documents of a `symbol_table`, about `SCORE_TOKENS` at once."""

    def rate(part: pa.Table) -> pa.RecordBatch:
        unpress = zstandard.ZstdDecompressor().decompress
        got = score(p, [np.frombuffer(unpress(z), "<i2") for z in part["z"].to_pylist()])
        part = part.append_column("train_tokens", pa.array([train_tokens] * part.num_rows, pa.int64())).append_column("score", pa.array((got + part["share"].to_numpy()) / np.log(10)))
        return part.select([c.split()[0] for c in SCORES.split(", ")]).combine_chunks().to_batches()[0]

    def run(batches):
        kept, n = [], 0
        for batch in batches:
            tokens, at = np.cumsum(batch["n_tokens"].to_numpy()), 0
            while at < batch.num_rows:
                before = int(tokens[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(tokens, before + SCORE_TOKENS - n, side="right")))
                kept.append(batch.slice(at, upto - at))
                n, at = n + int(tokens[upto - 1]) - before, upto
                if n >= SCORE_TOKENS or at < batch.num_rows:
                    yield rate(pa.Table.from_batches(kept))
                    kept, n = [], 0
        if kept:
            yield rate(pa.Table.from_batches(kept))

    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "share", "z").mapInArrow(run, SCORES)


def score_documents(docs: DataFrame, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORES of every row; documents whose id has a CRC-32 divisible by 10 are held out of all that is learned.

    base_score: add-0.1 unigram; score: the network's; both log10 over all tokens with the end. A
    null text is empty: its end alone. Words count over all training rows, and the network is
    trained on all of them, each once, in groups of about ``group_tokens`` tokens. Repeated rows
    count and are scored one by one, a null id counts as an empty text for the hold-out, an empty
    table gives no rows, other columns are not read. Words get their counts by a join on the word
    and go back to their dictionaries, none of which is broadcast. How rows are laid out in
    partitions changes no result but by rounding.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumns({"held_out": F.pmod(crc32_of(F.col("doc_id")), F.lit(10)) == 0, "key": F.xxhash64("doc_id", "text")})
    rows = staged(packed(docs), "packed")
    words = rows.where("word IS NOT NULL")
    counts = staged(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    v = vocabulary(counts.where("c > 0"), rows.where("word IS NULL AND NOT held_out").count())
    rounds = rounds_of(v.train_tokens, group_tokens)
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/symbols-{uuid.uuid4().hex}"
    symbols = symbol_table(rows, counts, v, rounds)
    symbols.write.option("compression", "none").partitionBy("round").parquet(path)
    read = lambda: spark.read.schema(symbols.schema).parquet(path)
    return _scored(read(), trained(read, v, rounds), v.train_tokens)
