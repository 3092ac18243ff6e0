"""Personal data: patterns, and a skip-chain conditional random field that adds to them.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The field looks at
all tokens that could be part of such data. Neighbours share potentials, and so do equal or
similar tokens anywhere in the document; loopy message passing carries the evidence of one
mention to the others. It is trained here, on what the patterns find in a sample of documents.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import map_arrow, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Documents (expected number) that the field learns from.
SAMPLE_DOCS = 8000
#: Probability from which a token is added, message rounds, and how the weight of skip edges decays in training.
LEAST = 0.9
ROUNDS = 12
SKIP_DECAY = 1e-3
#: Evidence, in nats, that a token which a pattern has matched is of that kind: certain, whatever tokens like it say.
SEEN_WEIGHT = 1e4

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting anywhere but at the first digit of a run finds nothing that starting there does not.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Matches from left to right, each found from its @, so that long runs cost no more than their length."""
    ended, at = 0, text.find("@")
    while at >= 0:
        domain = _AT.match(text, at)
        if domain:
            start = at
            while start > ended and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                ended = domain.end()
                yield start, ended
                at = text.find("@", ended)
                continue
        at = text.find("@", at + 1)


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of all matches, in order."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# The field -----------------------------------------------------------------------------

FEATURES = 24
#: Bits of the features that do not show a kind: the constant, amounts of digits, letters, neighbours.
PLAIN = 1 | sum(1 << i for i in range(15, FEATURES))
#: What training counts: a token's features, labels of its neighbours and of tokens like it, its label.
SEEN = ("bits", "before", "after", "like_before", "like_after", "y")
#: Digits of a card and of a phone number, by label.
MOST_DIGITS = {3: 19, 4: 15}
_STRIP = ".,;:!?\"'()[]<>{}|*#$%&"


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or @: all that the field may label."""
    return [m.span() for m in _TOKEN.finditer(text) if _ANY.search(m[0])]


def features(tokens: list[str], near_before: list[bool], near_after: list[bool]) -> np.ndarray:
    """Binary features of candidate tokens (tokens x FEATURES)."""
    out = np.zeros((len(tokens), FEATURES), np.float32)
    for i, raw in enumerate(tokens):
        t = raw.strip(_STRIP)
        d = _digits(t)
        n = len(d)
        before = tokens[i - 1] if near_before[i] else ""
        after = tokens[i + 1] if near_after[i] else ""
        run = n + len(_digits(after)) + (len(_digits(tokens[i + 2])) if near_after[i] and i + 2 < len(tokens) and near_after[i + 1] else 0)
        name, _, domain = t.partition("@")
        parts = t.split(".")
        ip = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 for p in parts)
        plain = n == sum(c not in "- " for c in t)
        out[i] = (
            1, bool(name and domain), bool(name and "." in domain.strip(".")), "@" in t, ip and all(int(p) <= 255 for p in parts), ip, len(parts) == 4 and n > 3, plain and 14 <= n <= 19 and luhn(d), plain and 14 <= n <= 19,
            plain and n > 19, raw.startswith("+") and n > 0, raw.startswith("+") and 10 <= run <= 15, raw.startswith("(") and ")" in raw, before.startswith("+"), before.startswith("("), "-" in t and 6 <= n <= 8, 0 < n <= 2, 2 < n <= 4,
            4 < n <= 9, 9 < n <= 13, any(c.isalpha() for c in t), near_before[i], near_after[i], n > 0 and 2 * n >= len(t),
        )
    return out


def likeness_keys(token: str) -> list[str]:
    """Names under which a token meets others: its plain form, the local part before an @, and its digits."""
    t = token.strip(_STRIP).lower()
    keys = ["t" + t.partition("@")[0]] if len(t) > 3 else []
    d = _digits(t)
    if len(d) >= 7:
        keys.append("d" + d[-10:])
    return keys


def graph(text: str, base=()) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, features, chain edges and skip edges.

    Tokens that are like each other are linked with one of them: the first that a base span covers, else the first. So
    each has the evidence of a match at first hand, however often the others are mentioned.
    """
    spans = candidates(text)
    tokens = [text[a:b] for a, b in spans]
    near = [b0 == a1 - 1 for (_, b0), (a1, _) in zip(spans, spans[1:], strict=False)]
    chain = np.flatnonzero(near)
    kind = weak_labels(spans, base)
    alike: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        for key in likeness_keys(t):
            alike.setdefault(key, []).append(i)
    skips = set()
    for group in alike.values():
        hub = next((i for i in group if kind[i]), group[0])
        skips.update((hub, i) for i in group if i != hub)
    skip = np.array(sorted(skips), np.int64).reshape(-1, 2)
    return spans, features(tokens, [False, *near][: len(tokens)], [*near, False][: len(tokens)]), np.column_stack([chain, chain + 1]), skip


@dataclass
class Field:
    """Weights of features (FEATURES x labels), of neighbours' labels, and of skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS, seen: np.ndarray | None = None) -> np.ndarray:
        """Beliefs after some rounds of loopy sum-product messages, all edges at once.

        ``seen``: labels that are known (0: not known), as evidence of weight SEEN_WEIGHT.
        """
        phi = x @ self.unary
        if seen is not None:
            known = np.flatnonzero(seen)
            phi[known, seen[known]] += SEEN_WEIGHT
        edges = np.concatenate([chain, skip])
        if len(edges):
            pair = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
            to, back = np.zeros((len(edges), len(LABELS))), np.zeros((len(edges), len(LABELS)))
            a, b = edges.T
            for _ in range(rounds):
                total = phi.copy()
                np.add.at(total, b, to)
                np.add.at(total, a, back)
                new_to = np.logaddexp.reduce((total[a] - back)[:, :, None] + pair, axis=1)
                new_back = np.logaddexp.reduce((total[b] - to)[:, None, :] + pair, axis=2)
                to, back = (0.5 * (old + new - new.max(axis=1, keepdims=True)) for old, new in ((to, new_to), (back, new_back)))
            np.add.at(phi, b, to)
            np.add.at(phi, a, back)
        p = np.exp(phi - phi.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def weak_labels(spans, base) -> np.ndarray:
    """The kind of the first pattern match that a token overlaps, else 0; each match is looked up by its start."""
    out = np.zeros(len(spans), np.int64)
    ends = [e for _, e in spans]
    for a, k, b in base:
        i = bisect_right(ends, a)
        while i < len(spans) and spans[i][0] < b:
            out[i] = out[i] or k + 1
            i += 1
    return out


def fit(x: np.ndarray, before: np.ndarray, after: np.ndarray, like_before: np.ndarray, like_after: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600) -> Field:
    """Pseudo-likelihood: each token's label given its features, its neighbours' labels and those of tokens like it (-1: none).

    Skip edges have one weight, learned with the others, for ends of equal labels.
    """
    n = len(LABELS)
    one = np.concatenate([np.eye(n), np.zeros((1, n))])
    data = np.concatenate([x, one[before], one[after]], axis=1).astype(np.float64)
    alike = one[like_before] + one[like_after]
    w, skip = np.zeros((data.shape[1], n)), 0.0
    target = one[y]
    total = max(weight.sum(), 1.0)
    linked = max((weight * (alike.sum(axis=1) > 0)).sum(), 1.0)
    speed, skip_speed = np.zeros_like(w), 0.0
    for _ in range(steps if len(y) else 0):
        s = data @ w + skip * alike
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = (target - p) * weight[:, None]
        speed = 0.9 * speed + 0.2 * (data.T @ miss / total - 1e-5 * w)
        skip_speed = 0.9 * skip_speed + 0.2 * ((alike * miss).sum() / linked - SKIP_DECAY * skip)
        w += speed
        skip += skip_speed
    if not len(y):
        w[0, 0] = 20.0
    k = FEATURES
    return Field(w[:k], (w[k : k + n] + w[k + n :].T) / 2, max(skip, 0.0) * np.eye(n))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field that has learned the patterns' labels on about ``sample_docs`` documents, chosen by a hash of the id.

    A token like another counts twice: as it is, and with only its plain features, so that the
    skip edges learn what a mention tells of one that does not show its kind. What the driver
    gets are distinct (features, neighbours' labels, label) with how often.
    """
    n = docs.count()
    rows = docs.select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("h"))
    rows = rows.where(F.col("h") < int(min(1.0, sample_docs / max(1, n)) * (1 << 30))).select("text").where(F.col("text").rlike("[0-9@]"))

    def task():
        def work(batch: pa.RecordBatch):
            found: Counter = Counter()
            for text in batch["text"].to_pylist():
                base = base_spans(text)
                spans, x, chain, skip = graph(text, base)
                y = weak_labels(spans, base)
                before, after, like_before, like_after = (np.full(len(y), -1) for _ in range(4))
                before[chain[:, 1]], after[chain[:, 0]] = y[chain[:, 0]], y[chain[:, 1]]
                like_before[skip[:, 1]], like_after[skip[:, 0]] = y[skip[:, 0]], y[skip[:, 1]]
                bits = x.astype(np.int64) @ (1 << np.arange(FEATURES, dtype=np.int64))
                labels = before, after, like_before, like_after, y
                found.update(zip(bits.tolist(), *(c.tolist() for c in labels), strict=True))
                linked = np.flatnonzero((like_before >= 0) | (like_after >= 0))
                found.update(zip((bits[linked] & PLAIN).tolist(), *(c[linked].tolist() for c in labels), strict=True))
            yield pa.table([*(list(map(list, zip(*found, strict=True))) or [[] for _ in SEEN]), list(found.values())], names=[*SEEN, "n"])

        return work

    found = map_arrow(rows, task, ", ".join(f"{c} long" for c in (*SEEN, "n"))).groupBy(*SEEN).agg(F.sum("n").alias("n")).orderBy(*SEEN).toPandas()
    x = (found["bits"].to_numpy(np.int64)[:, None] >> np.arange(FEATURES) & 1).astype(np.float32)
    return fit(x, *(found[c].to_numpy(np.int64) for c in SEEN[1:]), found["n"].to_numpy(np.float64))


def _mentions(text: str, spans, i: int, j: int, label: int):
    """Tokens i to j, neighbours of one label, as mentions: an address each, or numbers of no more digits than the kind has."""
    start, digits = i, 0
    for t in range(i, j + 1):
        token = text[slice(*spans[t])]
        n = len(_digits(token))
        if t > start and (label <= 2 or digits + n > MOST_DIGITS[label] or (label == 4 and token.startswith("+"))):
            yield spans[start][0], spans[t - 1][1]
            start, digits = t, 0
        digits += n
    yield spans[start][0], spans[j][1]


def added_spans(text: str, base, field: Field, least: float = LEAST) -> list[tuple[int, int, int]]:
    """What the field finds beside the base spans: mentions in runs of neighbouring tokens of one label, without outer punctuation."""
    spans, x, chain, skip = graph(text, base)
    p = field.marginals(x, chain, skip, seen=weak_labels(spans, base))
    label = np.where(p.max(axis=1) >= least, p.argmax(axis=1), 0)
    near = set(chain[:, 0].tolist())
    out: list[list[int]] = []
    starts = [a for a, _, _ in base]
    reach = np.maximum.accumulate([b for *_, b in base]).tolist() if base else []
    i = 0
    while i < len(spans):
        j = i
        while j in near and label[j + 1] == label[i]:
            j += 1
        if label[i]:
            for a, b in _mentions(text, spans, i, j, int(label[i])):
                before = bisect_left(starts, b)
                if before and reach[before - 1] > a:
                    continue
                while a < b and text[a] in _STRIP:
                    a += 1
                while a < b and text[b - 1] in _STRIP:
                    b -= 1
                out.append([a, int(label[i]) - 1, b])
        i = j + 1
    return [tuple(x) for x in out if x[0] < x[2]]


def find(text: str | None, field: Field, least: float = LEAST):
    """(base spans, all spans) of a text."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, field, least))


def masked(text: str | None, spans) -> str | None:
    """``text`` with each span (overlapping ones as one) replaced by the name of its first kind."""
    if not spans:
        return text
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join(out) + text[at:]


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, field: Field, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, FOUND) of every row; counts and base_sha256 are of the base spans, spans of all.

    A null text is empty. Repeated rows are each searched, an empty table gives no rows, other
    columns are not read. Time grows with the length of a text, also of one long run of digits.
    """

    def task():
        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                rows = []
                for text in part["text"].to_pylist():
                    base, spans = find(text, field, least)
                    kinds = Counter(k for _, k, _ in base)
                    rows.append((*(kinds[k] for k in range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                yield pa.table([part["doc_id"], *map(list, zip(*rows, strict=True))], names=["doc_id", *[c.split()[0] for c in FOUND.split(", ")]])

        return work

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), task, "doc_id long, " + FOUND)


def mask_personal_data(docs: DataFrame, field: Field, least: float = LEAST, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span in its text masked, and ``chars_col`` (where there is one of integers) set to the new length.

    Null and empty texts stay, as do texts without a span and their ``chars_col``; repeated rows
    are masked one by one, an empty table gives no rows, and all other columns stay as they are.
    """

    def task():
        def work(batch: pa.RecordBatch):
            for part in slices(batch, text_col):
                texts = part[text_col].to_pylist()
                new = [masked(t, find(t, field, least)[1]) for t in texts]
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                columns[text_col] = pa.array(new, pa.string())
                if chars_col in columns and pa.types.is_integer(columns[chars_col].type):
                    same = [a == b for a, b in zip(texts, new, strict=True)]
                    old = columns[chars_col]
                    columns[chars_col] = pa.array([c if s else len(t) for c, s, t in zip(old.to_pylist(), same, new, strict=True)], old.type)
                yield pa.table(columns)

        return work

    return map_arrow(docs, task, docs.schema)
