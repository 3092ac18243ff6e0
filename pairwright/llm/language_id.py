"""Language identification of spans.

Script ranges narrow the languages that a word may be in. Character n-grams score it in
each of those, and Viterbi over the words of a text, with a penalty for each switch, labels
spans. All that is learned is counts of hashed n-grams by language and letters by script.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import WordCache, map_arrow, slices, words_of
from pairwright.llm.scripts import SCRIPTS, code_points, script_ids

#: Hashed n-grams; a model holds one number for each of these and each language.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: A script belongs to a language that writes so large a part of its letters in it.
SCRIPT_SHARE = 0.01
#: What a switch between languages costs, in nats, and how much a word's n-grams count.
SWITCH = 12.0
TEMPER = 0.5
UNKNOWN = "und"
#: Words that Viterbi handles side by side.
LATTICE_WORDS = 4 << 20


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of words: bucket, word; and for each word its script and letters."""
    texts = [w.decode().lower().replace("\x02", "") for w in words]
    points = code_points("\x02" + "\x02".join(texts) + "\x02").astype(np.uint64)
    edge = points == 2
    word = np.cumsum(edge) - 1
    scripts = script_ids(points.astype(np.uint32))
    letter = scripts > 0
    letters = np.bincount(word[letter], minlength=len(words))
    share = np.bincount(word[letter] * len(SCRIPTS) + scripts[letter], minlength=len(words) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
    keep = letter | edge
    at, owner = points[keep], word[keep]
    bucket, of = [], []
    for n in ORDERS:
        h = np.full(max(0, len(at) - n + 1), n, np.uint64)
        for j in range(n):
            h = (h ^ at[j : len(at) - n + 1 + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        inside = (at[: len(h)] != 2) | (at[1 : len(h) + 1] != 2) if n > 1 else at != 2
        for j in range(1, n - 1):
            inside &= at[j : len(h) + j] != 2
        bucket.append((h % np.uint64(BUCKETS)).astype(np.int64)[inside])
        of.append(owner[: len(h)][inside])
    bucket, of = np.concatenate(bucket), np.concatenate(of)
    good = letters[np.minimum(of, len(words) - 1)] > 0
    return bucket[good], of[good], share.argmax(axis=1), letters


@dataclass
class Model:
    """languages, log-probability of each bucket (BUCKETS x languages), and scripts that a language uses."""

    languages: list[str]
    log_p: np.ndarray
    uses: np.ndarray

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (words x languages), letters of each word, and those in a script that some language uses; words without letters score 0."""
        bucket, of, script, letters = _grams(words)
        order = np.argsort(of, kind="stable")
        scores = np.zeros((len(words), len(self.languages)), np.float32)
        if len(of):
            bucket, of = bucket[order], of[order]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            scores[of[starts]] = np.add.reduceat(self.log_p[bucket], starts, axis=0)
        scores -= scores.max(axis=1, keepdims=True)
        scores *= TEMPER
        known = self.uses[script].any(axis=1)
        allowed = self.uses[script] | ~known[:, None]
        scores[~allowed & (letters > 0)[:, None]] = -1e4
        return scores, letters, letters * known


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows of ``docs`` whose text and language are not null; without such rows, or such a column, no language is learned.

    The driver gets BUCKETS counts a language at most.
    """

    def task():
        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                by: dict = {}
                for text, lang in zip(part["text"].to_pylist(), part["lang"].to_pylist(), strict=True):
                    by.setdefault(lang, []).extend(words_of(text))
                for lang, words in by.items():
                    kinds: dict = {}
                    for w in words:
                        kinds[w] = kinds.get(w, 0) + 1
                    if not kinds:
                        continue
                    n = np.fromiter(kinds.values(), np.int64, len(kinds))
                    bucket, of, script, letters = _grams(list(kinds))
                    grams = np.bincount(bucket, weights=n[of], minlength=BUCKETS)
                    written = np.bincount(script, weights=letters * n, minlength=len(SCRIPTS))
                    both = np.concatenate([grams, written]).astype(np.int64)
                    found = np.flatnonzero(both)
                    yield pa.table([[lang] * len(found), found, both[found]], names=["lang", "bucket", "n"])

        return work

    rows = docs.select(F.col(text_col).alias("text"), (F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = map_arrow(rows, task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique().tolist())
    table = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    table[counts["bucket"], counts["lang"].map({x: i for i, x in enumerate(languages)}).astype(int)] = counts["n"]
    grams, written = table[:BUCKETS], table[BUCKETS:].copy()
    written[0] = 0
    log_p = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(languages, log_p, written >= SCRIPT_SHARE * np.maximum(written.sum(axis=0), 1))


def viterbi(lengths: np.ndarray, ids: np.ndarray, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of the words of many texts at once.

    ids: word numbers, text after text; scores: a row of languages for each word number.
    """
    labels = np.zeros(len(ids), np.int16)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        group = order[at : at + max(1, LATTICE_WORDS // int(lengths[order[at]]))]
        at += len(group)
        _lattice(lengths[group], starts[group], ids, scores, switch, labels)
    return labels


def _lattice(lengths, starts, ids, scores, switch, labels) -> None:
    """Texts in falling length; those that go on at step t come first."""
    going = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    value = np.zeros((len(lengths), scores.shape[1]), np.float32)
    last = np.zeros(len(lengths), np.int16)
    stays, bests = [], []
    for t, g in enumerate(going):
        now = scores[ids[starts[:g] + t]]
        if t:
            last[g : len(value)] = value[g:].argmax(axis=1)
            value = value[:g]
            best = value.argmax(axis=1)
            moved = (value[np.arange(g), best] - switch)[:, None]
            stay = value >= moved
            value = np.where(stay, value, moved) + now
            stays.append(stay)
            bests.append(best.astype(np.int16))
        else:
            value = value + now
    last[: len(value)] = value.argmax(axis=1)
    label = last
    for t in range(len(going) - 1, -1, -1):
        g = going[t]
        labels[starts[:g] + t] = label[:g]
        if t:
            stay = stays[t - 1][np.arange(g), label[:g]]
            label[:g] = np.where(stay, label[:g], bests[t - 1])


def _predictor(model: Model, switch: float):
    """texts -> (language, score, spans), where spans are (language, first word, words)."""
    none = len(model.languages) == 0
    cache = WordCache(None)
    table = [np.zeros((1024, max(1, len(model.languages))), np.float32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)]

    def numbered(texts):
        lists = [words_of(t) for t in texts]
        new = [w for w in set().union(*lists) if w not in cache]
        need = len(cache) + len(new)
        while need > len(table[0]):
            for i in range(3):
                table[i] = np.concatenate([table[i], np.zeros_like(table[i])])
        for i in range(0, len(new), 1 << 16):
            part = new[i : i + (1 << 16)]
            n = len(cache)
            for kept, new_rows in zip(table, model.word_scores(part), strict=True):
                kept[n : n + len(part)] = new_rows
            cache.update(zip(part, range(n, n + len(part)), strict=True))
        return [np.fromiter(map(cache.__getitem__, x), np.int32, len(x)) for x in lists]

    def predict(parts):
        """parts: lists of texts that are numbered one list after the other."""
        if len(cache) > cache.entries:
            cache.clear()
        lists = [x for part in parts for x in (numbered(part) if not none else [np.zeros(0, np.int32)] * len(part))]
        lengths = np.array(list(map(len, lists)), np.int64)
        ids = np.concatenate([*lists, np.zeros(0, np.int32)])
        labels = viterbi(lengths, ids, table[0], switch)
        letters, own = table[1][ids], table[2][ids]
        ends = np.cumsum(lengths)
        out = []
        for a, b in zip(ends - lengths, ends, strict=True):
            sums = np.bincount(labels[a:b], weights=letters[a:b], minlength=len(model.languages)) if b > a else np.zeros(1)
            total = sums.sum()
            if not total:
                out.append((UNKNOWN, 0.0, []))
                continue
            best = int(sums.argmax())
            mine = own[a:b][labels[a:b] == best].sum()
            cut = np.flatnonzero(np.diff(labels[a:b], prepend=-1))
            sizes = np.diff(cut, append=b - a)
            out.append((model.languages[best], float(mine / total), [(model.languages[labels[a + i]], int(i), int(n)) for i, n in zip(cut, sizes, strict=True)]))
        return out

    return predict


SPANS = "array<struct<lang:string,first_word:long,n_words:long>>"


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row, from its text alone.

    lang_pred: the language with the most letters, the first in alphabetical order of equals;
    score: the part of the letters that are its own, in scripts that a language uses (letters in
    other scripts are labelled, but nobody's); spans: runs of words in one language. A null text, or one
    without a letter (or a model without languages), is ``und`` with score 0 and no spans.
    Repeated rows are each labelled, an empty table gives no rows, other columns are not read.
    """

    def task():
        predict = _predictor(model, switch)

        def work(batch: pa.RecordBatch):
            got = predict(part["text"].to_pylist() for part in slices(batch, "text"))
            spans = pa.array([[{"lang": x, "first_word": i, "n_words": n} for x, i, n in s] for *_, s in got], pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])))
            yield pa.table([batch["doc_id"], [x[0] for x in got], [x[1] for x in got], spans], names=["doc_id", "lang_pred", "score", "spans"])

        return work

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id long, lang_pred string, score double, spans {SPANS}")


def language_filter(docs: DataFrame, model: Model, languages: list[str] | None = None, least: float = 0.5, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` in one of ``languages`` (default: all learned) for at least ``least`` of their letters.

    Letters in a script that no learned language uses are in none of them. Null texts and texts
    without letters go, as does every row under a model without languages; repeated rows are
    judged one by one, an empty table gives no rows, and all columns stay, whatever their names.
    """
    wanted = set(languages if languages is not None else model.languages)

    def task():
        predict = _predictor(model, switch)

        def work(batch: pa.RecordBatch):
            got = predict(part[text_col].to_pylist() for part in slices(batch, text_col))
            yield batch.filter(pa.array([x in wanted and s >= least for x, s, _ in got], pa.bool_()))

        return work

    return map_arrow(docs, task, docs.schema)
