"""Quality rules by tokeniser fertility.

Public vocabularies cut each word into pieces: one with byte fallback, and a byte-level one for
many languages. Characters per piece of both, and the share of byte-fallback pieces and the
entropy of the pieces of the first are held against bands of a document's language, or of its
script where the language has none.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from pairwright.llm.common import WordCache, map_arrow, slices, words_of
from pairwright.llm.scripts import SCRIPTS, script_counts

MODEL = "piece_bpe_32k.model"
MULTI = "byte_bpe_multi_50k.tiktoken"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Characters per token from ``low`` to ``high``, a most byte share, and a least entropy.

    The least entropy is ``bits`` at twice ENTROPY_TOKENS and ``growth`` more each time that the
    tokens double, up to ``top``; with fewer tokens it is no more than ``share`` of the most
    that so few can have. ``multi_low`` and ``multi_high`` are for characters per token of the
    second vocabulary.
    """

    low: float
    high: float
    bytes_most: float
    bits: float
    share: float
    growth: float = 0.0
    top: float = 20.0
    multi_low: float = 0.2
    multi_high: float = 8.0

    def least_entropy(self, tokens: int) -> float:
        if tokens < 2 * ENTROPY_TOKENS:
            return min(self.bits, self.share * math.log2(tokens))
        return min(self.top, self.bits + self.growth * math.log2(tokens / (2 * ENTROPY_TOKENS)))


#: By language, else by script, else "other".
BANDS = {
    "en": Band(1.70, 8.0, 0.05, 5.45, 0.45, 0.27, 6.25, 1.50, 6.0),
    "de": Band(1.70, 8.0, 0.05, 5.45, 0.45, 0.27, 6.25, 1.50, 6.0),
    "fr": Band(1.60, 8.0, 0.05, 5.45, 0.45, 0.27, 6.25, 1.40, 6.0),
    "es": Band(1.50, 8.0, 0.05, 5.45, 0.45, 0.27, 6.25, 1.45, 6.0),
    "latin": Band(1.40, 8.0, 0.15, 5.3, 0.45, 0.2, 6.0, 1.20, 8.0),
    "greek": Band(0.8, 6.0, 0.40, 4.0, 0.40),
    "cyrillic": Band(1.0, 7.0, 0.30, 4.5, 0.40),
    "han": Band(0.3, 4.0, 0.90, 4.0, 0.40),
    "kana": Band(0.4, 4.0, 0.70, 4.0, 0.40),
    "other": Band(0.25, 8.0, 0.98, 3.0, 0.35),
}
#: Below so many tokens entropy says too little.
ENTROPY_TOKENS = 64

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, n_tokens_multi long, chars_per_token double, chars_per_token_multi double, byte_share double, entropy double, band string, kept boolean"


def _repeats(ids: np.ndarray, known: int) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    if len(ids) < 4:
        return 0
    if known < 1 << 21:
        keys = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        _, pair = np.unique(ids[:-2] << 31 | ids[1:-1], return_inverse=True)
        keys = pair << 31 | ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(ids), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    twice[1:] |= twice[:-1] | np.concatenate(([False], twice[:-2]))
    return int(twice.sum())


class Fertility:
    """Measures documents; holds the vocabularies and a bounded cache of words cut before."""

    def __init__(self, model_path: str, multi_path: str, bands: dict[str, Band], min_words: int, repeat_percent: int):
        import sentencepiece
        import tiktoken

        with open(multi_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.multi = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.bands, self.min_words, self.repeat_percent = bands, min_words, repeat_percent
        self.ids = WordCache(self._new)
        self.pieces: list[bytes] = []
        self.multi_tokens: list[int] = []

    def _new(self, word: bytes) -> int:
        self.multi_tokens.append(len(self.multi.encode_ordinary(word.decode())))
        self.pieces.append(np.array(self.model.encode(word.decode()), dtype=np.uint16).tobytes())
        return len(self.pieces) - 1

    def measure(self, text: str | None, lang: str | None) -> tuple:
        if len(self.ids) > self.ids.entries:
            self.ids.clear()
            self.pieces.clear()
            self.multi_tokens.clear()
        text = text or ""
        at = list(map(self.ids.__getitem__, words_of(text)))
        n = len(at)
        chars = len(text) - sum(map(text.count, SPACES))
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        repeats = _repeats(np.array(at, dtype=np.int64), len(self.pieces))
        failed = n < self.min_words or 100 * repeats > self.repeat_percent * n
        counts = np.bincount(np.frombuffer(b"".join([self.pieces[i] for i in at]), dtype=np.uint16), minlength=len(self.is_byte)) if n else np.zeros(len(self.is_byte), np.int64)
        tokens = int(counts.sum())
        share = float(counts[self.is_byte].sum() / tokens) if tokens else 0.0
        p = counts[counts > 0] / max(tokens, 1)
        entropy = float(-(p * np.log2(p)).sum()) + 0.0
        fertility = chars / tokens if tokens else 0.0
        multi = sum(map(self.multi_tokens.__getitem__, at))
        fertility_multi = chars / multi if multi else 0.0
        key = self.band_of(text, lang)
        b = self.bands[key]
        good = b.low <= fertility <= b.high and share <= b.bytes_most
        good = good and b.multi_low <= fertility_multi <= b.multi_high
        good = good and (tokens < ENTROPY_TOKENS or entropy >= b.least_entropy(tokens))
        return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, tokens, multi, fertility, fertility_multi, share, entropy, key, bool(not failed and good)

    def band_of(self, text: str, lang: str | None) -> str:
        if lang in self.bands:
            return lang
        letters = script_counts(text)
        script = SCRIPTS[1 + int(np.argmax(letters[1:]))]
        return script if letters[1:].any() and script in self.bands else "other"


def _task(model_path, multi_path, bands, min_words, repeat_percent, text_col, lang_col, whole_rows):
    def make():
        meter = Fertility(model_path, multi_path, bands, min_words, repeat_percent)
        names = [x.split()[0] for x in METRICS.split(", ")]

        def work(batch: pa.RecordBatch):
            for part in slices(batch, text_col):
                langs = part[lang_col].to_pylist() if lang_col else [None] * part.num_rows
                got = [meter.measure(t, g) for t, g in zip(part[text_col].to_pylist(), langs, strict=True)]
                if whole_rows:
                    yield pa.Table.from_batches([part]).filter(pa.array([x[-1] for x in got]))
                else:
                    yield pa.table([part.column(0), *map(list, zip(*got, strict=True))], names=[part.schema.names[0], *names])

        return work

    return make


def quality_metrics(docs: DataFrame, model_path: str | None = None, multi_path: str | None = None, bands: dict[str, Band] | None = None, min_words: int = 50, repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Base figures, fertility figures and the verdict ``kept`` of each row, under ``id_col``.

    Words are cut as ``words_of`` does; each word is encoded by itself. Null and empty texts
    have no words and fail the base. Repeated rows and ids are each measured; an unknown or null
    language falls back to the script with the most letters, then to "other". An empty table
    gives no rows; other columns are not read. Memory is bounded by one slice of texts and the
    word cache; a text is never cut.
    """
    lang_col = lang_col if lang_col in docs.columns else None
    task = _task(model_path or public_tokenizers.path(MODEL), multi_path or public_tokenizers.path(MULTI), bands or BANDS, min_words, repeat_percent, text_col, lang_col, False)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    return map_arrow(docs.select(id_col, text_col, *([lang_col] if lang_col else [])), task, f"`{id_col}` {kind}, {METRICS}")


def quality_filter(docs: DataFrame, model_path: str | None = None, multi_path: str | None = None, bands: dict[str, Band] | None = None, min_words: int = 50, repeat_percent: int = 50, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality_metrics`` would keep, with all their columns, whatever their names.

    Null and empty texts go; repeated rows are judged one by one; an empty table gives no rows.
    """
    lang_col = lang_col if lang_col in docs.columns else None
    return map_arrow(docs, _task(model_path or public_tokenizers.path(MODEL), multi_path or public_tokenizers.path(MULTI), bands or BANDS, min_words, repeat_percent, text_col, lang_col, True), docs.schema)
