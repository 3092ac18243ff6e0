"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled to machines. The normaliser rewrites characters by the longest rule
that matches and turns spaces into word marks. The piece machine reads normalised characters
and writes pieces; byte fallback writes the bytes of a character that no piece holds. Composed
with an input they give a lattice of segmentations, and the one on its shortest path in the
tropical semiring (weights add along a path, the least path wins) is the encoding.

* Unigram models: an arc weighs the piece's score, negated; a character by bytes weighs 10 more
  than the dearest piece. Many paths are finite.
* Merge models: a state remembers the piece read last, and an arc from piece p to piece q
  weighs 0 if merging leaves p and q apart where they meet, else infinity. Exactly one path is
  finite, the segmentation that the merges make; scores only say which pairs merge first.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import WordCache, map_arrow, slices

FILE = "piece_bpe_32k.model"
MARK = "▁"
INFINITY = float("inf")
MARKS = frozenset(".,;:!?")
#: Units (words with their marks) of more characters are composed anew each time.
CACHED_CHARS = 64
#: What a character by bytes weighs above the dearest piece of a unigram model.
BYTES_ABOVE = 10.0
UNIGRAM, MERGES = 1, 2
NORMAL, BYTE = 1, 6


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message, as the wire format has them."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + n]
        at += n


class Normaliser:
    """The machine of a normaliser specification.

    Its rules come as a double-array trie over UTF-8 bytes: unit ``s`` of the array tells by its
    label whether byte b leads from state to state, and a leaf holds where the output starts.
    """

    def __init__(self, spec: bytes):
        spec = dict(_fields(spec))
        rules = spec.get(2, b"")
        size = struct.unpack_from("<I", rules)[0] if rules else 0
        self.units = np.frombuffer(rules, "<u4", size // 4, 4).tolist() if size else []
        self.outputs = rules[4 + size :]
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.mark = MARK if spec.get(5, 1) else " "
        self.plain = not self.units and not self.squeeze

    def _longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes read, bytes written) by the longest rule at a place, else by copying a character."""
        unit, state, found = self.units[0], 0, None
        state ^= unit >> 10 << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            state ^= data[i]
            unit = self.units[state]
            if unit & (1 << 31 | 255) != data[i]:
                break
            state ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[state] & ((1 << 31) - 1)
        if found:
            return found[0], self.outputs[found[1] : self.outputs.index(b"\0", found[1])]
        first = data[at]
        n = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, data[at : at + n]

    def _written(self, text: str):
        if not self.units:
            yield from text
            return
        data, at = text.encode(), 0
        while at < len(data):
            n, out = self._longest(data, at)
            at += n
            yield out.decode()

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            out = text
        else:
            parts, after_space = [], self.squeeze
            for part in self._written(text):
                if after_space:
                    part = part.lstrip(" ")
                if part:
                    parts.append(part)
                    after_space = self.squeeze and part[-1] == " "
            out = "".join(parts)
            if self.squeeze:
                # A mark that stands in the text itself goes, too, where marks are written for spaces.
                out = out.rstrip(" ") if self.mark == " " else out.replace(" ", MARK).rstrip(MARK)
            if not out:
                return ""
        return (self.mark if self.prefix else "") + out.replace(" ", self.mark)


class UnitCache(WordCache):
    """Remembers short units only."""

    def __missing__(self, unit):
        value = self.make(unit)
        if len(unit) <= CACHED_CHARS:
            self[unit] = value
        return value


class PieceTransducer:
    """The compiled machines of one model, with bounded caches of what was composed before.

    ``model``: the bytes of a model file; else the file at ``path``, else the public one.
    """

    def __init__(self, path: str | None = None, model: bytes | None = None):
        if model is None:
            with open(path or public_tokenizers.path(FILE), "rb") as f:
                model = f.read()
        pieces, trainer, spec = [], {}, b""
        for number, value in _fields(model):
            if number == 1:
                one = dict(_fields(value))
                pieces.append((one[1].decode(), struct.unpack("<f", one.get(2, bytes(4)))[0], one.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = value
        self.kind = trainer.get(3, UNIGRAM)
        self.normaliser = Normaliser(spec)
        self.bytes_of, self.byte_id, self.id_of, self.score = [], {}, {}, {}
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif kind == NORMAL:
                self.id_of[piece], self.score[piece] = i, score
                self.bytes_of.append(piece.replace(MARK, " ").encode())
            else:
                self.bytes_of.append(b"")
        if self.kind not in (UNIGRAM, MERGES) or len(self.byte_id) < 256 or len(pieces) > 1 << 16 or any(k == 4 for *_, k in pieces):
            raise ValueError("only unigram and merge models of 65,536 pieces at most, with byte fallback and without symbols of their own, are supported")
        self.text_of = {i: p for p, i in self.id_of.items()}
        self.ends = {p[i:]: -1 for p in self.id_of for i in range(len(p))} | self.id_of
        self.joined = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.longest = max(map(len, self.id_of), default=1)
        self.byte_weight = BYTES_ABOVE - min(self.score.values(), default=0.0)
        # Sums of scores are rounded from the start of a text on, and pieces that hold a mark or a line
        # break but at their start may join any two units: such models read a text as one unit.
        self.whole = self.kind == UNIGRAM or any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id_of)
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[list(self.byte_id.values())] = True
        self.arcs = WordCache(self._arc, 1 << 21)
        self.compose = self.compose_merges if self.kind == MERGES else self.compose_unigram
        self.inner = UnitCache(self._unit)
        self.marked = UnitCache(lambda x: self._unit(MARK + x))
        self.newline = self.compose("\n")

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: always the best pair, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -INFINITY, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _arc(self, pair: int) -> float:
        a, b = self.text_of[pair >> 16], self.text_of[pair & 0xFFFF]
        return 0.0 if self.merged(a + b) == [a, b] else INFINITY

    def _unit(self, unit: str) -> bytes:
        """``compose``, with marks at the end that no piece joins to what stands before cut off first."""
        end = len(unit)
        while end > 2 and unit[end - 1] in MARKS and unit[end - 2 : end] not in self.joined:
            end -= 1
        out = self.compose(unit[:end])
        return out + b"".join(map(self.inner.__getitem__, unit[end:])) if end < len(unit) else out

    def compose_merges(self, unit: str) -> bytes:
        """The ids on the one finite path through ``unit``, as unsigned 16-bit numbers.

        ``state[i]``: the piece that the finite path to position i ends with (-1: none, or
        bytes before, which any piece may follow; None: no path). Arcs into a position are
        tried from the shortest piece on, for as long as some piece ends so.
        """
        n, ends, arcs = len(unit), self.ends, self.arcs
        state: list[int | None] = [-1] + [None] * n
        back = [0] * (n + 1)
        for end in range(1, n + 1):
            start = end - 1
            while start >= 0:
                piece = ends.get(unit[start:end])
                if piece is None:
                    break
                if piece >= 0:
                    before = state[start]
                    if before is not None and (before < 0 or arcs[before << 16 | piece] == 0.0):
                        state[end], back[end] = piece, start
                        break
                start -= 1
            if state[end] is None and unit[end - 1] not in self.id_of:
                state[end], back[end] = -1, end - 1
        return self._path(unit, state, back)

    def compose_unigram(self, unit: str) -> bytes:
        """The ids on the path of least weight, as unsigned 16-bit numbers.

        Weights are kept and compared in single precision, as the model has them; of equal paths
        the one whose last piece is longer wins.
        """
        n = len(unit)
        weight, state, back = [INFINITY] * (n + 1), [None] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        for start in range(n):
            here, single = weight[start], False
            for end in range(start + 1, min(n, start + self.longest) + 1):
                piece = self.id_of.get(unit[start:end])
                if piece is None:
                    continue
                single = single or end == start + 1
                through = float(np.float32(here - self.score[unit[start:end]]))
                if through < weight[end]:
                    weight[end], state[end], back[end] = through, piece, start
            if not single and (through := float(np.float32(here + self.byte_weight))) < weight[start + 1]:
                weight[start + 1], state[start + 1], back[start + 1] = through, -1, start
        return self._path(unit, state, back)

    def _path(self, unit: str, state: list, back: list[int]) -> bytes:
        out, end = [], len(unit)
        while end:
            if state[end] is None:
                raise ValueError(f"no finite path through {unit[:80]!r}")
            if state[end] >= 0:
                out.append(state[end])
            else:
                out.extend(self.byte_id[b] for b in reversed(unit[end - 1].encode()))
            end = back[end]
        out.reverse()
        return struct.pack(f"<{len(out)}H", *out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        for cache in (self.inner, self.marked, self.arcs):
            cache.trim()
        if self.whole:
            return self.compose(self.normaliser(text))
        if not self.normaliser.plain or not self.normaliser.prefix or self.normaliser.mark != MARK or "  " in text or MARK in text or text[0] == " ":
            return b"".join(map(self.inner.__getitem__, _UNITS.findall(self.normaliser(text))))
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if out:
                out.append(self.newline)
                if first:
                    out.append(self.inner[first])
            else:
                out.append(self.marked[first])
            out.extend(map(self.marked.__getitem__, rest))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u2").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.normaliser.prefix and text[:1] == " " else text


#: A line break, or marks and what follows up to the next mark or line break.
_UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

FIGURES = "n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def encode_pieces(docs: DataFrame, model_path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each text and what decoding them gives: doc_id, FIGURES and, if asked for, ids.

    ids: array of piece numbers; ids_crc32 is over them as unsigned 32-bit little-endian
    numbers. round_trip: decoding gives the text again (a word mark in a text reads as a
    space). Null texts count as empty: no pieces, and a round trip. Repeated rows and ids are
    encoded one by one, an empty table gives no rows, other columns are not read.
    """

    def task():
        machine = PieceTransducer(model_path)

        def row(text):
            text = text or ""
            ids = machine.encode(text)
            numbers = np.frombuffer(ids, dtype="<u2")
            back = machine.decode(ids)
            figures = len(numbers), int(machine.is_byte[numbers].sum()), zlib.crc32(numbers.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == text.replace(MARK, " ")
            return (*figures, numbers.tolist()) if with_ids else figures

        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                rows = [row(t) for t in part["text"].to_pylist()]
                yield pa.table([part.column(0), *map(list, zip(*rows, strict=True))], names=names)

        return work

    schema = "doc_id long, " + FIGURES + (", ids array<int>" if with_ids else "")
    names = ["doc_id", *[c.split()[0] for c in schema.split(", ")[1:]]]
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), task, schema)


def decode_pieces(rows: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of piece numbers; a null array is an empty text."""

    def task():
        machine = PieceTransducer(model_path)

        def work(batch: pa.RecordBatch):
            texts = [machine.decode(np.array(x or [], dtype="<u2").tobytes()) for x in batch["ids"].to_pylist()]
            yield pa.table([batch.column(0), texts], names=["doc_id", "text"])

        return work

    return map_arrow(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), task, "doc_id long, text string")
