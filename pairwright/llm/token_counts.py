"""Edit-aware token counts.

Each document has a segment tree whose leaves are runs of pre-tokens. An edit re-encodes
the leaves that it touches, with neighbours as far as the next place where the
pre-tokeniser surely cuts, and then updates the sums above those leaves only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.byte_bpe import CUT, ByteBpe, default_path
from pairwright.llm.common import map_arrow, slices

#: Chunks between sure cuts that one leaf holds when a tree is built.
LEAF_CHUNKS = 32
EDITS = "array<struct<pos:long,n_del:long,ins:string>>"
COUNTS = "n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long, edited_crc32 long"


def _cut_between(left: str, right: str) -> bool:
    """Whether the pre-tokeniser surely cuts between two texts that meet."""
    return len(right) > 1 and right[0] == " " and not right[1].isspace() and bool(left) and not left[-1].isspace()


class SegmentTree:
    """Sums of characters and tokens over leaves, in arrays of a full binary tree."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars)] = np.column_stack([chars, tokens]) if chars else 0
        width = self.size
        while width > 1:
            half = width // 2
            self.sums[half:width] = self.sums[width : 2 * width : 2] + self.sums[width + 1 : 2 * width : 2]
            width = half

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        at = leaf + self.size
        change = np.array([chars, tokens]) - self.sums[at]
        while at:
            self.sums[at] += change
            at //= 2

    def find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos``, and where in it; the last if beyond the end."""
        at = 1
        while at < self.size:
            at *= 2
            if pos >= self.sums[at, 0] and self.sums[at + 1, 0]:
                pos -= int(self.sums[at, 0])
                at += 1
        return at - self.size, pos

    @property
    def total(self) -> tuple[int, int]:
        return int(self.sums[1, 0]), int(self.sums[1, 1])


class TokenTree:
    """A document's text in leaves, with the segment tree of their counts."""

    def __init__(self, text: str, bpe: ByteBpe, leaf_chunks: int = LEAF_CHUNKS):
        self.bpe, self.leaf_chunks, self.encoded = bpe, leaf_chunks, 0
        self.leaves = self._cut(text)
        self.tree = SegmentTree(list(map(len, self.leaves)), [self.count(x) for x in self.leaves])
        self.built, self.encoded = self.tree.total[1], 0

    @classmethod
    def stored(cls, leaves: list[str], tokens: list[int], bpe: ByteBpe, leaf_chunks: int = LEAF_CHUNKS) -> TokenTree:
        """The tree of leaves that were counted before; nothing is encoded."""
        tree = cls("", bpe, leaf_chunks)
        tree.leaves, tree.tree = list(leaves), SegmentTree(list(map(len, leaves)), list(tokens))
        tree.built = tree.tree.total[1]
        return tree

    def kept(self) -> tuple[list[str], list[int]]:
        """Leaves that hold text, and their tokens."""
        rows = [(x, int(n)) for x, n in zip(self.leaves, self.tree.sums[self.tree.size :, 1], strict=False) if x]
        return [x for x, _ in rows], [n for _, n in rows]

    def _cut(self, text: str) -> list[str]:
        cuts = [0, *(m.start() for i, m in enumerate(CUT.finditer(text), 1) if i % self.leaf_chunks == 0), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def count(self, text: str) -> int:
        """Tokens of a text; a leaf that begins with its space is encoded with it."""
        self.encoded += len(text)
        if len(text) > 1 and text[0] == " " and not text[1].isspace():
            return len(b"".join(self.bpe.rest[x] or self.bpe.direct(" " + x) for x in CUT.split(text[1:]))) // 4
        return len(self.bpe.encode(text)) // 4

    def edit(self, pos: int, n_del: int, ins: str) -> None:
        """Replace ``n_del`` characters from ``pos`` (both cut to the text) by ``ins``."""
        chars = self.tree.total[0]
        pos = min(max(pos, 0), chars)
        n_del = min(max(n_del, 0), chars - pos)
        first, at = self.tree.find(pos)
        last, _ = self.tree.find(max(pos, pos + n_del - 1))
        text = "".join(self.leaves[first : last + 1])
        text = text[:at] + ins + text[at + n_del :]
        left, right = first - 1, last + 1
        while left >= 0 and not (self.leaves[left] and _cut_between(self.leaves[left], text)):
            text, first, left = self.leaves[left] + text, left, left - 1
        while right < len(self.leaves) and not (self.leaves[right] and _cut_between(text, self.leaves[right])):
            text, last, right = text + self.leaves[right], right, right + 1
        # A leaf that has grown beyond twice its size is cut again, so that later edits stay cheap.
        parts = self._cut(text)
        if len(parts) == 2:
            parts = [text]
        if len(parts) > last + 1 - first:
            chars, tokens = self.tree.sums[self.tree.size : self.tree.size + len(self.leaves)].T.tolist()
            for old, new in ((self.leaves, parts), (chars, map(len, parts)), (tokens, map(self.count, parts))):
                old[first : last + 1] = list(new)
            self.tree = SegmentTree(chars, tokens)
            return
        parts += [""] * (last + 1 - first - len(parts))
        self.leaves[first : last + 1] = parts
        for i, part in enumerate(parts, first):
            self.tree.put(i, len(part), self.count(part) if part else 0)

    def text(self) -> str:
        return "".join(self.leaves)


def count_tokens(docs: DataFrame, edits: str | None = None, tokenizer_path: str | None = None, leaf_chunks: int = LEAF_CHUNKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each text, and of the text after its edits: doc_id and COUNTS.

    ``edits`` names a column of type EDITS; each edit applies to the text that the one before
    has left. Positions and lengths are cut to the text; null parts count as 0 or empty, a
    null or empty list changes nothing. A null text is empty. Repeated rows and ids are
    counted one by one, an empty table gives no rows, other columns are not read.
    n_chars_encoded: characters that the edits made the tokeniser read again. Memory: one
    document with its tree, besides a slice of texts and the chunk cache.
    """
    path = tokenizer_path or default_path()

    def task():
        bpe = ByteBpe(path)

        def row(text, changes):
            tree = TokenTree(text or "", bpe, leaf_chunks)
            for e in changes or ():
                if e:
                    tree.edit(e["pos"] or 0, e["n_del"] or 0, e["ins"] or "")
            bpe.first.trim()
            bpe.rest.trim()
            chars, tokens = tree.tree.total
            return tree.built, tokens, chars, tree.encoded, zlib.crc32(tree.text().encode())

        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text"):
                rows = [row(*x) for x in zip(part["text"].to_pylist(), part["edits"].to_pylist(), strict=True)]
                yield pa.table([part.column(0), *map(list, zip(*rows, strict=True))], names=["doc_id", *[c.split()[0] for c in COUNTS.split(", ")]])

        return work

    changes = F.col(edits) if edits else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), changes.cast(EDITS).alias("edits"))
    return map_arrow(rows, task, "doc_id long, " + COUNTS)


def with_edits(docs: DataFrame, log: DataFrame, id_col: str = "doc_id", seq_col: str = "seq") -> DataFrame:
    """``docs`` with a column ``edits`` from a log of (id, seq, pos, n_del, ins), in the order of seq."""
    one = F.struct(F.col(seq_col), F.col("pos").cast("long").alias("pos"), F.col("n_del").cast("long").alias("n_del"), F.col("ins").cast("string").alias("ins"))
    lists = log.groupBy(F.col(id_col).alias("_edited")).agg(F.sort_array(F.collect_list(one)).alias("_log"))
    edits = F.transform("_log", lambda e: F.struct(e["pos"].alias("pos"), e["n_del"].alias("n_del"), e["ins"].alias("ins")))
    return docs.join(lists, docs[id_col] == lists["_edited"], "left").select(*[docs[c] for c in docs.columns if c != "edits"], edits.alias("edits"))


#: Documents that a task works on at once.
TREES_AT_ONCE = 64
TREES = "doc_id long, leaves array<string>, tokens array<int>"


def _tree_rows(rows: DataFrame, make, tokenizer_path: str | None, leaf_chunks: int, schema: str) -> DataFrame:
    path = tokenizer_path or default_path()

    def task():
        bpe = ByteBpe(path)

        def work(batch: pa.RecordBatch):
            for part in (batch.slice(i, TREES_AT_ONCE) for i in range(0, batch.num_rows, TREES_AT_ONCE)):
                done = [make(bpe, leaf_chunks, *x) for x in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                bpe.first.trim()
                bpe.rest.trim()
                yield pa.table(list(map(list, zip(*done, strict=True))), names=[c.split()[0] for c in schema.split(", ")])

        return work

    return map_arrow(rows, task, schema)


def build_trees(docs: DataFrame, tokenizer_path: str | None = None, leaf_chunks: int = LEAF_CHUNKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TREES of all documents, to be written as a table: each text in leaves, with the tokens of each leaf.

    A null or empty text has no leaves. This encodes every text once; ``edited_trees`` then
    reads only what edits touch. Repeated rows have a tree each.
    """

    def make(bpe, chunks, doc_id, text):
        return doc_id, *TokenTree(text or "", bpe, chunks).kept()

    return _tree_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, tokenizer_path, leaf_chunks, TREES)


def edited_trees(trees: DataFrame, log: DataFrame, tokenizer_path: str | None = None, leaf_chunks: int = LEAF_CHUNKS, seq_col: str = "seq") -> DataFrame:
    """TREES and n_chars_encoded of the documents that a log of (doc_id, seq, pos, n_del, ins) edits, and of no others.

    Only leaves that an edit touches are encoded again. An edit of an unknown document is left
    out; rows of one id are all edited.
    """

    def make(bpe, chunks, doc_id, leaves, tokens, edits):
        tree = TokenTree.stored(leaves or [], tokens or [], bpe, chunks)
        for e in edits:
            tree.edit(e["pos"] or 0, e["n_del"] or 0, e["ins"] or "")
        return doc_id, *tree.kept(), tree.encoded

    touched = trees.select("doc_id", "leaves", "tokens").join(log.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = with_edits(touched, log, "doc_id", seq_col).where("edits IS NOT NULL")
    return _tree_rows(rows.select("doc_id", "leaves", "tokens", F.col("edits").cast(EDITS)), make, tokenizer_path, leaf_chunks, TREES + ", n_chars_encoded long")


def merged_trees(trees: DataFrame, changed: DataFrame) -> DataFrame:
    """``trees`` with the rows of ``changed`` in place of those of the same documents."""
    return trees.select("doc_id", "leaves", "tokens").join(changed.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(changed.select("doc_id", "leaves", "tokens"))


def tree_counts(trees: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_chars) from stored trees, without encoding."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return trees.select("doc_id", total(F.col("tokens")).alias("n_tokens"), total(F.transform("leaves", lambda x: F.length(x))).alias("n_chars"))
