import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairwright.llm.byte_bpe import ByteBpe
from pairwright.llm.packing import best_fit, lower_bound, pack, plan, reduced
from pairwright.llm.piece_transducer import PieceTransducer, decode_pieces, encode_pieces
from pairwright.llm.token_counts import TokenTree, build_trees, count_tokens, edited_trees, merged_trees, tree_counts, with_edits

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BPE, MACHINE = ByteBpe(), PieceTransducer()
ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n\nb", "x\t y", "é\r\nü", "don't 's  'll", "<|endoftext|> a <|endoftext|>", "日本 語　x", "\U0001f600‍ a", "▁a_▁▁b", "a\xa0 b", "1234 5 a_b __", "\x1c \x1d"]
texts = st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcdeé'.,1▁日"), st.characters(exclude_categories=["Cs"])), max_size=40)


def ids(text):
    return np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_equal_the_library(text):
    assert BPE.encode(text) == ids(text)
    assert np.frombuffer(MACHINE.encode(text), "<u2").tolist() == PIECES.encode(text)
    assert MACHINE.decode(MACHINE.encode(text)) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(texts, st.lists(st.tuples(st.integers(0, 50), st.integers(0, 20), texts), max_size=5))
def test_edited_counts_equal_counting_anew(text, edits):
    tree = TokenTree(text, BPE, leaf_chunks=1)
    for pos, n, ins in edits:
        tree.edit(pos, n, ins)
        pos = min(pos, len(text))
        text = text[:pos] + ins + text[pos + n :]
        assert tree.text() == text
        assert tree.tree.total == (len(text), len(ids(text)) // 4)


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.createDataFrame([(-i - 1, t, None, None, 0) for i, t in enumerate([*ODD, None])], "doc_id long, text string, lang string, source string, n_chars long"))
    for r in docs.select("text").collect():
        assert BPE.encode(r.text) == ids(r.text or "")
    got = encode_pieces(docs, with_ids=True)
    want = {r.doc_id: PIECES.encode(r.text or "") for r in docs.collect()}
    rows = got.collect()
    assert {r.doc_id: r.ids for r in rows} == want
    assert all(r.round_trip for r in rows)
    assert {r.doc_id: r.text for r in decode_pieces(got).collect()} == {r.doc_id: (r.text or "").replace("▁", " ") for r in docs.collect()}


def test_counts_with_edits(spark):
    docs = spark.createDataFrame([(1, "one two  three", 1), (2, None, 2), (2, "", 2), (3, "word " * 5000, 3)], "doc_id long, text string, edits int")
    log = spark.createDataFrame([(1, 2, 0, 3, ""), (1, 1, 4, 3, "2 2"), (2, 1, 99, 5, " new"), (3, 1, 10_000, 4, "swap")], "doc_id long, seq int, pos int, n_del int, ins string")
    got = {(r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_chars_edited) for r in count_tokens(with_edits(docs, log), "edits").collect()}
    n = lambda t: len(ids(t)) // 4
    long = "word " * 5000
    assert got == {(1, n("one two  three"), n(" 2 2  three"), 11), (2, 0, n(" new"), 4), (3, n(long), n(long[:10_000] + "swap" + long[10_004:]), 25_000)}
    assert all(r.n_chars_encoded < 400 for r in count_tokens(with_edits(docs, log), "edits").collect())
    assert count_tokens(docs.limit(0)).count() == 0


def check_places(rows, docs, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for d, t in docs:
        x = ids(t or "") + bytes(4)
        n = len(x) // 4
        first = n % capacity or capacity
        for i, a in enumerate([0, *range(first, n, capacity)]):
            b = first if i == 0 else a + capacity
            want[d, i, a, b - a, zlib.crc32(x[4 * a : 4 * b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by)


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack(docs).collect()
    used = check_places(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= lower_bound(Counter(r.length for r in rows)) * 1.01 + 1
    odd = spark.createDataFrame([(1, None), (1, None), (1, "a b"), (2, "x " * 40), (3, "")], "doc_id long, text string")
    check_places(pack(odd, capacity=16).collect(), [(r.doc_id, r.text) for r in odd.collect()], 16)
    assert pack(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=6))
def test_plan_is_near_the_bound_and_reduction_loses_nothing(counts):
    capacity = 20
    fixed, rest = reduced(counts, capacity)
    assert all(sum(c) <= capacity for c, _ in fixed)
    back = Counter(rest)
    for contents, n in fixed:
        for x in contents:
            back[x] += n
    assert +back == Counter(counts)
    total = sum(n for _, n in [*fixed, *best_fit(rest, capacity)])
    assert total == plan(counts, capacity)["sequences"][0]
    assert lower_bound(counts, capacity) <= total <= lower_bound(counts, capacity) * 1.5 + 1


def test_stored_trees_follow_a_log(spark):
    rng = random.Random(11)
    texts = {i: "".join(rng.choice(["word ", "a ", " ", "\n", "x1", ". ", "é", "longer words here "]) for _ in range(rng.randrange(0, 400))) for i in range(40)}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(90, None, 0)], "doc_id long, text string, leaves int")
    trees = build_trees(docs, leaf_chunks=4)
    for step in range(3):
        edits = [(rng.randrange(0, 10), s, rng.randrange(0, 900), rng.randrange(0, 60), "".join(rng.choice(["new ", "x", " ", "\n"]) for _ in range(rng.randrange(0, 80)))) for s in range(25)] + [(777, 0, 0, 0, "nobody")]
        for d, _, pos, n, ins in edits:
            if d in texts:
                t = texts[d]
                pos = min(pos, len(t))
                texts[d] = t[:pos] + ins + t[pos + n :]
        log = spark.createDataFrame(edits, "doc_id long, seq int, pos int, n_del int, ins string")
        changed = edited_trees(trees, log, leaf_chunks=4)
        rows = changed.collect()
        assert {r.doc_id for r in rows} == {e[0] for e in edits} & set(texts)
        # No leaf outgrows twice its chunks by much, however often it is edited.
        assert all(x.count(" ") < 200 for r in rows for x in r.leaves)
        trees = spark.createDataFrame(merged_trees(trees, changed).collect(), "doc_id long, leaves array<string>, tokens array<int>")
        got = {r.doc_id: (r.n_tokens, r.n_chars) for r in tree_counts(trees).collect()}
        assert got == {i: (len(ids(t)) // 4, len(t)) for i, t in texts.items()} | {90: (0, 0)}
    assert build_trees(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf):
    from pairwright.llm.queries import op1_token_counts

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_token_counts(spark, sf).collect():
        t = texts[r.doc_id]
        n = len(t)
        new = t
        for pos, cut, ins in ((n // 3, 7, f"edit {r.doc_id}"), (2 * n // 3, 0, " words that were not there\nbefore"), (n // 2, 1, ""), (n + 100, 0, " the end.")):
            pos = min(pos, len(new))
            new = new[:pos] + ins + new[pos + cut :]
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited, r.edited_crc32) == (len(ids(t)) // 4, len(ids(new)) // 4, len(new), zlib.crc32(new.encode()))


def optimum(pieces, capacity):
    """The fewest sequences, by trying all."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= pieces[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - pieces[i]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_fixed_sets_cost_no_sequence(pieces):
    fixed, rest = reduced(Counter(pieces), 20)
    left = sorted((x for x, n in rest.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + (optimum(left, 20) if left else 0) == optimum(sorted(pieces, reverse=True), 20)
