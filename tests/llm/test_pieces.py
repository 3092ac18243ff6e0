import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.llm.piece_transducer import Normaliser, PieceTransducer, _fields, encode_pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
MACHINE = PieceTransducer()


def ids(machine, text):
    raw = machine.encode(text)
    return list(struct.unpack(f"<{len(raw) // 2}H", raw))


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_of(pieces, kind, normaliser):
    """A model file with these (piece, score), byte fallback, and a normaliser's specification."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], *[(p, s, 1) for p, s in pieces]]
    out = b"".join(field(1, field(1, p) + field(2, s) + field(3, t)) for p, s, t in rows)
    return out + field(2, field(3, kind) + field(35, 1)) + field(3, normaliser)


def rules(name):
    made = sentencepiece.SentencePieceNormalizer(rule_name=name)
    return made, next(v for k, v in _fields(made.serialized_model_proto()) if k == 3)


WORDS = st.sampled_from(["the", "The", "un", "der", "ℌ", "ﬁ", "①", " ", "  ", "\n", "\t", "▁", ".", ",;", "é", "é", "日本", "ｶﾞ", "😀", "x", "ab", "abab", "12", " ", "　", "​"])
TEXTS = st.one_of(st.text(max_size=200), st.lists(WORDS, max_size=60).map("".join))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_merges_equal_the_library(text):
    assert ids(MACHINE, text) == LIBRARY.encode(text)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(WORDS, st.text(max_size=6)), min_size=500, max_size=1500).map("".join))
def test_merges_equal_the_library_on_long_texts(text):
    assert ids(MACHINE, text[:5000]) == LIBRARY.encode(text[:5000])


@pytest.mark.parametrize("unit", [":;", ",;", ".", "?!;", "a,"])
def test_runs_of_marks(unit):
    text = "x" + unit * (10**6 // len(unit))
    assert ids(MACHINE, text[:3000]) == LIBRARY.encode(text[:3000])
    assert MACHINE.decode(MACHINE.encode(text)) == text
    assert max(map(len, MACHINE.inner)) <= 64


NAMES = ["nmt_nfkc", "nfkc", "identity"]


@pytest.fixture(scope="module", params=NAMES)
def normaliser(request):
    made, spec = rules(request.param)
    return made, Normaliser(spec), spec


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_normaliser_equals_the_library(normaliser, text):
    library, machine, _ = normaliser
    if "\x00" not in text:
        assert machine(text) == library.normalize(text)


PIECES = [("▁", -2.0), ("▁the", -1.5), ("the", -2.5), ("▁un", -2.2), ("der", -2.3), ("u", -3.5), ("n", -3.4), ("d", -4.0), ("e", -3.0), ("r", -3.25), ("t", -3.0), ("h", -3.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("bab", -3.0), ("abab", -4.0), ("日", -6.0), ("fi", -5.0), ("▁fi", -5.5), ("é", -4.5), (".", -2.0)]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("joins", [False, True])
def test_shortest_path_of_unigram_models_equals_the_library(name, joins):
    _, spec = rules(name)
    model = model_of(PIECES + [("e▁t", -1.0)] * joins, 1, spec)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=model), PieceTransducer(model=model)

    @settings(max_examples=150, deadline=None)
    @given(TEXTS)
    def check(text):
        if "\x00" not in text:
            assert ids(machine, text) == library.encode(text)

    check()
    # Two paths whose weights differ beyond single precision only.
    assert ids(machine, "000dderthetheaab") == library.encode("000dderthetheaab")


def test_merges_behind_a_normaliser_equal_the_library():
    _, spec = rules("nmt_nfkc")
    pieces = [(p, float(-i)) for i, p in enumerate(["ab", "th", "the", "▁the", "er", "der", "un", "▁un", "fi", "abab", *"▁abcdefhinrtu."])]
    model = model_of(pieces, 2, spec)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=model), PieceTransducer(model=model)

    @settings(max_examples=150, deadline=None)
    @given(TEXTS)
    def check(text):
        if "\x00" not in text:
            assert ids(machine, text) == library.encode(text)

    check()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        PieceTransducer(model=field(2, field(3, 4)))


def test_odd_rows(spark):
    long = "a;" * 200_000
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "one two", 3), (2, long, 4), (2, long, 4)], "doc_id long, text string, n_pieces int")
    got = encode_pieces(docs).collect()
    assert sorted(r.n_pieces for r in got) == sorted([0, 0, len(LIBRARY.encode("one two")), *[len(LIBRARY.encode(long))] * 2])
    assert all(r.round_trip for r in got)
    assert encode_pieces(docs.limit(0)).count() == 0
