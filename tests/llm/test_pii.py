import random
import re

import numpy as np
import pytest

from pairwright.llm import pii

SLOW = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in SLOW[kind].finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            if kind == "card":
                total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
                if not 14 <= len(d) <= 19 or total % 10:
                    continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_equals_brute_force():
    rng = random.Random(5)
    for _ in range(6000):
        text = "".join(rng.choice(["@", ".", "-", " ", "+", "(", ")", "a", "b", "é", "1", "25", "300", "4", "0", "com", "\n", "+1", "9.8.7.6", "4111111111111111", "a@b.c"]) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_little_time():
    for unit in ("a", "1", "1.", "+1", "a@", "1 ", "a.b@c"):
        pii.base_spans(unit * 100_000)
    pii.candidates("a" * 300_000)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_whole_table(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_personal_data(docs, field).collect():
        base = brute(texts[r.doc_id])
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(",")) | {""}
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)
    clean = [t for t in texts.values() if not brute(t)]
    assert sum(bool(pii.find(t, field)[1]) for t in clean) <= 0.005 * len(clean)


def test_skip_edges_agree_across_a_document(field):
    text = "Write to anna.b77@mail2.example.com today. " + "word " * 200 + "Again, anna.b77@mail2 was there."
    base, spans = pii.find(text, field)
    assert len(base) == 1
    alone = "Again, anna.b77@mail2 was there."
    weaker = pii.Field(field.unary, field.chain, 0 * field.skip)
    p = lambda f, t: f.marginals(*pii.graph(t)[1:])[-1][1]
    assert p(field, text) > p(weaker, text)
    assert p(field, alone) == pytest.approx(p(weaker, alone))


def test_marginals_of_a_chain_are_exact(field):
    import itertools

    _, x, chain, _ = pii.graph("+1 (988) 555-2485 12")
    n, k = len(x), len(pii.LABELS)
    phi, total = x @ field.unary, np.zeros((len(x), k))
    for path in itertools.product(range(k), repeat=n):
        s = np.exp(sum(phi[i, a] for i, a in enumerate(path)) + sum(field.chain[path[a], path[b]] for a, b in chain))
        for i, a in enumerate(path):
            total[i, a] += s
    want = total / total.sum(axis=1, keepdims=True)
    assert np.allclose(field.marginals(x, chain, np.zeros((0, 2), int), rounds=60), want, atol=1e-3)


def test_odd_rows_and_masks(spark, field):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (2, "call +1 (988) 555-2485 or a@b.co now", 5), (3, "9" * 100_000, 1)], "doc_id long, text string, n_chars long")
    assert pii.find_personal_data(docs, field).count() == 4
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask_personal_data(docs.where("doc_id > 1"), field).collect()}
    assert got[2] == ("call <PHONE> or <EMAIL> now", len("call <PHONE> or <EMAIL> now"))
    assert pii.find_personal_data(docs.limit(0), field).count() == 0


def test_many_matches_take_little_time(field):
    text = "a@b.co +1 (988) 555-2485 " * 25_000
    base = pii.base_spans(text)
    spans = pii.candidates(text)
    kinds = pii.weak_labels(spans, base)
    assert set(kinds.tolist()) == {1, 4} and (kinds == 1).sum() == 25_000
    assert len(base) == 50_000
    assert pii.added_spans("a@b.co " * 20_000, pii.base_spans("a@b.co " * 20_000), field) == []


def test_weak_labels_equal_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        cuts = sorted(rng.sample(range(40), 8))
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        base = sorted((a, rng.randrange(4), a + rng.randrange(1, 9)) for a in rng.sample(range(40), 4))
        want = [next((k + 1 for a, k, b in base if a < e and s < b), 0) for s, e in spans]
        assert pii.weak_labels(spans, base).tolist() == want


def test_digest_and_counts_by_kind(spark, field):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find_personal_data(docs, field).collect():
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()


def test_each_mention_is_its_own_span():
    spans = [(0, 16), (17, 33), (34, 36)]
    text = "4111111111111112 4222222222222223 12"
    assert list(pii._mentions(text, spans, 0, 2, 3)) == [(0, 16), (17, 36)]
    assert list(pii._mentions("a@b c@d", [(0, 3), (4, 7)], 0, 1, 1)) == [(0, 3), (4, 7)]
    assert list(pii._mentions("+1 988 5552485 +1 988 5552486", [(0, 2), (3, 6), (7, 14), (15, 17), (18, 21), (22, 29)], 0, 5, 4)) == [(0, 14), (15, 29)]


def mentions(rng):
    """A text with an address and, further on, its short form, which only the first mention explains; and decoys."""
    name = "".join(rng.choice("abcdefghij") for _ in range(5)) + str(rng.randrange(10, 99))
    decoy = "".join(rng.choice("klmnopqrst") for _ in range(5)) + str(rng.randrange(10, 99))
    words = lambda n: " ".join(rng.choice(["so", "the", "mail", "of", "those"]) for _ in range(n))
    head = f"{words(20)} {name}@mail.example.com {words(60)} "
    text = f"{head}{name}@mail {words(30)} room {decoy} {words(5)}"
    return text, (len(head), 0, len(head) + len(name) + 5), decoy


def test_skip_edges_add_right_spans(field):
    rng = random.Random(4)
    assert field.skip[0, 0] > 0
    without = pii.Field(field.unary, field.chain, 0 * field.skip)
    right = {True: 0, False: 0}
    wrong = 0
    for _ in range(200):
        text, want, decoy = mentions(rng)
        for f, linked in ((field, True), (without, False)):
            added = pii.added_spans(text, pii.base_spans(text), f)
            right[linked] += want in added
            wrong += linked and any(decoy in text[a:b] for a, _, b in added)
    assert right[True] >= 150 and right[True] > right[False] + 50 and wrong == 0


def test_other_columns_named_n_chars_stay(spark, field):
    docs = spark.createDataFrame([(1, "mail a.b1@mail.example.com now", "many"), (2, None, None)], "doc_id long, text string, n_chars string")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask_personal_data(docs, field).collect()}
    assert got == {1: ("mail <EMAIL> now", "many"), 2: (None, None)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 30, 50])
def test_short_forms_are_found_however_often_they_come(field, n):
    rng = random.Random(n)
    without = pii.Field(field.unary, field.chain, 0 * field.skip)
    found = missed = 0
    for _ in range(20):
        name = "".join(rng.choice("abcdefghij") for _ in range(5)) + str(rng.randrange(10, 99))
        decoy = "".join(rng.choice("klmnopqrst") for _ in range(5)) + str(rng.randrange(10, 99))
        parts = [f"{name}@mail.example.com"] + [f"{name}@mail" if i % 2 else f"room {decoy}" for i in range(2 * n)]
        rng.shuffle(parts)
        text = " and then ".join(parts)
        at = {m.start() for m in re.finditer(f"{name}@mail(?=\\s|$)", text)}
        added = pii.added_spans(text, pii.base_spans(text), field)
        found += sum(a in at and k == 0 for a, k, _ in added)
        missed += len(at) - sum(a in at for a, _, _ in added)
        assert all(a in at for a, _, _ in added)
        assert not any(a in at for a, _, _ in pii.added_spans(text, pii.base_spans(text), without)) or field.skip[0, 0] == 0
    assert found >= 0.9 * (found + missed)


def test_beliefs_of_a_small_graph_with_skip_edges_are_exact(field):
    import itertools

    text = "ab77@mail.co said ab77@mail or ab77 1"
    base = pii.base_spans(text)
    spans, x, chain, skip = pii.graph(text, base)
    seen, n, k = pii.weak_labels(spans, base), len(spans), len(pii.LABELS)
    assert len(skip) == 2 and set(skip[:, 0]) == {0}
    phi, total = x @ field.unary, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        if path[0] == seen[0]:
            s = np.exp(sum(phi[i, a] for i, a in enumerate(path)) + sum(field.chain[path[a], path[b]] for a, b in chain) + sum(field.skip[path[a], path[b]] for a, b in skip))
            for i, a in enumerate(path):
                total[i, a] += s
    want = total / total.sum(axis=1, keepdims=True)
    assert np.allclose(field.marginals(x, chain, skip, rounds=60, seen=seen), want, atol=1e-3)
