import math
import re
import zlib
from collections import Counter

import numpy as np

from pairwright.llm import recurrent_lm as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small_vocabulary(rng):
    counts = rng.integers(1, 50, lm.HEAD).astype(float)
    return lm.Vocabulary({b"w%d" % i: i for i in range(1, lm.HEAD)}, counts, {"abc": 0}, np.full(lm.TAIL_CLASSES, 9.0), np.full(lm.TAIL_CLASSES, 3.0), 5000, 1500)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    v = small_vocabulary(rng)
    p = {k: x.astype(np.float64) for k, x in lm.initial(v).items()}
    texts = [np.append(rng.integers(1, lm.HEAD + lm.TAIL_CLASSES, n), 0) for n in (7, 5, 2)]
    _, going, x, y = next(lm.Layout.of(texts, 3).windows(8))
    h = rng.normal(size=(lm.UNITS, len(x[0])))
    _, grads, _ = lm.gradients(p, h, going, x, y)
    full = {k: g for k, g in grads.items() if k != "E"} | {"E": np.zeros_like(p["E"])}
    full["E"][grads["E"][0]] = grads["E"][1]
    for k in p:
        for at in rng.choice(np.flatnonzero(full[k]), 6):
            step, f = 1e-5, []
            for s in (step, -step):
                q = {a: b.copy() for a, b in p.items()}
                q[k].flat[at] += s
                f.append(-lm.gradients(q, h, going, x, y)[0])
            assert abs((f[0] - f[1]) / (2 * step) - full[k].flat[at]) < 2e-3 * max(1, abs(full[k].flat[at])), k


def test_state_is_carried_and_lanes_do_not_matter():
    rng = np.random.default_rng(1)
    p = lm.initial(small_vocabulary(rng))
    texts = [np.append(rng.integers(1, lm.HEAD + lm.TAIL_CLASSES, n), 0) for n in (0, 3, 100, 41, 5)]
    a = lm.score(p, texts)
    for other in (lm.score(p, texts, lanes=2), lm.score(p, texts, size=7), np.concatenate([lm.score(p, [t]) for t in texts])):
        assert np.allclose(a, other, atol=1e-2)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    v = small_vocabulary(rng)
    p, h = lm.initial(v), rng.normal(size=(1, lm.UNITS)).astype(np.float32)
    every = np.arange(lm.HEAD + lm.TAIL_CLASSES)
    got, _ = lm._outputs(p, np.repeat(h, len(every), 0), every)
    assert abs(np.exp(got).sum() - 1) < 1e-3


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(5000, None), (5001, ""), (5001, "unseenword the")], "doc_id long, text string"))
    rows = docs.collect()
    words = {i: [w.translate(lower) for w in WORD.findall(r.text or "")] for i, r in enumerate(rows)} if (lower := {c: c + 32 for c in range(65, 91)}) else {}
    out = [zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows]
    c = Counter(w for i, ws in words.items() if not out[i] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id, out[i], len(words[i]) + 1, sum(c[w] > 0 for w in [*words[i], None]), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words[i], None]), 4)) for i, r in enumerate(rows))
    got = lm.score_documents(docs).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out]
    # Scores are negative: nearer to 0 is better.
    assert sum(r.score for r in held) > 0.99 * sum(r.base_score for r in held)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_layout_of_rows_changes_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    docs = docs.union(docs.where("doc_id < 9")).union(spark.createDataFrame([(None, "null id"), (None, None)], "doc_id long, text string"))
    one, many = (lm.score_documents(docs.repartition(n), group_tokens=4000).orderBy("doc_id", "base_score").collect() for n in (1, 32))
    assert [r[:5] for r in one] == [r[:5] for r in many] and one[0].asDict().keys() >= {"train_tokens", "n_known"}
    assert all(abs(a.base_score - b.base_score) < 1e-6 for a, b in zip(one, many, strict=True))
    assert all(abs(a.score - b.score) < 1e-3 * abs(a.score) for a, b in zip(one, many, strict=True))


def test_every_training_document_is_learned_from_once(spark, monkeypatch):
    seen = []

    def keep(rows, state):
        unpress = __import__("zstandard").ZstdDecompressor().decompress
        seen.extend(np.frombuffer(unpress(r.z), "<i2").tolist() for r in rows.collect())
        return state

    monkeypatch.setattr(lm, "train_round", keep)
    lm.score_documents(spark.range(300).selectExpr("id AS doc_id", "repeat('word ', int(id)) AS text"), group_tokens=5000)
    assert sorted(len(x) - 1 for x in seen) == [i for i in range(300) if zlib.crc32(str(i).encode()) % 10]


def test_rounds_and_groups_grow_with_the_corpus():
    sizes = [lm.rounds_of(n, 1000) for n in (0, 1000, 10_000, 1_000_000, 10**9)]
    assert sizes[0] == [1, 1] and all(len(a) <= len(b) and sum(a) <= sum(b) for a, b in zip(sizes, sizes[1:], strict=False))
    assert sum(sizes[-1]) >= 10**6 and len(sizes[-1]) == 20


def test_lanes_hold_every_text_once():
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(1, 99, n), 0) for n in [0, 0, 1, 3, 300, 41, 5, 7, 90]]
    layout = lm.Layout.of(texts, 4)
    for t, i, a in zip(texts, layout.lane, layout.start, strict=True):
        assert layout.symbols[i, a : a + len(t)].tolist() == t.tolist() and layout.read[i, a : a + len(t)].tolist() == [0, *t[:-1].tolist()]
    assert layout.loads.sum() == sum(map(len, texts)) and list(layout.loads) == sorted(layout.loads, reverse=True)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "one two three " * 100_000), (2, "one"), (10, "four")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert got[1].n_tokens == 300_001 and got[1].score > got[1].base_score


def test_symbols_by_spark_are_those_of_the_vocabulary(spark):
    words = ["the", "ending", "x,", ",.;", "naïve!?", "日本語です", "zz...ing", "a", "höre.", "\ud7ff"]
    v = lm.Vocabulary({b"the": 1, "höre.".encode(): 2}, np.ones(lm.HEAD), {"ing": 0, "": 1, "ïve": 2, "語です": 3, "a": 4}, np.ones(lm.TAIL_CLASSES), np.ones(lm.TAIL_CLASSES), 100, 10)
    got = lm.with_symbols(spark.createDataFrame([(w, 1) for w in words], "word string, c long"), v).collect()
    assert {r.word: r.symbol for r in got} == {w: v.symbol(w.encode()) for w in words}


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    calls, cut = spark.sparkContext.accumulator(0), lm.tokens_of
    monkeypatch.setattr(lm, "tokens_of", lambda text: (calls.add(1), cut(text))[1])
    monkeypatch.setattr(lm, "SCORE_TOKENS", 40)
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('word ', int(id)) AS text")
    assert sorted((r.doc_id, r.n_tokens) for r in lm.score_documents(docs).collect()) == [(i, i + 1) for i in range(60)]
    assert calls.value == 60


def plain_score(p, text):
    """One text, word by word, in double precision."""
    p = {k: x.astype(float) for k, x in p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, last, total, u = np.zeros(lm.UNITS), 0, 0.0, lm.UNITS
    for s in text.tolist():
        x, a = p["E"][last], h @ p["U"]
        z, r = sigmoid(x[:u] + a[:u]), sigmoid(x[u : 2 * u] + a[u : 2 * u])
        h = z * h + (1 - z) * np.tanh(x[2 * u :] + r * a[2 * u :])
        cls = h @ p["C"] + p["c"]
        k = s // lm.CLASS_WORDS if s < lm.HEAD else lm.HEAD // lm.CLASS_WORDS + s - lm.HEAD
        total += cls[k] - np.log(np.exp(cls).sum())
        if s < lm.HEAD:
            own = h @ p["W"][k] + p["w"][k]
            total += own[s % lm.CLASS_WORDS] - np.log(np.exp(own).sum())
        last = s
    return total


def test_scores_equal_a_plain_pass():
    rng = np.random.default_rng(4)
    p = {k: x * np.float32(4 if k in "EUCW" else 1) for k, x in lm.initial(small_vocabulary(rng)).items()}
    texts = [np.append(rng.integers(1, lm.HEAD + lm.TAIL_CLASSES, n), 0).astype(np.int16) for n in (0, 3, 700, 41, 5, 260, 1)]
    want = [plain_score(p, t) for t in texts]
    for got in (lm.score(p, texts), lm.score(p, texts, lanes=2, size=50)):
        assert np.allclose(got, want, rtol=1e-5)


def test_small_classes_share_their_passes(monkeypatch):
    calls = []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(np, name)

    rng = np.random.default_rng(5)
    p, targets = lm.initial(small_vocabulary(rng)), rng.integers(0, lm.HEAD + lm.TAIL_CLASSES, 400)
    hs = rng.normal(size=(400, lm.UNITS)).astype(np.float32)
    monkeypatch.setattr(lm, "np", Counted())
    for grads in (None, {k: np.zeros_like(x) for k, x in p.items() if k != "E"}):
        calls.clear()
        lm._outputs(p, hs, targets, grads)
        # Each of the two softmaxes once over all rows, and the biases; 17 before.
        assert calls.count("exp") <= 6


def test_blocks_hold_every_row_once():
    bounds = [0, 0, 3, 700, 2000, 2001, 2001]
    blocks = list(lm._blocks(bounds))
    assert [i for b in blocks for _, a, end in b for i in range(a, end)] == list(range(2001))
    assert all(bounds[k] <= a < end <= bounds[k + 1] for b in blocks for k, a, end in b)
    assert max(b[-1][2] - b[0][1] for b in blocks) <= lm.SOFTMAX_ROWS and list(lm._blocks([0, 0])) == []
