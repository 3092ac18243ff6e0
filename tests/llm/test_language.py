import itertools
import random

import numpy as np

from pairwright.llm.language_id import identify, language_filter, train, viterbi
from pairwright.llm.queries import op8_language_id


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(20, 3)).astype(np.float32) * 4
    lengths = np.array([0, 5, 1, 6, 3, 0, 6])
    ids = rng.integers(0, 20, lengths.sum())
    got, at = viterbi(lengths, ids, scores, 2.0), 0
    for n in lengths:
        own, labels = ids[at : at + n], got[at : at + n]
        cost = lambda path, own=own: sum(scores[w, x] for w, x in zip(own, path, strict=True)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        assert n == 0 or abs(cost(labels) - max(map(cost, itertools.product(range(3), repeat=int(n))))) < 1e-3
        at += n


def test_held_out_accuracy_and_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op8_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    model = train(docs)
    text = {r.lang: r.text for r in docs.where("n_chars between 400 and 900").collect()}
    mixed = spark.createDataFrame([(1, text["de"] + " " + text["fr"]), (2, None), (3, "12 34 --"), (4, ""), (4, ""), (5, "слово дня")], "doc_id long, text string")
    got = {r.doc_id: r for r in identify(mixed, model).collect()}
    assert [s.lang for s in got[1].spans] == ["de", "fr"]
    assert abs(got[1].spans[1].first_word - len(text["de"].split())) <= 2
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4))
    assert identify(mixed, model).count() == 6 and identify(mixed.limit(0), model).count() == 0
    kept = language_filter(mixed, model).collect()
    assert {r.doc_id for r in kept} >= {1} and not {r.doc_id for r in kept} & {2, 3, 4}
    none = train(docs.limit(0))
    assert {r.lang_pred for r in identify(mixed, none).collect()} == {"und"}


def test_scripts_narrow(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("абвгдежз" if i % 2 else "abcdefgh") for _ in range(6)) for _ in range(30)), "ru" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    got = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_letters_are_those_of_unicode(spark):
    from pairwright.llm.scripts import SCRIPTS, script_ids

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x30000)])
    ids = script_ids(points)
    assert ((ids > 0) == np.array([chr(p).isalpha() for p in points.tolist()])).all()
    assert [SCRIPTS[i] for i in script_ids(np.array([0x61, 0x430, 0x4E00, 0xB5, 0x3F6, 0x531, 0xAC00]))] == ["latin", "cyrillic", "han", "other", "none", "armenian", "hangul"]
    model = train(spark.createDataFrame([("the one word", "en")], "text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame([(1, "µ"), (2, "϶"), (3, "՚ ־")], "doc_id long, text string"), model).collect()}
    assert got == {1: "en", 2: "und", 3: "und"}


def test_filter_rejects_scripts_that_nobody_taught(spark):
    words = ["house", "stone", "river", "maison", "pierre", "riviere"]
    rows = [(" ".join(words[3 * (i % 2) : 3 * (i % 2) + 3] * 20), "fr" if i % 2 else "en", 5, "x") for i in range(20)]
    docs = spark.createDataFrame([*rows, ("слово камень река " * 30, None, 5, "y"), ("house stone river слово камень река реками " * 9, None, 5, "z"), (None, "en", 5, "n"), ("12", "en", 5, "n")], "text string, lang string, spans int, lang_pred string")
    kept = language_filter(docs, train(docs)).collect()
    assert len(kept) == 20 and {r.lang_pred for r in kept} == {"x"}


def test_whole_result_equals_brute_force(spark):
    from pairwright.llm import language_id as li
    from pairwright.llm.scripts import SCRIPTS, script_ids

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500")
    model = train(docs)
    k = len(model.languages)

    def word_score(word):
        points = [ord(c) for c in word.decode().lower()]
        kinds = script_ids(np.array(points, dtype=np.uint32)).tolist() if points else []
        letters = sum(x > 0 for x in kinds)
        if not letters:
            return np.zeros(k, np.float32), 0, 0
        script = int(np.bincount([x for x in kinds if x], minlength=len(SCRIPTS)).argmax())
        padded = [2, *[p for p, x in zip(points, kinds, strict=True) if x], 2]
        score = np.zeros(k)
        for n in li.ORDERS:
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram in ([2], [2, 2]) or 2 in gram[1:-1]:
                    continue
                h = n
                for p in gram:
                    h = ((h ^ p) * 0x100000001B3) % 2**64
                    h ^= h >> 29
                score += model.log_p[h % li.BUCKETS]
        score = li.TEMPER * (score - score.max())
        known = model.uses[script].any()
        if known:
            score[~model.uses[script]] = -1e4
        return score, letters, letters * known

    def brute(text):
        scored = [word_score(w) for w in (text or "").encode().split()]
        if not sum(x[1] for x in scored):
            return "und", 0.0
        value, back = np.zeros(k), []
        for t, (s, _, _) in enumerate(scored):
            if t:
                best = int(value.argmax())
                back.append([j if value[j] >= value[best] - li.SWITCH else best for j in range(k)])
                value = np.maximum(value, value[best] - li.SWITCH)
            value = value + s
        path = [int(value.argmax())]
        for b in reversed(back):
            path.append(b[path[-1]])
        path.reverse()
        sums, own = np.zeros(k), np.zeros(k)
        for j, (_, n, m) in zip(path, scored, strict=True):
            sums[j] += n
            own[j] += m
        best = int(sums.argmax())
        return model.languages[best], own[best] / sums.sum()

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in identify(docs, model).collect():
        lang, score = brute(texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6, r.doc_id


def test_a_table_without_languages_teaches_none(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert not train(docs).languages
    assert not train(docs.selectExpr("*", "CAST(NULL AS STRING) AS lang")).languages
