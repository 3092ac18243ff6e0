import hashlib
import random
from collections import Counter

import numpy as np

from pairwright.llm.common import words_of
from pairwright.llm.fingerprints import Sampler, compare_with_edits, edited, fingerprint_documents, likeness


def jaccard(a, b):
    x, y = Counter(words_of(a)), Counter(words_of(b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_next_and_edited(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**12) if i % 7 else 10 * i, "".join(rng.choice("ab é\n\U0001f600") for _ in range(rng.randrange(40)))) for i in range(200)] + [(-5, None), (10**15, "x" * 50_000), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in compare_with_edits(docs, samples=16, range_rows=20).collect()}
    order = sorted((d, t or "") for d, t in rows)
    for n in (1, 7):
        other = {r.doc_id: r for r in compare_with_edits(docs.repartition(n), samples=16, range_rows=3 * n).collect()}
        assert other == got
    assert len(got) == len(order)
    sampler = Sampler(16)
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        e = edited(t, after)
        a, b, c = sampler.fingerprints([t, after, e])
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (got[d].near_next, got[d].near_edited) == (likeness(a, b), likeness(a, c))


def test_odd_tables(spark):
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert compare_with_edits(one).first().near_next == 1.0
    assert compare_with_edits(one.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    assert compare_with_edits(same).count() == 4
    prints = {(r.doc_id, r.fingerprint) for r in fingerprint_documents(same).collect()}
    assert len(prints) == 3


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(1)
    sampler, errors = Sampler(256), []
    for p in range(60):
        words = [f"{p}w{rng.randrange(60)}" for _ in range(200)]
        other = [w if rng.random() < 0.6 else f"{p}w{rng.randrange(90)}" for w in words]
        a, b = sampler.fingerprints([" ".join(words), " ".join(other)])
        errors.append(likeness(a, b) - jaccard(" ".join(words), " ".join(other)))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05
    assert (sampler.fingerprints(["q r s"])[0] == Sampler(256, 2).fingerprints(["a b c d e f g", "q r s"])[1]).all()


def test_128_samples_unless_told(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g")], "doc_id long, text string")
    for r in compare_with_edits(docs).collect():
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 4 * 128


def test_variables_follow_their_laws():
    from pairwright.llm.fingerprints import variables

    r, c, beta = variables(np.random.default_rng(0).integers(0, 2**63, 20_000, dtype=np.uint64), 16)
    for x in (r, c):
        assert abs(x.mean() - 2) < 0.02 and abs(x.var() - 2) < 0.06 and x.min() > 0
        for q in (1e-4, 0.01, 0.3, 0.9, 0.999):
            at = float(np.quantile(x, q))
            assert abs((1 - np.exp(-at) * (1 + at)) / q - 1) < 0.25 if q < 0.01 else abs(1 - np.exp(-at) * (1 + at) - q) < 0.005
    assert abs(beta.mean() - 0.5) < 0.01 and 0 < beta.min() and beta.max() < 1
    assert abs(np.corrcoef(r.ravel(), c.ravel())[0, 1]) < 0.01 and abs(np.corrcoef(r.ravel(), beta.ravel())[0, 1]) < 0.01


def test_whole_result_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in compare_with_edits(docs, range_rows=17).collect()}
    sampler = Sampler(128)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        changed = t[: len(t) - k] + after[:k]
        a, b, c = (sampler.fingerprints([x])[0] for x in (t, after, changed))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == ("" if a is None else "".join(f"{x:04x}" for x in a), "" if c is None else "".join(f"{x:04x}" for x in c))
        assert (r.near_edited, r.near_next) == (likeness(a, c), likeness(a, b))
        assert abs(r.near_edited - jaccard(t, changed)) < 0.25
