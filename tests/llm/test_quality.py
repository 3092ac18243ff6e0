import re
from collections import Counter

from pairwright.llm.quality import quality_filter, quality_metrics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_figures_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:7] for r in quality_metrics(docs).collect()}
    assert got == want


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "a b c a b c", "x y z ퟿", "same\nsame\n\nsame", "a" * 300_000, "a b c " * 4]
    docs = spark.createDataFrame([(i // 2, t, None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    got = sorted(tuple(r)[1:7] for r in quality_metrics(docs).collect())
    assert got == sorted(plain(t) for t in texts)
    assert quality_metrics(docs.limit(0)).count() == 0
    assert quality_filter(docs).columns == docs.columns


def test_bands_reject_odd_text_and_keep_prose(spark):
    prose = "The committee met on Tuesday morning to discuss how the river crossing should be repaired before winter, and several members asked whether the old stone piers could carry a wider road. " * 1
    more = "An engineer explained that tests made last summer had shown no weakness below the water line. Others worried about cost, traffic and noise, yet nobody wanted another year of delays while the ferry struggled with floods."
    noise = " ".join("%%&& #$ zq" if i % 2 else "!!" for i in range(120))
    docs = spark.createDataFrame([(1, prose + more, "en"), (2, noise, "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in quality_metrics(docs).collect()} == {1: True, 2: False}


def test_own_figures_equal_brute_force(spark, sf):
    import base64
    import math

    import public_tokenizers as p
    import sentencepiece
    import tiktoken

    from pairwright.llm.quality import BANDS, ENTROPY_TOKENS

    model = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    multi = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    for r in quality_metrics(docs).collect():
        words = WORD.findall(rows[r.doc_id].text or "")
        pieces = [i for w in words for i in model.encode(w)]
        n, m = len(pieces), sum(len(multi.encode_ordinary(w)) for w in words)
        counts = Counter(pieces)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
        share = sum(map(model.is_byte, pieces)) / n if n else 0.0
        assert (r.n_tokens, r.n_tokens_multi) == (n, m)
        assert abs(r.entropy - entropy) < 1e-9 and abs(r.byte_share - share) < 1e-12
        chars = sum(map(len, words))
        one, two = (chars / n, chars / m) if n else (0.0, 0.0)
        assert abs(r.chars_per_token - one) < 1e-12 and abs(r.chars_per_token_multi - two) < 1e-12
        if rows[r.doc_id].lang in BANDS:
            assert r.band == rows[r.doc_id].lang
        b = BANDS[r.band]
        good = b.low <= one <= b.high and b.multi_low <= two <= b.multi_high and share <= b.bytes_most and (n < ENTROPY_TOKENS or entropy >= b.least_entropy(n))
        assert r.kept == (good and not plain(rows[r.doc_id].text)[-1])
