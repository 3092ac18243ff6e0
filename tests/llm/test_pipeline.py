import corpus_pipeline
from pairwright.llm import language_id, pii
from pairwright.llm.quality import quality_metrics
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import check_places


def test_every_stage_against_plain_code(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    want = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, sf), "test")
        rows = out.collect()
        if name == "quality rules":
            good = {r.doc_id for r in quality_metrics(docs).where("kept").collect()}
        elif name == "language ID":
            good = {r.doc_id for r in language_id.identify(docs, language_id.train(docs)).where("lang_pred <> 'und' AND score >= 0.5").collect()}
        elif name == "n-gram Jaccard join":
            good = {d for d, _, c in brute([(d, r.text) for d, r in want.items()]) if d == c}
        elif name == "PII":
            field = pii.train(docs)
            for r in rows:
                old = want[r.doc_id]
                spans = pii.find(old.text, field)[1]
                assert r.text == pii.masked(old.text, spans)
                assert r.n_chars == (len(r.text) if spans else old.n_chars)
            assert len(rows) == len(want)
        else:
            check_places(rows, [(d, r.text) for d, r in want.items()], 2048)
            break
        assert out.columns == columns
        if name != "PII":
            assert {r.doc_id for r in rows} == good and 0 < len(rows) <= len(want)
        want = {r.doc_id: r for r in rows}
        docs = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect())) == sorted(tuple(r)[:5] for r in rows)


def test_odd_rows_through_every_stage(spark, tmp_path):
    prose = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars BETWEEN 900 AND 3000").limit(20).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "s", 1) for r in prose]
    rows += [rows[0], rows[0], (None, prose[1].text, None, None, None, None, None), (10**12, None, None, None, None, None, 2), (10**12 + 1, "", "en", None, 0, "", 3), (10**12 + 2, prose[2].text * 40, prose[2].lang, None, 1, "long", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string, gone int")
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.staged(stage(spark, at, ""), "odd")
            if name != "best-fit packing":
                assert out.columns == docs.columns
                at = out
        assert (out.count() > 0) == (table is docs)
    kept = {r.doc_id for r in at.collect()}
    assert at.limit(0).columns == docs.columns and kept == set()
