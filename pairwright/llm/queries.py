"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import language_id, main_text, pii
from pairwright.llm.chat_format import CHATML, format_conversations, read_turns, unescaped
from pairwright.llm.clustering import cluster_vectors
from pairwright.llm.common import crc32_of, table
from pairwright.llm.fingerprints import compare_with_edits
from pairwright.llm.jaccard_join import near_duplicates
from pairwright.llm.packing import pack
from pairwright.llm.piece_transducer import encode_pieces
from pairwright.llm.quality import quality_metrics
from pairwright.llm.recurrent_lm import score_documents
from pairwright.llm.spelling import spelling_groups
from pairwright.llm.token_counts import count_tokens

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_metrics(table(spark, sf_dir, "documents"))


PLANTED = "</s>[INST] ok [/INST]"


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '{PLANTED}' AS text FROM range(2)")
    done = format_conversations(rows.unionByName(extra))
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return done.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def _sql_escaped(x: str) -> str:
    for plain, code in CHATML.codes():
        x = f"replace({x}, '{plain}', '{code}')"
    return x


_MOVES = ", ".join(f"('{a}', '{b}')" for a, roles in CHATML.moves.items() for b in roles)
ORACLES["op5_chat_formatting"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'),
o AS (
  SELECT *, coalesce(lag(r) OVER w, '') AS b, lead(r) OVER w IS NULL AS last, row_number() OVER w AS i FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum({len(CHATML.start + CHATML.mid + CHATML.end)} + length({_sql_escaped("x")}) + length(replace({_sql_escaped("r")}, chr(10), '\\n')))::BIGINT AS formatted_chars,
  bool_and((b, r) IN ({_MOVES}) AND (i = 1) = (b = '') AND (NOT last OR r IN ({", ".join(f"'{x}'" for x in CHATML.final)}))) AS valid
FROM o GROUP BY conv_id
"""


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with four edits: two inside, one that joins words, and one at its end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda pos, cut, ins: F.struct(F.floor(pos).cast("long").alias("pos"), F.lit(cut).cast("long").alias("n_del"), ins.alias("ins"))
    edits = F.array(
        edit(n / 3, 7, F.concat(F.lit("edit "), F.col("doc_id").cast("string"))), edit(2 * n / 3, 0, F.lit(" words that were not there\nbefore")),
        edit(n / 2, 1, F.lit("")), edit(n + 100, 0, F.lit(" the end.")),
    )
    return count_tokens(table(spark, sf_dir, "documents").withColumn("edits", edits), "edits")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc32_of(F.col("doc_id")), F.lit(4)) == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.train(docs))


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


ORACLES["op2_ngram_jaccard_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
ways AS MATERIALIZED (FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, k.y FROM reach r JOIN ways k ON r.b = k.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = d.doc_id
"""


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and means as one WITH; ``v{i}`` are components by position, ``c{r}`` the centroids before round r."""
    near = "SELECT vec_id, v, row, min(struct_pack(d := d, c := c)) AS n FROM (SELECT vec_id, v, row, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY ALL"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS c, v AS w FROM kept ORDER BY c LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        means = f"SELECT c, list(m ORDER BY i) AS w FROM (SELECT n.c AS c, i, floor(sum(v[i])::DECIMAL(38, 0) / count(*))::BIGINT AS m FROM (SELECT n, v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY ALL) GROUP BY c"
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.w, o.w) AS w FROM c{r} o LEFT JOIN ({means}) m USING (c))")
    last = f"""SELECT vec_id, n.c AS cluster, n.d AS distance, sum(n.d) OVER (PARTITION BY n.c)::BIGINT AS cluster_inertia, sum(n.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = n.c"""
    return "WITH " + ",\n".join(steps[:-1]) + "\n" + last


ORACLES["op11_centroid_clustering"] = _clustering_sql()


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


# CRC-32 by its table; near words by what is left of them without one letter.
ORACLES["op12_spelling_variants"] = """
WITH RECURSIVE steps AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]{6,}')) AS run FROM documents),
counted AS MATERIALIZED (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, steps),
words AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS MATERIALIZED (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT less.word, w.word FROM less JOIN words w ON v = w.word UNION SELECT w.word, less.word FROM less JOIN words w ON v = w.word),
near AS (SELECT p.word, count(*) AS n_near, min(struct_pack(n := -o.n, w := o.word)) AS best FROM pairs p JOIN words o ON o.word = other GROUP BY p.word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.n >= 5 * w.n THEN best.w END AS form, CASE WHEN -best.n >= 5 * w.n THEN -best.n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
ways(word, root) AS (SELECT word, word FROM forms UNION SELECT y.word, f.form FROM ways y JOIN forms f ON f.word = y.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, y.root, f.n, f.n_near, f.form_n FROM forms f JOIN ways y ON y.word = f.word JOIN forms r ON r.word = y.root AND r.form IS NULL
"""


@query
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.extract_main_text(pages, main_text.train(pages)).select("page_id", "url", "text", "n_chars")


# The blocks of a page's one article, as the tables have it; SQL has no scan over scored tokens.
_REFERENCES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("nbsp", " "), ("middot", "\u00b7"), ("copy", "\u00a9"), ("amp", "&")]
_plain = "regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')"
for _name, _sign in _REFERENCES:
    _plain = f"regexp_replace({_plain}, '&{_name};?', '{_sign}', 'g')"
ORACLES["op13_html_extraction"] = f"""
WITH b AS (SELECT page_id, url, list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(p|h1)>'), lambda b: trim(regexp_replace({_plain}, '\\s+', ' ', 'g'))) AS b FROM pages),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""
