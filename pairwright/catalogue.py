"""Queries by name, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import boxes, codes, tags, times
from pairwright.functions.codes import INCMP, NEGTV, POSTV, UNREV
from pairwright.operators import actions, bridges, candidates, delta, feedback, graph, metrics, priority, recovery, rectify, redundancy, refresh, search, truth
from pairwright.operators.components import AT_ONCE, connected_components
from pairwright.session import growing
from pairwright.sources import fixtures as fx
from pairwright.sources import tables
from pairwright.streaming.reviews import replay

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# SQL parts -----------------------------------------------------------------------------

_CONFIDENCE = ", ".join(f"'{c}'" for c in fx.CONFIDENCES)
_FX1 = f"""
annots AS MATERIALIZED (SELECT o_orderkey AS aid, o_custkey AS name FROM orders),
lagged AS (SELECT lag(aid, 1) OVER w AS a, lag(aid, 2) OVER w AS b, aid AS v FROM annots WINDOW w AS (PARTITION BY name ORDER BY aid)),
items AS MATERIALIZED (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, l_orderkey AS o FROM lineitem),
named AS MATERIALIZED (SELECT p, s, o, name FROM items JOIN annots ON o = aid),
crossing AS MATERIALIZED (SELECT DISTINCT x.o AS u, y.o AS v FROM named x JOIN named y USING (p, s) WHERE x.o < y.o AND x.name <> y.name),
raw AS (
  SELECT a AS aid1, v AS aid2, CASE (7 * a + 13 * v) % 20 WHEN 0 THEN 'INCMP' WHEN 1 THEN 'UNREV' WHEN 2 THEN 'UNKWN' ELSE 'POSTV' END AS decision FROM lagged WHERE a IS NOT NULL
  UNION ALL SELECT b, v, CASE WHEN (11 * b + 5 * v) % 20 < 10 THEN 'POSTV' WHEN (11 * b + 5 * v) % 20 = 10 THEN 'NEGTV' WHEN (11 * b + 5 * v) % 20 < 13 THEN 'INCMP' ELSE 'UNREV' END FROM lagged WHERE b IS NOT NULL AND (11 * b + 5 * v) % 20 < 15
  UNION ALL SELECT u, v, CASE WHEN (3 * u + 7 * v) % 200 = 0 THEN 'POSTV' WHEN (3 * u + 7 * v) % 10 < 6 THEN 'NEGTV' WHEN (3 * u + 7 * v) % 10 < 8 THEN 'INCMP' ELSE 'UNREV' END FROM crossing),
edges AS MATERIALIZED (SELECT aid1, aid2, decision, [{_CONFIDENCE}][1 + (aid1 + aid2) % 5] AS confidence, 1 + (aid1 * aid2) % 3 AS num_reviews, ((31 * aid1 + 17 * aid2) % 1000) / 1000.0 AS prob_match FROM raw)"""
_PCC = """,
sym AS MATERIALIZED (SELECT aid1 AS u, aid2 AS v FROM edges WHERE decision = 'POSTV' UNION ALL SELECT aid2, aid1 FROM edges WHERE decision = 'POSTV'),
reach(a, b) AS (SELECT aid, aid FROM annots UNION SELECT r.a, s.v FROM reach r JOIN sym s ON r.b = s.u),
pcc AS MATERIALIZED (SELECT a AS aid, min(b) AS nid FROM reach GROUP BY a),
labelled AS MATERIALIZED (SELECT e.*, least(x.nid, y.nid) AS nid1, greatest(x.nid, y.nid) AS nid2 FROM edges e JOIN pcc x ON aid1 = x.aid JOIN pcc y ON aid2 = y.aid),
sizes AS (SELECT nid, count(*) AS n_nodes FROM pcc GROUP BY nid),
bad AS MATERIALIZED (SELECT DISTINCT nid1 AS nid FROM labelled WHERE nid1 = nid2 AND decision = 'NEGTV'),
meta AS MATERIALIZED (SELECT nid1, nid2, count(*) AS weight FROM labelled WHERE decision = 'NEGTV' GROUP BY nid1, nid2)"""


def on_edges(sql: str, more: str = "") -> str:
    return f"WITH {_FX1}{more}\n{sql}"


def on_pcc(sql: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_FX1}{_PCC}{more}\n{sql}"


_LOG = """log AS MATERIALIZED (
  SELECT event_id AS review_id, least(user_id, k) AS aid1, greatest(user_id, k) AS aid2, CASE event_type WHEN 'purchase' THEN 'POSTV' WHEN 'error' THEN 'NEGTV' WHEN 'view' THEN 'INCMP' WHEN 'signup' THEN 'UNKWN' ELSE 'UNREV' END AS d,
    CASE WHEN event_id % 4 = 0 THEN 'algo:x' ELSE 'user:' || user_id % 7 END AS who, event_id % 11 = 0 AS meaningful, CASE WHEN event_id % 5 = 0 THEN 'dark' ELSE '' END AS tag
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE user_id <> k)"""
_PROBS = """, scored AS MATERIALIZED (
  SELECT aid1, aid2, CASE WHEN x.name = y.name THEN 'POSTV' ELSE 'NEGTV' END AS truth, CASE WHEN x.name = y.name THEN 0.6::DOUBLE + ((31 * aid1 + 17 * aid2) % 400) / 1000.0::DOUBLE ELSE ((31 * aid1 + 17 * aid2) % 500) / 1000.0::DOUBLE END AS p
  FROM edges JOIN annots x ON aid1 = x.aid JOIN annots y ON aid2 = y.aid),
probs AS MATERIALIZED (SELECT aid1, aid2, truth, round(p, 6) AS POSTV, round((1 - p) * ((7 * aid1 + 3 * aid2) % 100) / 100, 6) AS NEGTV, round(1 - p - (1 - p) * ((7 * aid1 + 3 * aid2) % 100) / 100, 6) AS INCMP FROM scored)"""
_RANKING = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT q.id AS qaid, d.id AS daid, round(list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))), 6) AS score FROM v q JOIN v d ON q.id <> d.id WHERE q.id % 100 = 0),
ranking AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qaid ORDER BY score DESC, daid) AS rank FROM near) WHERE rank <= 5)"""
THRESHOLDS = {POSTV: 0.85, NEGTV: 0.8, INCMP: 0.7}


# Decisions and attributes --------------------------------------------------------------


@query(on_edges("""SELECT aid1, aid2, CASE WHEN meta = 'same' AND decision IN ('INCMP', 'UNREV', 'UNKWN') THEN 'POSTV' WHEN meta = 'diff' AND decision IN ('INCMP', 'UNREV', 'UNKWN') THEN 'NEGTV' ELSE decision END AS decision
FROM (SELECT *, CASE WHEN (aid1 + aid2) % 5 = 0 AND decision <> 'NEGTV' THEN 'same' WHEN (aid1 + aid2) % 5 = 1 AND decision <> 'POSTV' THEN 'diff' ELSE 'null' END AS meta FROM edges)"""))
def decision_rectify(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.expr("CASE WHEN (aid1 + aid2) % 5 = 0 AND evidence_decision <> 'NEGTV' THEN 'same' WHEN (aid1 + aid2) % 5 = 1 AND evidence_decision <> 'POSTV' THEN 'diff' ELSE 'null' END")
    return fx.order_edges(spark, sf_dir).select("aid1", "aid2", codes.rectified(F.col("evidence_decision"), meta).alias("decision"))


@query(f"WITH {_LOG} SELECT aid1, aid2, max(review_id) AS review_id, arg_max(d, review_id) AS decision, arg_max(who, review_id) AS user_id, count(*) AS num_reviews FROM log GROUP BY aid1, aid2")
def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.latest_reviews(fx.event_reviews(spark, sf_dir)).select("aid1", "aid2", "review_id", "decision", "user_id", "num_reviews")


@query(f"WITH {_LOG} SELECT n AS num_reviews, count(*) AS n_edges FROM (SELECT count(*) AS n FROM log GROUP BY aid1, aid2) GROUP BY n")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.latest_reviews(fx.event_reviews(spark, sf_dir)).groupBy("num_reviews").agg(F.count("*").alias("n_edges"))


@query(on_edges("SELECT a.aid1, a.aid2, CASE WHEN e.aid1 IS NULL OR e.confidence = 'unspecified' THEN 'none' ELSE e.confidence END AS confidence FROM (SELECT DISTINCT aid1, aid2 + 1 AS aid2 FROM edges) a LEFT JOIN edges e USING (aid1, aid2)"))
def edge_attr_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fx.order_edges(spark, sf_dir).withColumn("confidence", F.nullif(F.col("confidence"), F.lit("unspecified")))
    asked = edges.select("aid1", (F.col("aid2") + 1).alias("aid2")).distinct()
    return graph.attributes(asked, edges, "confidence", on_missing="default", on_keyerr="default", default="none")


@query(on_edges("SELECT aid1, aid2, confidence FROM edges WHERE confidence <> 'unspecified' AND prob_match > 0.5"))
def edges_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_where(graph.edges_where(fx.order_edges(spark, sf_dir), "confidence", "ne", "unspecified"), "prob_match", "gt", 0.5).select("aid1", "aid2", "confidence")


# Components ----------------------------------------------------------------------------


def _state(spark, sf_dir):
    return fx.order_edges(spark, sf_dir), fx.order_pcc(spark, sf_dir)


def _labelled(spark, sf_dir):
    """`_state` for steps that ask for the components of the same edges again and again."""
    return fx.order_labelled(spark, sf_dir), growing(fx.order_pcc(spark, sf_dir))


@query(on_pcc("SELECT aid, nid FROM pcc"))
def pcc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(fx.order_edges(spark, sf_dir).where(F.col("decision") == POSTV), nodes=fx.order_annots(spark, sf_dir))


_SUMMARY = """SELECT s.nid, s.n_nodes, count(*) FILTER (decision = 'POSTV') AS n_pos, count(*) FILTER (decision = 'NEGTV') AS n_neg_inside, count(*) FILTER (decision = 'INCMP') AS n_incmp_inside, s.n_nodes <= 2 OR count(*) FILTER (decision = 'NEGTV') = 0 AS is_consistent
FROM sizes s LEFT JOIN (SELECT * FROM labelled WHERE nid1 = nid2) l ON s.nid = l.nid1 GROUP BY s.nid, s.n_nodes"""


@query(on_pcc(_SUMMARY))
def pcc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pcc_summary(*_state(spark, sf_dir))


@query(on_pcc("SELECT n_nodes, count(*) AS n FROM sizes GROUP BY n_nodes"))
def pcc_size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.order_pcc(spark, sf_dir).groupBy("nid").agg(F.count("*").alias("n_nodes")).groupBy("n_nodes").agg(F.count("*").alias("n"))


@query(on_pcc("SELECT nid, string_agg(aid::VARCHAR, ',' ORDER BY aid) AS members FROM pcc GROUP BY nid"))
def component_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.order_pcc(spark, sf_dir).groupBy("nid").agg(F.array_join(F.sort_array(F.collect_list("aid")).cast("array<string>"), ",").alias("members"))


@query(on_pcc("SELECT aid1, aid2, nid1 = nid2 AS connected FROM labelled"))
def connected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, pcc = _state(spark, sf_dir)
    return graph.same_component(edges.select("aid1", "aid2"), pcc)


@query(on_pcc("SELECT nid, n_nodes FROM sizes WHERE nid IN (FROM bad)"))
def inconsistent_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pcc_summary(*_state(spark, sf_dir)).where("NOT is_consistent").select("nid", "n_nodes")


@query(on_pcc("SELECT aid1, aid2, decision, nid1 AS nid FROM labelled WHERE nid1 = nid2"))
def edges_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_inside(*_state(spark, sf_dir)).select("aid1", "aid2", "decision", F.col("nid1").alias("nid"))


@query(on_pcc("SELECT aid1, aid2, decision, nid1, nid2 FROM labelled WHERE nid1 <> nid2"))
def edges_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_cross(*_state(spark, sf_dir)).select("aid1", "aid2", "decision", "nid1", "nid2")


@query(on_pcc("SELECT aid1, aid2 FROM edges WHERE (aid1 IN (SELECT aid FROM pcc WHERE nid IN (FROM bad))) <> (aid2 IN (SELECT aid FROM pcc WHERE nid IN (FROM bad)))"))
def edges_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, pcc = _state(spark, sf_dir)
    return graph.edges_outgoing(edges, pcc.join(graph.inconsistent(edges, pcc), "nid", "left_semi")).select("aid1", "aid2")


@query(on_pcc("SELECT nid1, nid2, decision, count(*) AS n FROM labelled GROUP BY ALL"))
def meta_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.meta_edges(*_state(spark, sf_dir))


@query(on_pcc("SELECT nid1, nid2, weight FROM meta"))
def neg_metagraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neg_metagraph(*_state(spark, sf_dir))


@query(on_pcc("SELECT nid1 AS nid, nid2 AS other, weight AS freq FROM meta WHERE nid1 <> nid2 UNION ALL SELECT nid2, nid1, weight FROM meta WHERE nid1 <> nid2"))
def neg_nid_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neg_nid_freq(*_state(spark, sf_dir))


@query(on_pcc("""SELECT aid1, aid2, decision, CASE WHEN l.nid1 = l.nid2 AND l.nid1 IN (FROM bad) THEN 'inconsistent_internal' WHEN l.nid1 = l.nid2 THEN 'same' WHEN l.nid1 IN (FROM bad) OR l.nid2 IN (FROM bad) THEN 'inconsistent_external'
  WHEN m.weight IS NOT NULL THEN 'diff' WHEN decision IN ('INCMP', 'UNKWN') THEN decision END AS inferred_state FROM labelled l LEFT JOIN meta m ON l.nid1 = m.nid1 AND l.nid2 = m.nid2"""))
def inferred_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inferred_state(*_state(spark, sf_dir)).select("aid1", "aid2", "decision", "inferred_state")


_STATUS = "SELECT (SELECT count(*) FROM pcc) AS n_nodes, (SELECT count(*) FROM sizes) AS n_pccs, (SELECT count(*) FROM sizes WHERE n_nodes = 1) AS n_singletons, (SELECT count(*) FROM bad) AS n_inconsistent, count(*) AS n_edges, " + ", ".join(f"count(*) FILTER (decision = '{d}') AS n_{d.lower()}" for d in graph.DECISIONS)


@query(on_pcc(_STATUS + " FROM labelled"))
def status_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.status(*_state(spark, sf_dir))


@query(on_pcc(_STATUS + ", " + ", ".join(f"count(*) FILTER (decision = '{d}' AND nid1 {o} nid2) AS n_{d.lower()}_{w}" for d in (NEGTV, INCMP, UNREV) for o, w in (("=", "within"), ("<>", "between"))) + " FROM labelled"))
def status_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.status(*_state(spark, sf_dir), extended=True)


@query(on_pcc(f"""SELECT CASE WHEN n_nodes <= 2 OR n_neg_inside = 0 THEN 'consistent' ELSE 'inconsistent' END AS category, round(avg(n_nodes), 6) AS mean, round(stddev_pop(n_nodes), 6) AS std, max(n_nodes)::DOUBLE AS max, min(n_nodes)::DOUBLE AS min,
  count(*) AS size, sum(n_nodes)::DOUBLE AS total FROM ({_SUMMARY}) GROUP BY 1"""))
def name_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.pcc_summary(*_state(spark, sf_dir)).withColumn("category", F.when(F.col("is_consistent"), "consistent").otherwise("inconsistent"))
    return metrics.stats(rows, "n_nodes", ["category"]).select("category", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "max", "min", "size", "total")


# Redundancy, errors, candidates --------------------------------------------------------


_APART = """SELECT m.nid1, m.nid2 FROM meta m JOIN sizes a ON m.nid1 = a.nid JOIN sizes b ON m.nid2 = b.nid WHERE m.nid1 < m.nid2 AND m.nid1 NOT IN (FROM bad) AND (weight >= 2 OR weight = a.n_nodes OR weight = b.n_nodes)"""


@query(on_pcc(_APART))
def neg_redundant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.negative_redundancy(*_state(spark, sf_dir))


@query(on_pcc("SELECT nid1, nid2, count(*) FILTER (decision = 'NEGTV') AS weight FROM labelled WHERE nid1 <> nid2 GROUP BY nid1, nid2 HAVING count(*) FILTER (decision = 'NEGTV') < 2"))
def non_neg_redundant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.non_redundant_pairs(*_state(spark, sf_dir))


_HELD = """SELECT s.nid, (n_pos + n_incmp_inside = n_nodes * (n_nodes - 1) / 2) OR (n_nodes >= 3 AND s.nid NOT IN (SELECT nid FROM bridged)) AS pos_redun FROM summary s"""
_BRIDGED = f""",
summary AS MATERIALIZED (SELECT * FROM ({_SUMMARY}) WHERE is_consistent),
inner_edges AS MATERIALIZED (SELECT aid1, aid2, nid1 AS nid FROM labelled WHERE decision = 'POSTV' AND nid1 IN (SELECT nid FROM summary WHERE n_nodes >= 3)),
walk(e1, e2, x) AS (SELECT aid1, aid2, aid1 FROM inner_edges UNION SELECT w.e1, w.e2, s.v FROM walk w JOIN sym s ON s.u = w.x WHERE NOT (least(s.u, s.v) = w.e1 AND greatest(s.u, s.v) = w.e2)),
bridged AS MATERIALIZED (SELECT DISTINCT nid FROM inner_edges i WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.e1 = i.aid1 AND w.e2 = i.aid2 AND w.x = i.aid2))"""


@query(on_pcc(_HELD, _BRIDGED))
def pos_redundant_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.positive_redundancy(*_state(spark, sf_dir), k=2)


# Two edges a and b are a cut if the ends of a are apart without both; a bridge is one with itself.
_TRIPLE = """,
able AS MATERIALIZED (SELECT nid FROM (SELECT nid, x, count(*) AS d FROM (SELECT nid, unnest([aid1, aid2]) AS x FROM inner_edges) GROUP BY ALL) GROUP BY nid HAVING min(d) >= 3),
three AS MATERIALIZED (SELECT * FROM inner_edges WHERE nid IN (FROM able)),
twos AS MATERIALIZED (SELECT a.nid, a.aid1 AS a1, a.aid2 AS a2, b.aid1 AS b1, b.aid2 AS b2 FROM three a JOIN three b ON a.nid = b.nid),
apart(a1, a2, b1, b2, x) AS (SELECT a1, a2, b1, b2, a1 FROM twos UNION SELECT w.a1, w.a2, w.b1, w.b2, s.v FROM apart w JOIN sym s ON s.u = w.x
  WHERE NOT (least(s.u, s.v) = w.a1 AND greatest(s.u, s.v) = w.a2) AND NOT (least(s.u, s.v) = w.b1 AND greatest(s.u, s.v) = w.b2)),
cut AS MATERIALIZED (SELECT DISTINCT nid FROM twos t WHERE NOT EXISTS (SELECT 1 FROM apart w WHERE (w.a1, w.a2, w.b1, w.b2) = (t.a1, t.a2, t.b1, t.b2) AND w.x = t.a2))"""


@query(on_pcc("SELECT nid, (n_pos + n_incmp_inside = n_nodes * (n_nodes - 1) / 2) OR (n_nodes >= 4 AND nid IN (FROM able) AND nid NOT IN (FROM cut)) AS pos_redun FROM summary", _BRIDGED + _TRIPLE))
def pos_redundant_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.positive_redundancy(*_state(spark, sf_dir), k=3)


@query()
def hypothesis_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.hypotheses(*_state(spark, sf_dir))


@query(on_pcc("""SELECT aid1, aid2, nid1 IN (FROM marked) OR nid2 IN (FROM marked) AS recovering FROM labelled""", """,
marked AS MATERIALIZED (FROM bad UNION SELECT nid1 FROM meta WHERE nid2 IN (FROM bad) UNION SELECT nid2 FROM meta WHERE nid1 IN (FROM bad))"""))
def is_recovering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.recovering(*_state(spark, sf_dir)).select("aid1", "aid2", "recovering")


@query(on_edges("SELECT a.aid AS aid1, b.aid AS aid2 FROM annots a JOIN annots b ON a.name = b.name AND a.aid < b.aid LEFT JOIN edges e ON e.aid1 = a.aid AND e.aid2 = b.aid WHERE coalesce(decision, 'UNREV') = 'UNREV'"))
def clique_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.clique_pairs(_names(spark, sf_dir), fx.order_edges(spark, sf_dir))


def _names(spark, sf_dir):
    return fx.order_annots(spark, sf_dir).withColumnRenamed("orig_name_label", "name")


@query(on_edges("SELECT a.name, a.aid AS aid1, b.aid AS aid2 FROM annots a JOIN annots b ON a.name = b.name AND a.aid < b.aid LEFT JOIN edges e ON e.aid1 = a.aid AND e.aid2 = b.aid WHERE e.aid1 IS NULL"))
def complement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.complement(_names(spark, sf_dir), fx.order_edges(spark, sf_dir))


_FRAGMENTS = """,
psym AS MATERIALIZED (SELECT aid1 AS u, aid2 AS v FROM edges JOIN annots x ON aid1 = x.aid JOIN annots y ON aid2 = y.aid WHERE decision = 'POSTV' AND x.name = y.name),
pways AS MATERIALIZED (FROM psym UNION ALL SELECT v, u FROM psym),
freach(a, b) AS (SELECT aid, aid FROM annots UNION SELECT r.a, s.v FROM freach r JOIN pways s ON r.b = s.u),
frag AS MATERIALIZED (SELECT name, aid, f FROM annots JOIN (SELECT a AS aid, min(b) AS f FROM freach GROUP BY a) USING (aid)),
open_pairs AS MATERIALIZED (SELECT x.name, x.f, y.f AS p, x.aid AS u, y.aid AS v FROM frag x JOIN frag y ON x.name = y.name AND x.f <> y.f
  LEFT JOIN edges e ON e.aid1 = least(x.aid, y.aid) AND e.aid2 = greatest(x.aid, y.aid) WHERE coalesce(decision, '') NOT IN ('NEGTV', 'INCMP')),
near AS MATERIALIZED (SELECT DISTINCT name, f, p FROM open_pairs),
frs AS MATERIALIZED (SELECT DISTINCT name, f FROM frag),
open_to AS (SELECT f, count(*) AS k FROM near GROUP BY f),
hubs AS MATERIALIZED (SELECT f FROM (SELECT f, count(*) OVER (PARTITION BY name) - 1 AS others FROM frs) LEFT JOIN open_to USING (f) WHERE coalesce(k, 0) = others),
tree(f, g) AS (SELECT f, f FROM frs UNION SELECT t.f, n.p FROM tree t JOIN near n ON n.f = t.g),
root AS MATERIALIZED (SELECT f, coalesce(min(g) FILTER (g IN (FROM hubs)), min(g)) AS root FROM tree GROUP BY f),
walk(f, d) AS (SELECT DISTINCT root, 0 FROM root UNION SELECT n.p, d + 1 FROM walk w JOIN near n ON n.f = w.f WHERE d < 9),
level AS MATERIALIZED (SELECT f, min(d) AS d FROM walk GROUP BY f),
up AS MATERIALIZED (SELECT l.f, min(n.p) AS p FROM level l JOIN near n ON n.f = l.f JOIN level m ON m.f = n.p AND m.d = l.d - 1 GROUP BY l.f)"""


@query(f"WITH RECURSIVE {_FX1}{_FRAGMENTS} SELECT name, least(u, v) AS aid1, greatest(u, v) AS aid2 FROM (SELECT o.*, row_number() OVER (PARTITION BY f, p ORDER BY u, v) AS r FROM open_pairs o JOIN up USING (f, p)) WHERE r = 1")
def mst_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.fragment_links(_names(spark, sf_dir), fx.order_edges(spark, sf_dir))


@query()
def pos_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.positive_augmentation(*_labelled(spark, sf_dir))


_NEED = """,
need AS MATERIALIZED (SELECT nid1, nid2, 2 - count(*) FILTER (decision = 'NEGTV') AS need, count(*) FILTER (decision = 'UNREV') AS open, count(*) AS m FROM labelled WHERE nid1 <> nid2 {more} GROUP BY nid1, nid2 HAVING count(*) FILTER (decision = 'NEGTV') < 2),
opened AS (SELECT l.nid1, l.nid2, aid1, aid2, true AS existing FROM (SELECT *, row_number() OVER (PARTITION BY nid1, nid2 ORDER BY aid1, aid2) AS r FROM labelled WHERE decision = 'UNREV') l JOIN need USING (nid1, nid2) WHERE r <= need),
ranked AS MATERIALIZED (SELECT nid, aid, row_number() OVER (PARTITION BY nid ORDER BY aid) - 1 AS r, count(*) OVER (PARTITION BY nid) AS size FROM pcc),
made AS MATERIALIZED (SELECT nid1, nid2, need - open AS lacks, a.n_nodes AS n1, b.n_nodes AS n2, unnest(range(least(need - open + m, a.n_nodes * b.n_nodes))) AS i FROM need JOIN sizes a ON a.nid = nid1 JOIN sizes b ON b.nid = nid2 WHERE need > open),
absent AS (SELECT nid1, nid2, lacks, least(x.aid, y.aid) AS aid1, greatest(x.aid, y.aid) AS aid2, row_number() OVER (PARTITION BY nid1, nid2 ORDER BY i) AS r
  FROM made JOIN ranked x ON x.nid = nid1 AND x.r = i % n1 JOIN ranked y ON y.nid = nid2 AND y.r = (i + i // lcm(n1, n2)) % n2
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.aid1 = least(x.aid, y.aid) AND e.aid2 = greatest(x.aid, y.aid)))"""


@query(on_pcc("SELECT * FROM opened UNION ALL SELECT nid1, nid2, aid1, aid2, false FROM absent WHERE r <= lacks", _NEED.format(more="")))
def neg_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, pcc = _state(spark, sf_dir)
    return redundancy.negative_augmentation(edges, pcc, redundancy.non_redundant_pairs(edges, pcc).select("nid1", "nid2"))


# Ranking, verifying, priorities --------------------------------------------------------


@query(f"WITH {_RANKING} SELECT qaid, daid, score, rank FROM ranking")
def ranker_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.embedding_ranking(spark, sf_dir)


@query(f"WITH {_RANKING} SELECT qaid, daid, score, rank, CASE WHEN rank <= 2 THEN 'top' WHEN rank > n - 1 THEN 'bottom' WHEN rank > (n - 1) // 2 AND rank <= (n - 1) // 2 + 1 THEN 'middle' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY qaid) AS n FROM ranking) WHERE part IS NOT NULL")
def rank_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.slices(fx.embedding_ranking(spark, sf_dir), 2, 1, 1)


@query(f"WITH {_RANKING} SELECT qaid, daid, score, rank, round(score / (SELECT max(score) FROM ranking), 6) AS normscore FROM ranking")
def normscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.normalised(fx.embedding_ranking(spark, sf_dir)).withColumn("normscore", F.round("normscore", 6))


@query(f"WITH {_RANKING} SELECT aid1, aid2, score, min(rank) AS rank FROM (SELECT least(qaid, daid) AS aid1, greatest(qaid, daid) AS aid2, score, rank, max(score) OVER (PARTITION BY least(qaid, daid), greatest(qaid, daid)) AS best FROM ranking) WHERE score = best GROUP BY aid1, aid2, score")
def edge_best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.edge_scores(fx.embedding_ranking(spark, sf_dir))


@query(f"WITH {_RANKING} SELECT label, daid, max(score) AS score FROM ranking JOIN embeddings ON qaid = vec_id GROUP BY label, daid")
def agg_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qaid"), "label")
    return fx.embedding_ranking(spark, sf_dir).join(labels, "qaid").groupBy("label", "daid").agg(F.max("score").alias("score"))


@query(on_edges("SELECT * FROM probs", _PROBS))
def verifier_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.order_probs(spark, sf_dir)


@query(on_pcc("SELECT aid1, aid2, round(CASE WHEN i > 0.7 THEN greatest(b2, i) + 1 ELSE b2 END, 6) AS priority FROM (SELECT *, CASE WHEN n > 0.8 THEN greatest(b1, n) + 1 ELSE b1 END AS b2 FROM (SELECT *, CASE WHEN p > 0.85 THEN greatest(b, p) + 1 ELSE b END AS b1 FROM (SELECT aid1, aid2, POSTV::DOUBLE AS p, NEGTV::DOUBLE AS n, INCMP::DOUBLE AS i, CASE WHEN nid1 = nid2 THEN 1 - POSTV::DOUBLE ELSE POSTV::DOUBLE END AS b FROM probs JOIN labelled USING (aid1, aid2))))", _PROBS))
def priority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.scores(fx.order_probs(spark, sf_dir), fx.order_pcc(spark, sf_dir), THRESHOLDS).select("aid1", "aid2", F.round("priority", 6).alias("priority"))


def _queue(spark, sf_dir):
    edges, pcc = _labelled(spark, sf_dir)
    return priority.queue(edges, _needless(edges, pcc), recovery.hypotheses(edges, pcc))


@query()
def review_queue_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pairs of the queue: suspected errors, then what no redundancy makes needless."""
    return priority.top(_queue(spark, sf_dir), 50)


@query(on_edges("SELECT aid1, aid2, CASE WHEN (POSTV > 0.85)::INT + (NEGTV > 0.8)::INT + (INCMP > 0.7)::INT = 1 THEN CASE WHEN POSTV = greatest(POSTV, NEGTV, INCMP) THEN 'POSTV' WHEN NEGTV = greatest(POSTV, NEGTV, INCMP) THEN 'NEGTV' ELSE 'INCMP' END END AS auto_decision FROM probs", _PROBS))
def auto_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.auto_review(fx.order_probs(spark, sf_dir), THRESHOLDS).select("aid1", "aid2", "auto_decision")


_ANSWER = "SELECT aid1, aid2, truth, CASE WHEN ((aid1 * 7919 + aid2 * 104729) % 10007) / 10007.0::DOUBLE > 0.9 THEN CASE truth WHEN 'POSTV' THEN 'NEGTV' ELSE 'POSTV' END ELSE truth END AS answer FROM probs"


def _answers(spark, sf_dir):
    return priority.oracle_review(fx.order_probs(spark, sf_dir), 0.9).select("aid1", "aid2", "truth", "answer")


@query(on_edges(_ANSWER, _PROBS))
def oracle_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir)


@query(on_edges(f"SELECT truth, answer AS pred, count(*) AS n FROM ({_ANSWER}) GROUP BY ALL", _PROBS))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_answers(spark, sf_dir), pred="answer")


@query(on_edges(f"SELECT * FROM ({_ANSWER}) WHERE answer <> truth", _PROBS))
def error_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_edges(_answers(spark, sf_dir), pred="answer")


# Stopping, history ---------------------------------------------------------------------

_MANUAL = f"WITH {_LOG}, m AS (SELECT meaningful, row_number() OVER (ORDER BY review_id DESC) - 1 AS age, count(*) OVER () AS n FROM log WHERE who NOT LIKE 'algo%')"
_MU = "SELECT max(n) AS n, pow(1 - 2.0::DOUBLE / 21, max(n)) + 2.0::DOUBLE / 21 * coalesce(sum(CASE WHEN meaningful THEN pow(1 - 2.0::DOUBLE / 21, age) END), 0) AS mu FROM m"


@query(f"{_MANUAL} SELECT n, round(mu, 6) AS mu FROM ({_MU})")
def refresh_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.ewma(fx.event_reviews(spark, sf_dir)).select("n", F.round("mu", 6).alias("mu"))


@query(f"{_MANUAL} SELECT avg(meaningful::INT) AS pos_frac FROM m WHERE age < 20")
def refresh_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.window_mean(fx.event_reviews(spark, sf_dir))


@query(f"{_MANUAL} SELECT n, round(1 - pow(1 - mu, 72), 6) AS p_any, 1 - pow(1 - mu, 72) < 0.052 AS done FROM ({_MU})")
def refresh_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.stop(fx.event_reviews(spark, sf_dir)).select("n", F.round("p_any", 6).alias("p_any"), "done")


@query(f"""WITH {_LOG} SELECT who AS user_id, min(review_id) AS first, max(review_id) AS last, count(*) AS n, d AS evidence_decision FROM (
  SELECT *, row_number() OVER (PARTITION BY who ORDER BY review_id) - row_number() OVER (PARTITION BY who, d ORDER BY review_id) AS g FROM log) GROUP BY who, d, g""")
def recovery_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.blocks(fx.event_reviews(spark, sf_dir), "evidence_decision", "review_id", by="user_id")


@query(f"WITH {_LOG} SELECT who AS user_id, d AS evidence_decision, count(*) AS n FROM log GROUP BY ALL")
def user_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.event_reviews(spark, sf_dir).groupBy("user_id", "evidence_decision").agg(F.count("*").alias("n"))


@query(f"WITH {_LOG} SELECT d AS evidence_decision, split_part(who, ':', 1) AS kind, meaningful, count(*) AS n FROM log GROUP BY ALL")
def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.event_reviews(spark, sf_dir).groupBy("evidence_decision", F.substring_index("user_id", ":", 1).alias("kind"), "meaningful").agg(F.count("*").alias("n"))


# Tags, boxes, viewpoints, numbers ------------------------------------------------------

_TAGS = "tagged AS (SELECT p_partkey, [p_type, p_brand] || string_split(p_name, ' ') AS tags FROM part)"


@query(f"WITH {_TAGS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY tag")
def tag_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_counts(fx.part_tags(spark, sf_dir))


@query(f"""WITH {_TAGS}, one AS (SELECT p_partkey, lower(unnest(tags)) AS t FROM tagged), sets AS (SELECT DISTINCT p_partkey, t FROM one)
SELECT p_partkey FROM sets GROUP BY p_partkey HAVING count(*) >= 4 AND count(*) FILTER (starts_with(t, 'brand#1')) > 0 AND count(*) FILTER (regexp_full_match(t, '(economy|standard [a-m]).*')) = 0""")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.part_tags(spark, sf_dir).where(tags.tag_filter(F.col("tags"), min_num=4, any_startswith="brand#1", none_match=["economy", "standard [a-m]"])).select("p_partkey")


ALIASES = [("^Brand#1", "first"), ("^Brand#", "brand"), ("^[A-Z ]+$", None)]


@query(f"WITH {_TAGS} SELECT p_partkey, array_to_string(list_sort(list_distinct(x)), ',') AS tags FROM (SELECT p_partkey, list_sort(list_filter(list_transform(tags, lambda t: CASE WHEN regexp_matches(t, '^Brand#1') THEN 'first' WHEN regexp_matches(t, '^Brand#') THEN 'brand' WHEN regexp_matches(t, '^[A-Z ]+$') THEN NULL ELSE t END), lambda t: t IS NOT NULL)) AS x FROM tagged)")
def tag_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.part_tags(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(tags.aliased(F.col("tags"), ALIASES)), ",").alias("tags"))


_VIEWS = ", ".join(f"'{v}'" for v in codes.VIEWS)
_DIST = ", ".join(f"('{a}', '{b}', {codes.view_distance(a, b)})" for a in codes.VIEWS for b in codes.VIEWS)


@query(f"WITH d(v1, v2, dist) AS (VALUES {_DIST}), p AS (SELECT p_partkey AS k, list_extract([{_VIEWS}], p_partkey % 27) AS v FROM part) SELECT a.k AS aid1, b.k AS aid2, coalesce(dist < 2, true) AS comparable FROM p a JOIN p b ON b.k = a.k + 1 LEFT JOIN d ON v1 = a.v AND v2 = b.v")
def view_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = F.element_at(F.array(*map(F.lit, codes.VIEWS)), F.nullif((F.col("p_partkey") % 27).cast("int"), F.lit(0)))
    parts = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("aid1"), view.alias("v1"))
    pairs = parts.join(parts.select((F.col("aid1") - 1).alias("aid1"), F.col("v1").alias("v2")), "aid1")
    known = pairs.join(F.broadcast(codes.view_table(spark)), ["v1", "v2"], "left")
    return known.select("aid1", (F.col("aid1") + 1).alias("aid2"), F.coalesce(F.col("dist") < 2, F.lit(True)).alias("comparable"))


_BOX = "box AS (SELECT p_partkey AS k, (p_partkey % 50)::DOUBLE AS x, p_size::DOUBLE AS y, (1 + p_partkey % 17)::DOUBLE AS w, (1 + p_size % 11)::DOUBLE AS h FROM part)"


@query(f"""WITH {_BOX}, i AS (SELECT a.k AS aid1, b.k AS aid2, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) + 1) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) + 1) AS i, (a.w + 1) * (a.h + 1) + (b.w + 1) * (b.h + 1) AS s FROM box a JOIN box b ON b.k = a.k + 1)
SELECT aid1, aid2, round(i / (s - i), 6) AS iou FROM i""")
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.part_boxes(spark, sf_dir).select(F.col("p_partkey").alias("aid1"), boxes.xywh_to_tlbr(F.col("box")).alias("a"))
    pairs = rows.join(rows.select((F.col("aid1") - 1).alias("aid1"), F.col("a").alias("b")), "aid1")
    return pairs.select("aid1", (F.col("aid1") + 1).alias("aid2"), F.round(boxes.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query(f"WITH {_BOX} SELECT k AS p_partkey, x + w / 2 AS cx, y + h / 2 AS cy, least(x + w, 40) AS x2, w * h AS area, x * 2 AS x_scaled FROM box")
def box_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    corner = boxes.clipped(boxes.xywh_to_tlbr(boxes.cxywh_to_xywh(boxes.xywh_to_cxywh(b))), 0, 0, 40, 1000)
    return fx.part_boxes(spark, sf_dir).select("p_partkey", boxes.centre(b)["x"].alias("cx"), boxes.xywh_to_cxywh(b)["cy"].alias("cy"), corner["x2"].alias("x2"), boxes.area(b).alias("area"), boxes.scaled(b, 2)["x"].alias("x_scaled"))


@query("""SELECT p_brand, round(avg(p_size), 6) AS mean, round(stddev_pop(p_size), 6) AS std, max(p_size)::DOUBLE AS max, min(p_size)::DOUBLE AS min, count(*) FILTER (p_size = mn) AS n_min, count(*) FILTER (p_size = mx) AS n_max, count(*) AS size, sum(p_size)::DOUBLE AS total, median(p_size)::DOUBLE AS median
FROM (SELECT *, min(p_size) OVER (PARTITION BY p_brand) AS mn, max(p_size) OVER (PARTITION BY p_brand) AS mx FROM part) GROUP BY p_brand""")
def stats_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.stats(fx.table(spark, sf_dir, "part"), "p_size", ["p_brand"], median=True)
    return rows.select("p_brand", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "max", "min", "n_min", "n_max", "size", "total", "median")


# Deltas and names ----------------------------------------------------------------------

_DELTA = """,
parts AS MATERIALIZED (SELECT name, nid, count(*) AS n FROM annots JOIN pcc USING (aid) GROUP BY name, nid),
marked AS MATERIALIZED (SELECT *, n = sum(n) OVER (PARTITION BY name) AS whole_old, n = sum(n) OVER (PARTITION BY nid) AS whole_new FROM parts),
kinds AS MATERIALIZED (SELECT name, nid, CASE WHEN whole_old AND whole_new THEN 'unchanged' WHEN bool_and(whole_old) OVER (PARTITION BY nid) THEN 'merge' WHEN bool_and(whole_new) OVER (PARTITION BY name) THEN 'split' ELSE 'hybrid' END AS kind FROM marked)"""


def _delta(spark, sf_dir):
    old = fx.order_annots(spark, sf_dir).select(F.col("aid").alias("item"), F.col("orig_name_label").alias("id"))
    return delta.grouping_delta(old, fx.order_pcc(spark, sf_dir).select(F.col("aid").alias("item"), F.col("nid").alias("id")))


@query(on_pcc("SELECT aid AS item, name AS old_id, nid AS new_id, kind FROM annots JOIN pcc USING (aid) JOIN kinds USING (name, nid)", _DELTA))
def grouping_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir)


@query(on_pcc("""SELECT a.name AS old_id, a.nid AS new1, b.nid AS new2 FROM kinds a JOIN kinds b ON a.name = b.name AND a.nid < b.nid WHERE a.kind IN ('split', 'hybrid') AND b.kind IN ('split', 'hybrid')
AND NOT EXISTS (SELECT 1 FROM labelled l WHERE l.nid1 = a.nid AND l.nid2 = b.nid AND decision IN ('NEGTV', 'INCMP'))""", _DELTA))
def unjustified_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.unjustified_splits(_delta(spark, sf_dir), fx.order_edges(spark, sf_dir).select("aid1", "aid2", "decision"))


def _halves_delta(spark, sf_dir):
    """What the later half of the log changes of the earlier one."""
    log = fx.event_reviews(spark, sf_dir)
    log = log.join(F.broadcast(log.agg(F.floor(F.avg("review_id")).alias("mid"))))
    return delta.edge_delta(*[graph.latest_reviews(log.where(x).drop("mid")) for x in ("review_id < mid", "review_id >= mid")])


@query(f"""WITH {_LOG}, mid AS (SELECT floor(avg(review_id)) AS c FROM log), l AS (SELECT aid1, aid2, review_id < c AS old, arg_max(d, review_id) AS d, arg_max(tag, review_id) AS tag FROM log, mid GROUP BY ALL)
SELECT n.aid1, n.aid2, n.d AS new_evidence_decision, o.d AS old_evidence_decision, n.tag AS new_tags, o.tag AS old_tags, o.d IS NULL AS is_new FROM (SELECT * FROM l WHERE NOT old) n LEFT JOIN (SELECT * FROM l WHERE old) o USING (aid1, aid2) WHERE o.d IS DISTINCT FROM n.d OR o.tag IS DISTINCT FROM n.tag""")
def edge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = [F.array_join(c, ",").alias(c) for c in ("new_tags", "old_tags")]
    return _halves_delta(spark, sf_dir).select("aid1", "aid2", "new_evidence_decision", "old_evidence_decision", *joined, "is_new")


def _named_pcc(spark, sf_dir):
    return fx.order_pcc(spark, sf_dir).join(_names(spark, sf_dir), "aid")


@query(on_pcc("""SELECT nid, name FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY n DESC, name) AS r FROM parts WHERE nid NOT IN (SELECT nid FROM parts WHERE name IN (SELECT name FROM parts GROUP BY name HAVING count(*) > 1))) WHERE r = 1""", _DELTA))
def name_mode_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rectify.trivial_names(_named_pcc(spark, sf_dir))


@query()
def name_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rectify.rectified_names(_named_pcc(spark, sf_dir))


@query(f"WITH RECURSIVE {_FX1}" + """,
sure AS MATERIALIZED (SELECT aid1, aid2 FROM edges WHERE decision = 'POSTV' AND confidence IN ('not_sure', 'pretty_sure', 'absolutely_sure')),
ways AS MATERIALIZED (FROM sure UNION ALL SELECT aid2, aid1 FROM sure),
reach(a, b) AS (SELECT aid, aid FROM annots UNION SELECT r.a, s.aid2 FROM reach r JOIN ways s ON r.b = s.aid1) SELECT a AS aid, min(b) AS nid FROM reach GROUP BY a""")
def confident_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(graph.confident(fx.order_edges(spark, sf_dir), POSTV, 2), nodes=fx.order_annots(spark, sf_dir))


_SURE = """,
sure AS MATERIALIZED (SELECT aid1, aid2 FROM edges WHERE decision = 'POSTV' AND confidence IN ('pretty_sure', 'absolutely_sure')),
ways AS MATERIALIZED (FROM sure UNION ALL SELECT aid2, aid1 FROM sure),
held_by(a, b) AS (SELECT aid, aid FROM annots UNION SELECT r.a, s.aid2 FROM held_by r JOIN ways s ON r.b = s.aid1),
tied AS MATERIALIZED (SELECT a AS aid, min(b) AS part FROM held_by GROUP BY a)"""
_DOUBTED = "SELECT aid1, aid2, decision, nid1, nid2, 1 - CASE decision WHEN 'POSTV' THEN p.POSTV WHEN 'NEGTV' THEN p.NEGTV ELSE p.INCMP END AS priority FROM labelled JOIN probs p USING (aid1, aid2) JOIN tied x ON x.aid = aid1 JOIN tied y ON y.aid = aid2 WHERE decision IN ('POSTV', 'NEGTV', 'INCMP') AND CASE WHEN nid1 = nid2 THEN x.part <> y.part ELSE NOT (decision = 'NEGTV' AND confidence IN ('pretty_sure', 'absolutely_sure')) END"


@query(on_pcc(f"SELECT aid1, aid2, round(priority, 6) AS priority FROM ({_DOUBTED})", _PROBS + _SURE))
def hard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided edges by how unlikely their decision is, without those that confident reviews have settled."""
    edges, pcc = _state(spark, sf_dir)
    doubts = priority.hardness(fx.order_probs(spark, sf_dir), edges)
    return priority.filtered(doubts, edges, pcc, "pretty_sure").select("aid1", "aid2", F.round("priority", 6).alias("priority"))


@query(on_pcc("""SELECT 'split' AS mode, aid1, aid2 FROM labelled WHERE decision = 'UNREV' AND nid1 = nid2 UNION ALL SELECT 'merge', aid1, aid2 FROM labelled WHERE decision = 'UNREV' AND nid1 <> nid2
UNION ALL SELECT 'predict', aid1, aid2 FROM labelled JOIN probs p USING (aid1, aid2) JOIN tied x ON x.aid = aid1 JOIN tied y ON y.aid = aid2
  WHERE decision = 'UNREV' AND CASE WHEN nid1 = nid2 THEN x.part <> y.part AND p.POSTV < 0.5 ELSE p.POSTV >= 0.5 END""", _PROBS + _SURE))
def queue_fix_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreviewed pairs that are left when only splits, only merges, or only surprises are looked for."""
    edges, pcc = _state(spark, sf_dir)
    open_ = priority.queue(edges, edges.limit(0), edges.limit(0))
    preds = fx.order_probs(spark, sf_dir).select("aid1", "aid2", F.when(F.col(POSTV) >= 0.5, POSTV).otherwise(NEGTV).alias("pred"))
    rows = [priority.filtered(open_, edges, pcc, mode=m, preds=preds if m == "predict" else None).select(F.lit(m).alias("mode"), "aid1", "aid2") for m in ("split", "merge", "predict")]
    return rows[0].union(rows[1]).union(rows[2])


@query(on_edges("SELECT aid1, aid2 FROM edges WHERE decision = 'NEGTV' AND confidence IN ('not_sure', 'pretty_sure', 'absolutely_sure')"))
def confident_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.confident(fx.order_edges(spark, sf_dir), NEGTV, 2).select("aid1", "aid2")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(regexp_replace(trim(text), '[ \\t\\n]+', ' ', 'g'))) AS nid FROM documents")
def doc_equal_text_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: equality of normalised texts, and nothing less, is a positive review; its components are the individuals."""
    key = F.sha2(F.lower(F.regexp_replace(F.trim("text"), "[ \\t\\n]+", " ")), 256)
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("nid"))
    return docs.join(first, "key").select("doc_id", "nid")


# Invariants and streams ----------------------------------------------------------------


def _damaged(spark, sf_dir):
    """The edges, some of them twice with other decisions, some the wrong way round, some with a decision that is none."""
    edges = fx.order_edges(spark, sf_dir).select("aid1", "aid2", "decision")
    other = edges.where("(aid1 + aid2) % 50 = 0").selectExpr("aid1", "aid2", "CASE decision WHEN 'POSTV' THEN 'NEGTV' ELSE 'POSTV' END AS decision")
    return edges.union(other).union(edges.where("(aid1 + aid2) % 70 = 1").select("aid2", "aid1", "decision")).union(edges.where("(aid1 + aid2) % 90 = 2").selectExpr("aid1", "aid2", "'MAYBE'"))


_DAMAGED = """damaged AS MATERIALIZED (SELECT aid1, aid2, decision FROM edges UNION ALL SELECT aid1, aid2, CASE decision WHEN 'POSTV' THEN 'NEGTV' ELSE 'POSTV' END FROM edges WHERE (aid1 + aid2) % 50 = 0
  UNION ALL SELECT aid2, aid1, decision FROM edges WHERE (aid1 + aid2) % 70 = 1 UNION ALL SELECT aid1, aid2, 'MAYBE' FROM edges WHERE (aid1 + aid2) % 90 = 2)"""


@query(on_edges("SELECT aid1, aid2, count(DISTINCT decision) AS n FROM damaged GROUP BY aid1, aid2 HAVING count(DISTINCT decision) > 1", f", {_DAMAGED}"))
def invariant_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.not_disjoint(_damaged(spark, sf_dir))


@query(on_edges("SELECT aid1, aid2, decision FROM damaged WHERE aid1 >= aid2 OR decision NOT IN ('POSTV', 'NEGTV', 'INCMP', 'UNKWN', 'UNREV')", f", {_DAMAGED}"))
def invariant_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bad_edges(_damaged(spark, sf_dir))


@query(on_pcc("""SELECT nid1, nid2, m.weight, k.weight AS kept FROM meta m FULL JOIN (SELECT nid1, nid2, weight + (nid1 % 21 = 1)::INT AS weight FROM meta WHERE nid1 % 20 <> 0 UNION ALL SELECT nid, nid, 1 FROM sizes WHERE n_nodes = 1 AND nid % 13 = 5) k USING (nid1, nid2)
WHERE m.weight IS DISTINCT FROM k.weight"""))
def invariant_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a metagraph that lost rows, miscounts some and has others too many differs from the edges."""
    edges, pcc = _state(spark, sf_dir)
    lone = pcc.groupBy("nid").agg(F.count("*").alias("n")).where("n = 1 AND nid % 13 = 5").selectExpr("nid AS nid1", "nid AS nid2", "1L AS weight")
    kept = graph.neg_metagraph(edges, pcc).where("nid1 % 20 <> 0").selectExpr("nid1", "nid2", "weight + IF(nid1 % 21 = 1, 1, 0) AS weight").union(lone)
    return metrics.meta_differences(edges, pcc, kept)


@query(on_pcc("""SELECT nid, CASE WHEN inside IS NULL THEN 'no suspect' WHEN NOT bad THEN 'consistent' ELSE 'suspect between' END AS what FROM (
  SELECT coalesce(b.nid, m.nid) AS nid, b.nid IS NOT NULL AS bad, inside FROM bad b FULL JOIN (SELECT nid1 AS nid, bool_and(nid1 = nid2) AS inside FROM labelled WHERE decision = 'NEGTV' AND (aid1 + aid2) % 4 = 0 GROUP BY nid1) m ON b.nid = m.nid)
WHERE inside IS NULL OR NOT bad OR NOT inside"""))
def invariant_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose suspected edges do not fit their consistency, where every fourth negative edge is suspected."""
    edges, pcc = _state(spark, sf_dir)
    return metrics.recovery_violations(edges, pcc, edges.where("decision = 'NEGTV' AND (aid1 + aid2) % 4 = 0"))


_replays: dict = {}


def _replay(spark, sf_dir, name, log, nodes, batches=3):
    """The state after a log came as a stream, made once for each application, folder and log."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _replays:
        _replays[key] = replay(spark, log.select("review_id", "aid1", "aid2", "evidence_decision", "meta_decision"), nodes, batches)
    return _replays[key]


def _replayed(spark, sf_dir):
    log = fx.event_reviews(spark, sf_dir)
    return _replay(spark, sf_dir, "events", log, log.select(F.explode(F.array("aid1", "aid2")).alias("aid")).distinct(), 2)


def _revised_orders(spark, sf_dir):
    """The order graph as a log in three parts: half of the edges, some with a decision that the third part takes back, then the others."""
    edges = fx.order_edges(spark, sf_dir).selectExpr("aid1", "aid2", "evidence_decision", "meta_decision", "(aid1 + aid2) % 2 AS half", "(aid1 + aid2) % 2 = 0 AND aid1 % 3 = 0 AND evidence_decision <> 'NEGTV' AS wrong")
    first = edges.selectExpr("half AS review_id", "aid1", "aid2", "CASE WHEN NOT wrong THEN evidence_decision WHEN evidence_decision = 'POSTV' THEN 'NEGTV' ELSE 'POSTV' END AS evidence_decision", "meta_decision")
    log = first.unionByName(edges.where("wrong").selectExpr("2L AS review_id", "aid1", "aid2", "evidence_decision", "meta_decision"))
    return _replay(spark, sf_dir, "orders", log, fx.order_annots(spark, sf_dir).select("aid"))


@query(ORACLES["latest_review"].replace("arg_max(who, review_id) AS user_id, ", ""))
def stream_latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).edges.select("aid1", "aid2", "review_id", "decision", "num_reviews")


@query(f"""WITH RECURSIVE {_LOG}, e AS MATERIALIZED (SELECT aid1, aid2, arg_max(d, review_id) AS d FROM log GROUP BY aid1, aid2), s AS MATERIALIZED (SELECT aid1 AS u, aid2 AS v FROM e WHERE d = 'POSTV' UNION ALL SELECT aid2, aid1 FROM e WHERE d = 'POSTV'),
reach(a, b) AS (SELECT x, x FROM (SELECT aid1 AS x FROM log UNION SELECT aid2 FROM log) UNION SELECT r.a, s.v FROM reach r JOIN s ON r.b = s.u) SELECT a AS aid, min(b) AS nid FROM reach GROUP BY a""")
def stream_pcc_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).pcc


@query(on_pcc("SELECT nid1, nid2, weight FROM meta"))
def stream_metagraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative meta edges that micro-batches kept up to date, through merges, splits and corrections."""
    return _revised_orders(spark, sf_dir).neg_metagraph


@query(on_pcc("SELECT nid FROM bad"))
def stream_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revised_orders(spark, sf_dir).inconsistent


@query(on_pcc(f"SELECT nid AS nid1, nid AS nid2 FROM ({_HELD}) WHERE pos_redun UNION ALL {_APART}", _BRIDGED))
def stream_redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that are redundant within (nid1 = nid2), and pairs that are between."""
    state = _revised_orders(spark, sf_dir)
    return state.pos_redundant.select(F.col("nid").alias("nid1"), F.col("nid").alias("nid2")).union(state.neg_redundant)


@query(on_pcc("SELECT aid, nid FROM pcc").replace("FROM raw)", "FROM raw WHERE (7 * aid1 + aid2) % 9 <> 0 OR decision <> 'POSTV')"))
def pcc_after_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components once some positive edges are taken back: only those whose forest loses an edge are searched again."""
    edges = fx.order_edges(spark, sf_dir).where("decision = 'POSTV'")
    log = edges.selectExpr("0L AS review_id", "aid1", "aid2", "evidence_decision", "meta_decision")
    cuts = edges.where("(7 * aid1 + aid2) % 9 = 0").selectExpr("1L AS review_id", "aid1", "aid2", "'UNREV' AS evidence_decision", "meta_decision")
    return _replay(spark, sf_dir, "cuts", log.unionByName(cuts), fx.order_annots(spark, sf_dir).select("aid"), 2).pcc


@query(on_pcc("SELECT i.aid1, i.aid2 FROM inner_edges i WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.e1 = i.aid1 AND w.e2 = i.aid2 AND w.x = i.aid2)", _BRIDGED.replace("IN (SELECT nid FROM summary WHERE n_nodes >= 3)", "IN (SELECT nid FROM sizes)")))
def bridge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive edges without which their component falls apart, by labels along a spanning forest."""
    return bridges.edge_labels(graph.edges_where(fx.order_edges(spark, sf_dir), "decision", "eq", POSTV), AT_ONCE).where("tree AND label = 0").select("aid1", "aid2")


# Searches, actions, stamps -------------------------------------------------------------


@query(on_pcc("""SELECT aid, min(step) AS step FROM walk GROUP BY aid""", """,
starts AS MATERIALIZED (SELECT min(aid) AS aid FROM annots GROUP BY name),
near AS MATERIALIZED (SELECT aid1 AS u, aid2 AS v FROM edges WHERE decision = 'NEGTV'),
walk(aid, step) AS (SELECT aid, 0 FROM starts UNION SELECT n.v, step + 1 FROM walk w JOIN near n ON n.u = w.aid)"""))
def bfs_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps over negative edges, from lesser to greater ends, from the first order of each customer."""
    starts = fx.order_annots(spark, sf_dir).groupBy("orig_name_label").agg(F.min("aid").alias("aid"))
    return search.reached(graph.edges_where(fx.order_edges(spark, sf_dir), "decision", "eq", NEGTV), starts, directed=True).select("aid", "step")


@query(on_edges("SELECT DISTINCT aid1 AS aid, 'source' AS kind FROM edges WHERE decision = 'POSTV' AND aid1 NOT IN (SELECT aid2 FROM edges WHERE decision = 'POSTV') UNION ALL SELECT DISTINCT aid2, 'sink' FROM edges WHERE decision = 'POSTV' AND aid2 NOT IN (SELECT aid1 FROM edges WHERE decision = 'POSTV')"))
def source_and_sink_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = fx.order_edges(spark, sf_dir).where(F.col("decision") == POSTV)
    return search.source_nodes(pos).withColumn("kind", F.lit("source")).union(search.sink_nodes(pos).withColumn("kind", F.lit("sink")))


@query()
def queue_after_pop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.not_locally_redundant(_queue(spark, sf_dir), *_labelled(spark, sf_dir))


@query(on_pcc("""SELECT aid1, aid2, decision, CASE WHEN x.name = y.name THEN 'within' ELSE 'between' END AS side,
  CASE WHEN x.name <> y.name AND nid1 = nid2 THEN 'merge' WHEN x.name = y.name AND nid1 <> nid2 THEN 'split' WHEN x.name = y.name AND decision = 'POSTV' THEN 'pos-evidence' WHEN decision = 'NEGTV' THEN 'neg-evidence' WHEN decision = 'INCMP' THEN 'incomp-evidence' ELSE 'other-evidence' END AS action
FROM labelled JOIN annots x ON x.aid = aid1 JOIN annots y ON y.aid = aid2"""))
def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviews did that turned names into components."""
    edges, pcc = _state(spark, sf_dir)
    names = fx.order_annots(spark, sf_dir).withColumnRenamed("orig_name_label", "nid")
    return actions.review_actions(names, pcc, edges.select("aid1", "aid2", "decision"))


@query("SELECT event_id, strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%y%m%d') AS tag, floor(epoch(ts))::BIGINT AS seconds FROM events")
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return fx.table(spark, sf_dir, "events").select("event_id", times.stamp(ts, "iso", 90).alias("iso"), times.stamp(ts, "tag").alias("tag"), times.stamp(ts, "int").alias("seconds"))


# Feedback, attributes of nodes, truth ---------------------------------------------------

_UNDONE = "undone AS MATERIALIZED (SELECT aid1, aid2, max(review_id) AS u FROM log WHERE d = 'UNREV' GROUP BY aid1, aid2)"


@query(f"WITH {_LOG}, {_UNDONE} SELECT review_id, aid1, aid2, d AS evidence_decision FROM log LEFT JOIN undone USING (aid1, aid2) WHERE u IS NULL OR review_id >= u")
def feedback_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.effective(fx.event_reviews(spark, sf_dir)).select("review_id", "aid1", "aid2", "evidence_decision")


@query(f"WITH {_LOG}, {_UNDONE} SELECT aid1, aid2, arg_max(d, review_id) AS decision, count(*) AS num_reviews, count(*) FILTER (u IS NULL OR review_id >= u) AS n_effective FROM log LEFT JOIN undone USING (aid1, aid2) GROUP BY aid1, aid2")
def feedback_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.current(fx.event_reviews(spark, sf_dir)).select("aid1", "aid2", "decision", "num_reviews", "n_effective")


@query(f"WITH {_LOG} SELECT review_id, coalesce(nullif(d, 'UNKWN'), 'UNREV') AS evidence_decision, 'null' AS meta_decision, 'unspecified' AS confidence FROM log")
def feedback_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose unknown decisions are taken away, and the defaults in place of all that is not given."""
    log = fx.event_reviews(spark, sf_dir).select("review_id", F.nullif(F.col("evidence_decision"), F.lit("UNKWN")).alias("evidence_decision"))
    return feedback.with_defaults(log)


@query(f"WITH {_LOG}, s AS (SELECT aid1, aid2, arg_max(d, review_id) AS d FROM log GROUP BY aid1, aid2), m AS (SELECT aid1, aid2, arg_max(d, review_id) AS d FROM log WHERE review_id % 3 <> 0 GROUP BY aid1, aid2) SELECT aid1, aid2 FROM s LEFT JOIN m USING (aid1, aid2) WHERE s.d IS DISTINCT FROM m.d")
def staging_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that a table of matches, made from two reviews of three, is behind on."""
    log = fx.event_reviews(spark, sf_dir)
    return feedback.staging_ahead(log, graph.latest_reviews(log.where("review_id % 3 <> 0")))


@query("SELECT o_orderkey + 1 AS aid, coalesce(b.o_orderstatus, 'none') AS status FROM orders a LEFT JOIN (SELECT o_orderkey AS k, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders) b ON b.k = a.o_orderkey + 1")
def node_attr_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("aid"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"))
    return graph.attributes(nodes.select((F.col("aid") + 1).alias("aid")), nodes, "status", on_missing="default", on_keyerr="default", default="none", keys=("aid",))


@query(on_edges("SELECT aid1, aid2, CASE WHEN (aid1 + aid2) % 7 = 0 THEN 'INCMP' WHEN x.name = y.name THEN 'POSTV' ELSE 'NEGTV' END AS truth FROM edges JOIN annots x ON aid1 = x.aid JOIN annots y ON aid2 = y.aid"))
def edge_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pairs are in truth: incomparable where their views say so, else by their names."""
    edges = fx.order_edges(spark, sf_dir).select("aid1", "aid2", ((F.col("aid1") + F.col("aid2")) % 7 != 0).alias("comparable"))
    return truth.match_state(edges, _names(spark, sf_dir), "comparable").select("aid1", "aid2", "truth")


@query(on_pcc("SELECT nid1, nid2, aid1, aid2, decision, n_pos, n_neg, n_incmp FROM labelled JOIN (SELECT nid1, nid2, count(*) FILTER (decision = 'POSTV') AS n_pos, count(*) FILTER (decision = 'NEGTV') AS n_neg, count(*) FILTER (decision = 'INCMP') AS n_incmp FROM labelled GROUP BY nid1, nid2) USING (nid1, nid2)"))
def pair_connection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, pcc = _state(spark, sf_dir)
    return graph.pair_connection_info(edges.select("aid1", "aid2"), edges, pcc)


@query(f"{_MANUAL} SELECT n, round(mu * 1000, 6) AS n_predicted FROM ({_MU})")
def refresh_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of 1000 reviews to come are foretold to change something."""
    return refresh.predicted(fx.event_reviews(spark, sf_dir), 1000).select("n", F.round("n_predicted", 6).alias("n_predicted"))


# Parts of the graph, tables of reviews, the queue ----------------------------------------


def _with_status(spark, sf_dir, status):
    return fx.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("aid"))


_STATUSES = ", st AS MATERIALIZED (SELECT o_orderkey AS aid, o_orderstatus AS s FROM orders), ends AS MATERIALIZED (SELECT e.*, x.s AS s1, y.s AS s2 FROM edges e JOIN st x ON x.aid = aid1 JOIN st y ON y.aid = aid2)"


@query(on_edges("SELECT aid1, aid2, decision FROM ends WHERE (s1 = 'F' AND s2 = 'O') OR (s1 = 'O' AND s2 = 'F')", _STATUSES))
def edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between fulfilled and open orders."""
    edges = fx.order_edges(spark, sf_dir)
    return graph.edges_between(edges, _with_status(spark, sf_dir, "F"), _with_status(spark, sf_dir, "O")).select("aid1", "aid2", "decision")


@query(on_edges("SELECT aid1, aid2, decision FROM ends WHERE s1 = 'F' AND s2 = 'F'", _STATUSES))
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the graph of fulfilled orders."""
    return graph.subgraph(fx.order_annots(spark, sf_dir), fx.order_edges(spark, sf_dir), _with_status(spark, sf_dir, "F"))[1].select("aid1", "aid2", "decision")


@query(on_edges("SELECT aid1, aid2, decision FROM ends WHERE s1 <> 'F' AND s2 <> 'F'", _STATUSES))
def removed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that are left when fulfilled orders go."""
    return graph.removed_nodes(fx.order_annots(spark, sf_dir), fx.order_edges(spark, sf_dir), _with_status(spark, sf_dir, "F"))[1].select("aid1", "aid2", "decision")


@query(on_pcc("SELECT p.aid, q.aid AS member FROM (SELECT min(aid) AS aid FROM annots GROUP BY name) a JOIN pcc p USING (aid) JOIN pcc q ON q.nid = p.nid"))
def members_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of the first order of each customer."""
    firsts = fx.order_annots(spark, sf_dir).groupBy("orig_name_label").agg(F.min("aid").alias("aid"))
    return graph.members_of(firsts, fx.order_pcc(spark, sf_dir))


@query(on_pcc("SELECT s.nid, coalesce(m, 0) * 2 = n_nodes * (n_nodes - 1) AS complete FROM sizes s LEFT JOIN (SELECT nid1 AS nid, count(*) AS m FROM labelled WHERE nid1 = nid2 GROUP BY nid1) USING (nid)"))
def complete_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.complete(*_state(spark, sf_dir))


@query(on_edges("SELECT q.aid1, q.aid2, e.aid1 IS NOT NULL AS there FROM (SELECT DISTINCT aid1, aid2 + 1 AS aid2 FROM edges) q LEFT JOIN edges e ON e.aid1 = q.aid1 AND e.aid2 = q.aid2"))
def has_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fx.order_edges(spark, sf_dir)
    return graph.present(edges.select("aid1", (F.col("aid2") + 1).alias("aid2")).distinct(), edges)


@query(on_edges("SELECT aid1, aid2, CASE WHEN decision = 'POSTV' AND prob_match > 0.5 THEN 'likely' ELSE confidence END AS confidence FROM edges"))
def updated_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fx.order_edges(spark, sf_dir)
    likely = edges.where("decision = 'POSTV' AND prob_match > 0.5").select("aid1", "aid2", F.lit("likely").alias("confidence"))
    return graph.updated(edges.select("aid1", "aid2", "confidence"), likely, ["aid1", "aid2"], ["confidence"])


@query(on_edges("SELECT aid1, aid2, confidence FROM edges WHERE decision <> 'UNREV'"))
def deleted_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences once those of unreviewed edges are deleted."""
    edges = fx.order_edges(spark, sf_dir)
    return graph.with_value(graph.without_attribute(edges, "confidence", edges.where(F.col("decision") == UNREV)), "confidence")


@query(on_edges("SELECT aid1, aid2, decision FROM edges UNION ALL SELECT a.aid, b.aid, 'UNREV' FROM annots a JOIN annots b ON a.name = b.name AND a.aid < b.aid LEFT JOIN edges e ON e.aid1 = a.aid AND e.aid2 = b.aid WHERE e.aid1 IS NULL"))
def ensured_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.ensure_cliques(_names(spark, sf_dir), fx.order_edges(spark, sf_dir)).select("aid1", "aid2", "decision")


_LINKS = "links AS MATERIALIZED (SELECT least(u, v) AS aid1, greatest(u, v) AS aid2 FROM (SELECT o.*, row_number() OVER (PARTITION BY f, p ORDER BY u, v) AS r FROM open_pairs o JOIN up USING (f, p)) WHERE r = 1)"


@query(f"WITH RECURSIVE {_FX1}{_FRAGMENTS}, {_LINKS} SELECT aid1, aid2, CASE WHEN l.aid1 IS NULL THEN decision ELSE 'POSTV' END AS decision, CASE WHEN l.aid1 IS NULL THEN confidence ELSE 'guessing' END AS confidence, coalesce(num_reviews, 0) + (l.aid1 IS NOT NULL)::INT AS num_reviews FROM edges e FULL JOIN links l USING (aid1, aid2)")
def ensured_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges once the links that would join each name's fragments are guessed to be the same."""
    return candidates.ensure_mst(_names(spark, sf_dir), fx.order_edges(spark, sf_dir)).select("aid1", "aid2", "decision", "confidence", "num_reviews")


@query(f"WITH RECURSIVE {_FX1}{_FRAGMENTS} SELECT name, count(DISTINCT c) AS n_parts FROM frs JOIN (SELECT f, min(g) AS c FROM tree GROUP BY f) USING (f) GROUP BY name")
def ensured_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many components each name's records are after `ensured_links`, by edges within names: one, unless all pairs of two parts are closed."""
    names = _names(spark, sf_dir)
    after = candidates.ensure_mst(names, fx.order_edges(spark, sf_dir)).where(F.col("decision") == POSTV)
    inner = after.join(names.toDF("aid1", "name"), "aid1").join(names.toDF("aid2", "name2"), "aid2").where("name = name2")
    return connected_components(inner, nodes=names, at_once=AT_ONCE).join(names, "aid").groupBy("name").agg(F.countDistinct("nid").alias("n_parts"))


@query(on_edges("SELECT aid1, aid2, CASE WHEN decision = 'UNREV' AND x.name = y.name THEN 'POSTV' ELSE decision END AS decision FROM edges JOIN annots x ON aid1 = x.aid JOIN annots y ON aid2 = y.aid UNION ALL SELECT a.aid, b.aid, 'POSTV' FROM annots a JOIN annots b ON a.name = b.name AND a.aid < b.aid LEFT JOIN edges e ON e.aid1 = a.aid AND e.aid2 = b.aid WHERE e.aid1 IS NULL"))
def ensured_same_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.ensure_cliques(_names(spark, sf_dir), fx.order_edges(spark, sf_dir), "same").select("aid1", "aid2", "decision")


@query(f"WITH {_LOG} SELECT review_id, aid1, aid2, d AS evidence_decision, who AS user_id, tag AS tags FROM log")
def staging_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review log, written as a staging table and read back."""
    log = tables.read_staging(tables.to_staging(feedback.with_defaults(fx.event_reviews(spark, sf_dir))))
    return log.select("review_id", "aid1", "aid2", "evidence_decision", "user_id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_LOG} SELECT aid1, aid2, min(review_id) AS review_id, arg_min(d, review_id) AS evidence_decision, coalesce(max(tag), '') AS tags FROM log GROUP BY aid1, aid2")
def undirected_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pair of a table of matches that has rows in either direction."""
    back = F.col("review_id") % 2 == 0
    log = fx.event_reviews(spark, sf_dir).select("review_id", F.when(back, F.col("aid2")).otherwise(F.col("aid1")).alias("aid1"), F.when(back, F.col("aid1")).otherwise(F.col("aid2")).alias("aid2"), "evidence_decision", "tags")
    return tables.undirected(log, "review_id").withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {_LOG} SELECT review_id, aid1, aid2 FROM log l WHERE who NOT LIKE 'algo%' OR NOT EXISTS (SELECT 1 FROM log i WHERE i.who NOT LIKE 'algo%' AND i.aid1 = l.aid1 AND i.aid2 = l.aid2)")
def all_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by people, and those by programs of the other edges."""
    log = fx.event_reviews(spark, sf_dir)
    by_program = F.col("user_id").startswith("algo")
    return tables.all_feedback(log.where(by_program), log.where(~by_program)).select("review_id", "aid1", "aid2")


@query("SELECT o_orderkey AS aid, o_custkey AS name_label FROM orders UNION ALL SELECT DISTINCT l_orderkey + 1, -l_orderkey - 1 FROM lineitem WHERE l_orderkey + 1 NOT IN (SELECT o_orderkey FROM orders)")
def added_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders, and new records beside them, each with a name of its own."""
    annots = fx.order_annots(spark, sf_dir).withColumn("name_label", F.col("orig_name_label")).select("aid", "name_label", "orig_name_label")
    return tables.with_annots(annots, fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("aid"))).select("aid", "name_label")


@query(on_pcc("SELECT aid, name AS old_name, nid AS new_name FROM annots JOIN pcc USING (aid) WHERE name <> nid"))
def name_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.name_delta(_names(spark, sf_dir), fx.order_pcc(spark, sf_dir).select("aid", F.col("nid").alias("name")))


_KNOWN = """,
known AS MATERIALIZED (SELECT p.aid, nid, CASE WHEN o_orderstatus <> 'O' THEN name END AS old FROM annots JOIN pcc p USING (aid) JOIN orders ON o_orderkey = p.aid)"""


@query(on_pcc("SELECT aid, old AS old_name, nid AS new_name FROM known WHERE old IS DISTINCT FROM nid AND nid IN (SELECT nid FROM known WHERE old IS NOT NULL)", _KNOWN))
def name_delta_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed names where those of open orders are unknown, but for components of open orders only."""
    status = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("aid"), F.col("o_orderstatus").alias("status"))
    old = _names(spark, sf_dir).join(status, "aid").select("aid", F.when(F.col("status") != "O", F.col("name")).alias("name"))
    return delta.name_delta(old, fx.order_pcc(spark, sf_dir).select("aid", F.col("nid").alias("name")), ignore_unknown=True)


_SIDED = "SELECT kind, 'old' AS side, old_id AS id, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT kind, 'new', new_id, count(*) FROM d GROUP BY ALL"


@query(f"WITH d AS ({ORACLES['grouping_delta']}) SELECT kind, side, count(*) AS n_groups, sum(n)::BIGINT AS n_items, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size FROM ({_SIDED}) GROUP BY kind, side")
def delta_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large the groups are that stayed, were split, merged or mixed."""
    return delta.delta_sizes(_delta(spark, sf_dir)).withColumn("mean_size", F.round("mean_size", 6))


_REDUNDANT = _BRIDGED + f""",
held AS MATERIALIZED ({_HELD}),
apart AS MATERIALIZED ({_APART}),
flags AS MATERIALIZED (SELECT l.*, coalesce(h.pos_redun, false) OR a.nid1 IS NOT NULL AS redundant FROM labelled l LEFT JOIN held h ON h.nid = l.nid1 AND l.nid1 = l.nid2 LEFT JOIN apart a ON a.nid1 = l.nid1 AND a.nid2 = l.nid2)"""
_OPEN = ", waiting AS MATERIALIZED (SELECT aid1, aid2, nid1, nid2, decision, confidence, num_reviews, prob_match AS priority FROM flags WHERE decision = 'UNREV' AND NOT redundant)"


def _flags(edges: DataFrame, pcc: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``of`` (default: all edges) with ``redundant``."""
    return redundancy.flagged(edges if of is None else of, pcc, redundancy.positive_redundancy(edges, pcc), redundancy.negative_redundancy(edges, pcc))


def _needless(edges: DataFrame, pcc: DataFrame) -> DataFrame:
    """The unreviewed edges that are redundant; of other edges the queue does not ask."""
    return _flags(edges, pcc, edges.where(F.col("decision") == UNREV)).where("redundant")


def _waiting(spark, sf_dir):
    edges, pcc = _labelled(spark, sf_dir)
    return priority.queue(edges, _needless(edges, pcc), edges.limit(0))


@query(on_pcc("SELECT aid1, aid2, redundant FROM flags", _REDUNDANT))
def redundant_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(*_state(spark, sf_dir)).select("aid1", "aid2", "redundant")


@query(on_pcc("SELECT aid1, aid2, priority FROM waiting WHERE nid1 <> nid2 OR nid1 NOT IN (SELECT nid FROM sizes WHERE n_nodes > 5)", _REDUNDANT + _OPEN))
def queue_without_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open queue without pairs inside components of more than five records."""
    pcc = fx.order_pcc(spark, sf_dir)
    return priority.without_internal(_waiting(spark, sf_dir), pcc, _large(pcc))


def _large(pcc):
    return pcc.groupBy("nid").agg(F.count("*").alias("n")).where("n > 5")


@query(on_pcc("SELECT aid1, aid2, priority FROM waiting UNION SELECT aid1, aid2, prob_match FROM labelled WHERE decision = 'UNREV' AND nid1 = nid2 AND nid1 IN (SELECT nid FROM sizes WHERE n_nodes > 5)", _REDUNDANT + _OPEN))
def queue_with_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open queue and all unreviewed pairs inside components of more than five records."""
    edges, pcc = _labelled(spark, sf_dir)
    return priority.with_internal(_waiting(spark, sf_dir), edges, pcc, _large(pcc))


@query(on_pcc("SELECT aid1, aid2, priority, nid1, nid2, decision, confidence, num_reviews, (SELECT count(*) FROM waiting) AS queue_len, (SELECT count(*) FROM sizes) AS n_ccs FROM waiting ORDER BY priority DESC, aid1, aid2 LIMIT 50", _REDUNDANT + _OPEN))
def review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviewers are asked first."""
    return priority.requests(_waiting(spark, sf_dir), *_state(spark, sf_dir), 50)


_CHANGES = "SELECT count(*) FILTER (is_new) AS n_added, count(*) FILTER (NOT is_new) AS n_modified, count(*) FILTER (NOT is_new AND t AND d) AS n_changed_decision_and_tags, count(*) FILTER (NOT is_new AND t AND NOT d) AS n_changed_tags, count(*) FILTER (NOT is_new AND d AND NOT t) AS n_changed_decision FROM (SELECT *, new_tags IS DISTINCT FROM old_tags AS t, new_evidence_decision IS DISTINCT FROM old_evidence_decision AS d FROM (" + ORACLES["edge_delta"] + "))"
_GROUPS = on_pcc("SELECT (SELECT count(*) FROM annots JOIN pcc USING (aid) WHERE name <> nid) AS n_names_changed, " + ", ".join(f"count(DISTINCT CASE WHEN kind = '{k}' THEN {'name' if c == 'old_id' else 'nid'} END) AS n_{k}" for k, c in delta.KINDS.items()) + " FROM kinds", _DELTA)


@query(f"SELECT * FROM ({_CHANGES}), ({_GROUPS})")
def delta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what the later half of the log changed, and what components changed of customers."""
    names = delta.name_delta(_names(spark, sf_dir), fx.order_pcc(spark, sf_dir).select("aid", F.col("nid").alias("name")))
    return delta.delta_counts(_halves_delta(spark, sf_dir), names, _delta(spark, sf_dir))


@query(f"WITH {_LOG}, {_RANKING} SELECT b.* FROM ({ORACLES['edge_best_score'].removeprefix(f'WITH {_RANKING} ')}) b LEFT JOIN (SELECT aid1, aid2, arg_max(d, review_id) AS d FROM log GROUP BY aid1, aid2) e USING (aid1, aid2) WHERE coalesce(d, 'UNREV') = 'UNREV'")
def unreviewed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near vectors whose pair the log has not decided on."""
    return priority.unreviewed_candidates(fx.embedding_ranking(spark, sf_dir), graph.latest_reviews(fx.event_reviews(spark, sf_dir)))
