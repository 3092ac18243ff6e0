"""Review graphs and rankings derived from the driver's tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.codes import INCMP, NEGTV, POSTV, UNKWN, UNREV
from pairwright.operators.components import connected_components
from pairwright.operators.graph import with_labels
from pairwright.operators.nearest import nearest
from pairwright.session import growing, staged

CONFIDENCES = ("guessing", "not_sure", "pretty_sure", "absolutely_sure", "unspecified")
EVENT_DECISIONS = {"purchase": POSTV, "error": NEGTV, "view": INCMP, "signup": UNKWN, "click": UNREV}
_kept: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aid, orig_name_label): each order, named by its customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("aid"), F.col("o_custkey").alias("orig_name_label"))


def _order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    annots = order_annots(spark, sf_dir)
    w = Window.partitionBy("orig_name_label").orderBy("aid")
    lagged = annots.select(F.lag("aid", 1).over(w).alias("a"), F.lag("aid", 2).over(w).alias("b"), F.col("aid").alias("v"))
    near = lagged.where("a IS NOT NULL").selectExpr("a AS aid1", "v AS aid2", "pmod(7 * a + 13 * v, 20) AS h").selectExpr("aid1", "aid2", "CASE h WHEN 0 THEN 'INCMP' WHEN 1 THEN 'UNREV' WHEN 2 THEN 'UNKWN' ELSE 'POSTV' END AS evidence_decision")
    far = lagged.where("b IS NOT NULL").selectExpr("b AS aid1", "v AS aid2", "pmod(11 * b + 5 * v, 20) AS h").where("h < 15").selectExpr("aid1", "aid2", "CASE WHEN h < 10 THEN 'POSTV' WHEN h = 10 THEN 'NEGTV' WHEN h < 13 THEN 'INCMP' ELSE 'UNREV' END AS evidence_decision")
    # Dealt out once by what pairs are made on; names are looked up for the pairs, which are far fewer than the items.
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").repartition("l_partkey", "l_suppkey").distinct()
    one, two = items.toDF("p", "s", "aid1"), items.toDF("p", "s", "aid2")
    names1, names2 = annots.toDF("aid1", "name1"), annots.toDF("aid2", "name2")
    pairs = one.join(two, ["p", "s"]).where("aid1 < aid2").join(names1, "aid1").join(names2, "aid2").where("name1 <> name2").select("aid1", "aid2").distinct()
    cross = pairs.selectExpr("aid1", "aid2", "3 * aid1 + 7 * aid2 AS h").selectExpr("aid1", "aid2", "CASE WHEN h % 200 = 0 THEN 'POSTV' WHEN h % 10 < 6 THEN 'NEGTV' WHEN h % 10 < 8 THEN 'INCMP' ELSE 'UNREV' END AS evidence_decision")
    names = ", ".join(f"'{c}'" for c in CONFIDENCES)
    return near.union(far).union(cross).selectExpr(
        "aid1", "aid2", "evidence_decision", "'null' AS meta_decision", f"element_at(array({names}), cast((aid1 + aid2) % 5 AS int) + 1) AS confidence", "1 + (aid1 * aid2) % 3 AS num_reviews", "((31 * aid1 + 17 * aid2) % 1000) / 1000D AS prob_match"
    )


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """``make()`` staged once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = staged(make(), name)
    return _kept[key]


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the order graph with decision, confidence, num_reviews and prob_match."""
    return kept(spark, sf_dir, "order-edges", lambda: _order_edges(spark, sf_dir).withColumn("decision", F.col("evidence_decision")))


def order_pcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aid, nid): positive components of the order graph."""
    edges = order_edges(spark, sf_dir)
    return kept(spark, sf_dir, "order-pcc", lambda: connected_components(edges.where(F.col("decision") == POSTV), nodes=order_annots(spark, sf_dir)))


def order_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the order graph with the components of their ends, looked up once for all steps of a query."""
    edges = order_edges(spark, sf_dir).select("aid1", "aid2", "decision", "confidence", "num_reviews", "prob_match")
    return growing(kept(spark, sf_dir, "order-labelled", lambda: with_labels(edges, growing(order_pcc(spark, sf_dir)))))


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review log of the events: one review for each event between a user and the number in its props."""
    decision = F.create_map(*[F.lit(x) for pair in EVENT_DECISIONS.items() for x in pair])
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).where("user_id <> k")
    return events.select(
        F.col("event_id").alias("review_id"), F.least("user_id", "k").alias("aid1"), F.greatest("user_id", "k").alias("aid2"), decision[F.col("event_type")].alias("evidence_decision"), F.lit("null").alias("meta_decision"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN 'algo:x' ELSE 'user:' || user_id % 7 END").alias("user_id"), (F.col("event_id") % 11 == 0).alias("meaningful"), F.col("ts").alias("timestamp"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN array('dark') ELSE array() END").cast("array<string>").alias("tags"),
    )


def embedding_ranking(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """(qaid, daid, score, rank): for the vectors whose id 100 divides, a stated set, the k nearest of all by rounded cosine, ties by id."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"))
    return nearest(vectors.where("id % 100 = 0"), vectors, k)


def label_probs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Verifier: POSTV, NEGTV and INCMP of pairs by integer hash of ids and equality of labels, with truth."""
    one, two = labels.select(F.col("aid").alias("aid1"), F.col("label").alias("l1")), labels.select(F.col("aid").alias("aid2"), F.col("label").alias("l2"))
    rows = pairs.join(one, "aid1").join(two, "aid2").withColumn("h", (31 * F.col("aid1") + 17 * F.col("aid2")))
    rows = rows.withColumn("truth", F.when(F.col("l1") == F.col("l2"), POSTV).otherwise(NEGTV))
    rows = rows.withColumn("p", F.when(F.col("l1") == F.col("l2"), F.lit(0.6) + (F.col("h") % 400) / 1000).otherwise((F.col("h") % 500) / 1000))
    rows = rows.withColumn("n", (1 - F.col("p")) * ((7 * F.col("aid1") + 3 * F.col("aid2")) % 100) / 100)
    return rows.select("aid1", "aid2", "truth", F.round("p", 6).alias(POSTV), F.round("n", 6).alias(NEGTV), F.round(1 - F.col("p") - F.col("n"), 6).alias(INCMP))


def order_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verifier's classes for all edges of the order graph, whose truth is equality of customers."""
    labels = order_annots(spark, sf_dir).select("aid", F.col("orig_name_label").alias("label"))
    return kept(spark, sf_dir, "probs", lambda: label_probs(order_edges(spark, sf_dir).select("aid1", "aid2"), labels))


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, tags): type, brand and the words of the name."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.array("p_type", "p_brand"), F.split("p_name", " ")).alias("tags"))


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "named_struct('x', double(p_partkey % 50), 'y', double(p_size), 'w', double(1 + p_partkey % 17), 'h', double(1 + p_size % 11)) AS box")
