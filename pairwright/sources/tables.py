"""Review tables: the append-only staging log, the table of last matches, and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.codes import CONFIDENCE, EVIDENCE, META, coded, decoded
from pairwright.operators import graph


def from_pairs(spark: SparkSession, pairs, schema: str = "aid1 long, aid2 long") -> DataFrame:
    """Edges from a list of pairs (with attributes, if the schema has more columns); a self edge is an error."""
    return graph.canonical(spark.createDataFrame(pairs, schema))


def with_annots(annots: DataFrame, aids: DataFrame) -> DataFrame:
    """``annots`` (aid, name_label, orig_name_label) and those of ``aids`` (aid, maybe name) not among them; the name of a new one is -aid."""
    name = F.coalesce("name", -F.col("aid")) if "name" in aids.columns else -F.col("aid")
    new = aids.select("aid", name.alias("name_label"), name.alias("orig_name_label")).dropDuplicates(["aid"])
    return annots.unionByName(new.join(annots, "aid", "left_anti"))


def read_staging(rows: DataFrame) -> DataFrame:
    """The review log of a staging table: codes from integers, tags split at semicolons, review_id in the order of the rows' ids."""
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ";"), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return rows.select(
        F.col("rowid").alias("review_id"), "aid1", "aid2", decoded(F.col("evidence_decision"), EVIDENCE, "UNREV").alias("evidence_decision"), decoded(F.col("meta_decision"), META, "null").alias("meta_decision"),
        F.col("user_identity").alias("user_id"), decoded(F.col("user_confidence"), CONFIDENCE, "unspecified").alias("confidence"), tags.alias("tags"),
    )


def to_staging(reviews: DataFrame) -> DataFrame:
    """Rows of a staging table from a review log."""
    return reviews.select(
        F.col("review_id").alias("rowid"), "aid1", "aid2", coded(F.col("evidence_decision"), EVIDENCE).alias("evidence_decision"), coded(F.col("meta_decision"), META).alias("meta_decision"), F.col("user_id").alias("user_identity"),
        coded(F.col("confidence"), CONFIDENCE).alias("user_confidence"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ";").alias("tags"),
    )


def append(rows: DataFrame, path: str, key: str = "rowid") -> None:
    """Append rows to a table; a key that is repeated or there already is an error."""
    spark = rows.sparkSession
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    try:
        there = spark.read.parquet(path).select(key)
        known = rows.join(there, key, "left_semi").limit(1).count()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = 0
    if twice or known:
        raise ValueError(f"keys of {path} must be new")
    rows.write.mode("append").parquet(path)


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those with their keys."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def undirected(matches: DataFrame, key: str = "rowid") -> DataFrame:
    """One row for each pair in either direction, lesser end first: values of the least key that has them, tags of all."""
    rest = [c for c in matches.columns if c not in ("aid1", "aid2", "tags")]
    rows = matches.withColumns({"aid1": F.least("aid1", "aid2"), "aid2": F.greatest("aid1", "aid2")})
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(c) for c in rest]
    tags = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags")] if "tags" in matches.columns else []
    return rows.groupBy("aid1", "aid2").agg(*first, *tags)


def all_feedback(external: DataFrame, internal: DataFrame) -> DataFrame:
    """Both logs; where an edge has reviews in both, those of the internal one."""
    return external.join(internal.select("aid1", "aid2").distinct(), ["aid1", "aid2"], "left_anti").unionByName(internal)


def all_items(external: DataFrame, internal: DataFrame) -> DataFrame:
    """Both logs, the external one first, with ``source``."""
    return external.withColumn("source", F.lit(0)).unionByName(internal.withColumn("source", F.lit(1)))


def next_ids(rows: DataFrame, known: DataFrame, column: str, order: str) -> DataFrame:
    """Rows with new ids beyond the greatest known one, by ``order`` within groups of a hash."""
    top = known.agg(F.coalesce(F.max(column), F.lit(0)).alias("_top"))
    groups = 1024
    rows = rows.withColumn("_g", F.pmod(F.xxhash64(order), F.lit(groups)))
    return rows.join(F.broadcast(top)).withColumn(column, F.col("_top") + F.row_number().over(Window.partitionBy("_g").orderBy(order)) * groups + F.col("_g")).drop("_g", "_top")
