"""A corpus pipeline of five stages, each applying one operator to what the stage before kept.

Quality rules, language identification and the n-gram Jaccard join drop rows; personal data
is masked in place; best-fit packing gives the place of every piece of what is left.

Every stage takes any extra columns along (but for the last, which returns places), gives no rows for an empty table,
treats repeated rows one by one unless it says otherwise, and works on whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwright.llm import language_id, pii
from pairwright.llm.jaccard_join import keep_one_of_each
from pairwright.llm.packing import pack
from pairwright.llm.quality import quality_filter
from pairwright.session import shipped, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the fertility bands; null and empty texts have no words and go."""
    return quality_filter(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows mostly in one language that the labelled rows among them teach; without any, all rows stay.

    Null texts and those without letters go. A table without ``lang``, or with nulls only, teaches nothing.
    """
    model = language_id.train(docs)
    return language_id.language_filter(docs, model) if model.languages else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id.

    Rows that share an id are one document. Texts without words have no near copies and stay.
    """
    return keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced by its kind, and n_chars (if integers) of changed texts set anew; null texts stay."""
    return pii.mask_personal_data(docs, pii.train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens; a null text is empty, and a row of its own."""
    return pack(docs)


def _on_executors(stage):
    """The stage, once the executors have the package."""
    return lambda spark, docs, sf_dir: stage(shipped(spark), docs, sf_dir)


STAGES = [(name, _on_executors(f)) for name, f in (("quality rules", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("best-fit packing", packing))]

#: SQL can express neither the vocabulary nor what the models learn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
