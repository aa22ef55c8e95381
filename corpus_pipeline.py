"""The corpus pipeline: each stage reads the documents that the one before kept.

Stages return the columns of ``documents`` (doc_id, text, lang, source,
n_chars); the last returns the mix.  ``run`` writes every stage to the shared
folder and reads it again, so no stage recomputes another.

Defined cases: every row is judged by its own text, whatever its doc_id, null
ids and repeated ids included; empty tables stay empty; columns beyond those of
``documents`` are not carried on.  Of a group of near duplicates the row with
the smallest doc_id stays, null last, then the one whose text hashes least.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.llm.decontaminate import remove_leaks
from lakeledger.llm.line_dedup import dedup_lines
from lakeledger.llm.mixing import mix_sources
from lakeledger.llm.near_dedup import near_duplicates
from lakeledger.llm.shared import heap_returned, stored, table, with_columns_of
from lakeledger.llm.toxicity import reject_toxic

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    return with_columns_of(docs, COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


@heap_returned
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return reject_toxic(with_columns_of(docs, COLUMNS), table(spark, sf_dir, "labels"))


@heap_returned
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents go, but for one of each."""
    carry = {"lang": "string", "source": "string"}
    out = dedup_lines(docs, carry=carry).withColumnRenamed("kept_text", "text").withColumn("n_chars", F.lit(0))
    return _documents(out)


@heap_returned
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    # a key of its own for each row, fixed by being written once
    rows = stored(with_columns_of(docs, COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "near-input")
    classes = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row")
    judged = stored(rows.select("_row", order.alias("order")).join(classes, "_row").groupBy("class_id").agg(F.min("order").alias("s")).select("s._row"), "near-kept")
    return rows.join(judged, "_row", "left_semi").select(*COLUMNS)


@heap_returned
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go; single hits are cut out of the text."""
    return _documents(remove_leaks(with_columns_of(docs, COLUMNS), table(spark, sf_dir, "benchmark")))


@heap_returned
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies and words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("decontamination", decontamination), ("mixing", mixing)]

#: the first and third stages learn and iterate, which SQL can't express; tests/llm/test_pipeline.py holds each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
