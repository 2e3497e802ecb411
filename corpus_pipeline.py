"""Corpus pipeline: quality, near duplicates, benchmark passages, personal data, pieces.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; all but the last return the columns
of ``documents``. No stage can be expressed in SQL as a whole (trained models), so ORACLE_SQL is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegraph.llm import classify, decontaminate, neardup, pieces, pii
from tastegraph.llm.frames import bucket, checkpointed, held, released, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.3 at least).

    A null text is judged like an empty one; rows are judged one by one, so repeated rows stay together; rows without an id are judged but not learnt from."""
    model = classify.fit(docs, table(spark, sf_dir, "labels"), classify.QUALITY, bucket("doc_id", 5) != 0)
    return released(classify.score(held(docs, "text"), model, classify.QUALITY).where("score >= 0.3"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): the least id.

    Rows of one id are one document only if their texts are equal (or all without words) or in one group: the text with the least hash keeps the id,
    others get one above all ids, from id and text. A null id stands for the text's hash below zero, so that documents without an id take part.
    Of equal rows one stays (the first by text); null, empty and white texts are linked with nothing."""
    own = F.coalesce(F.col("row.doc_id").cast("long"), -1 - F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 62)))
    rows = neardup.apart(held(docs, "text").withColumn("doc_id", own))
    found = neardup.groups(rows, n=5, percent=80, id_column="node", versions=False).where("kept").select(F.col("doc_id").alias("node")).distinct()
    first = F.row_number().over(Window.partitionBy("node").orderBy("text"))
    return released(rows.join(found, "node", "left_semi").withColumn("place", first).where("place = 1"), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window: those that hold 13 words of an item one after another go, whatever their length, and so do those of which a
    twentieth or more is short items. (Single words of short items in a long document are no passage.)

    Null and empty texts have no words and stay; without a benchmark everything stays."""
    found = decontaminate.find(held(docs, "text"), table(spark, sf_dir, "benchmark"))
    return released(found.where(~F.col("whole_window") & ~decontaminate.contaminated()), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets (n_chars, if it is there, follows the new text). Null texts stay null."""
    length = F.length("text").cast("long")
    return released(pii.annotate(held(docs, "text"), redact=True), docs, text=F.col("text"), n_chars=length)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, round_trip of every row; null and empty texts have no ids."""
    return pieces.encode(docs.select("doc_id", "text")).select("doc_id", "ids", "n_ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("personal_data", personal_data),
    ("pieces", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the checkpoint folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else checkpointed(docs)
    return docs
