"""From raw documents to packed training sequences, stage by stage; each stage's rows are written before the next reads them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from weekgrid.llm import jaccard, lines, packing, pii, quality
from weekgrid.llm.common import filled, table, unused
from weekgrid.llm.queries import PATTERN
from weekgrid.session import shared_dir, stored

#: Documents whose score is lower are rejected.
THRESHOLD = 0.3


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` with another text, and its length where there is a column for it."""
    changed = {"text": text}
    return docs.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on all labels, does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score_column(spark, model, F.col("text")) >= THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line stays only in the first document that holds it."""
    return _measured(lines.dedup_lines(docs).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the least id; null ids come last.

    Links are SimHash's (operator 1), checked exactly (Jaccard similarity 0.8 of five-word shingles) and completed to all pairs of that similarity.
    """
    found = stored(jaccard.similar_documents(docs))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("one")
    doc, digest, place = (unused(docs, name) for name in ("kept_id", "kept_hash", "place"))
    kept = found.groupBy("component").agg(one).select(F.col("one.doc_id").alias(doc), F.col("one.text_hash").alias(digest)).distinct()
    hashed = F.xxhash64(F.col("text").cast("string"))
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (hashed == F.col(digest)), "left_semi")
    if found.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return rows
    # Of rows that share id and text, one.
    same = Window.partitionBy("doc_id", hashed).orderBy(hashed)
    return rows.withColumn(place, F.row_number().over(same)).filter(F.col(place) == 1).drop(place)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    text = filled("text")
    return _measured(_with_text(docs, pii.masked(text, pii.spans_column(text, pii.train(docs)))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(packing.document_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN))


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mask_personal_data", mask_personal_data),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

