"""From raw documents to tokens: quality, line dedup, near copies, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on what the one before kept; all but the last return the
columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import bpe, crf, lines, postings, simhash
from sourceloom.llm.queries import QUALITY_THRESHOLD, digests, quality_model, table, vocabulary
from sourceloom.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model doesn't reject."""
    model = quality_model(spark, sf_dir, docs)
    return crf.with_quality(docs, model, name="_score").filter(F.col("_score") >= QUALITY_THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; n_chars follows the text."""
    rest = lines.dedup_lines(docs, removed="_removed")
    changed = F.when(F.col("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rest.withColumn("n_chars", changed).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (few differing bits, or a shingle similarity of 0.8): the one with the smallest id."""
    return simhash.keep_one(docs, similarity=simhash.SIMILARITY).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold too much of the benchmark."""
    return postings.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, as digests, with a round trip."""
    return digests(bpe.round_trip(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

# The classifier, the fingerprints and the encoding can't be said in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
