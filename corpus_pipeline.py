"""The corpus pipeline: toxicity, quality, line dedup, SimHash near-dedup, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. Where a filter learns from labels
it uses those of ``sf_dir`` on the training side of the id's hash, as the single queries do.

Every stage takes null and empty texts, texts of any length, repeated rows, rows without doc_id and columns of any name, and gives
no rows for an empty table. Null and empty texts are scored as texts without words by the filters, keep their rows in line dedup, are one group of
near-duplicates, and are packed as one id each. Repeated rows are judged alike; the near-duplicate stage keeps one of them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import line_dedup, packing, quality, simhash_dedup, toxicity
from helixframe.llm.common import id_remainder, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, "toxic", id_remainder(F.col("doc_id"), 5) != 0))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, quality.train(docs, labels, "quality", id_remainder(F.col("doc_id"), 3) != 1))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Trained models, hashes and tokenisers cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}-{name}")
        docs = spark.read.parquet(path)
    return docs
