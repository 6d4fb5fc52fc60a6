"""The registered query of each operator of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import (
    embedding_dedup,
    fingerprint,
    license_scan,
    license_sql,
    line_dedup,
    packing,
    quality,
    sentencepiece_codec,
    sharding,
    simhash_dedup,
    source_divergence,
    spelling_variants,
    toxicity,
    url_filter,
)
from helixframe.llm.common import id_remainder, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 3)
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", remainder != 1)
    return quality.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder == 1).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted")
    )


def op3_embedding_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return kept.select(
        "doc_id", F.length("text").cast("long").alias("kept_chars"), lines.cast("long").alias("kept_lines"), F.crc32(F.col("text").cast("binary")).alias("kept_crc32")
    )


def op7_martello_toth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash_dedup.to_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_toxicity_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", remainder != 0)
    return toxicity.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_pred").alias("predicted")
    )


def op11_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"), slips=True)


#: Rules of the registered query, by host and start of the path.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op12_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_sentencepiece, op2_quality_qda, op3_embedding_nn_descent, op4_imatch, op5_virtual_slots, op6_fuzzy_lines,
        op7_martello_toth, op8_license_rules, op9_simhash_anchors, op10_toxicity_gbt,
        op11_anagram_variants, op12_url_digests, op13_source_divergence,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_license_rules": license_sql.SCAN, "op12_url_digests": url_filter.oracle(URL_RULES), "op13_source_divergence": source_divergence.oracle(),
    }
