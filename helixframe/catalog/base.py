"""What the query modules share: the register, the tables, and sequences derived from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
#: Sequences derived from documents: so many salted digests of 32 bases each.
SALTS = "abcdefgh"
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART = ["p_size", "p_retailprice"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx, sequence: 256 bases for each document id, the same in every engine."""
    salted = [F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(x))) for x in SALTS]
    bases = F.translate(F.concat(*salted), "0123456789abcdef", "ACGTACGTACGTACGT")
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_idx"), bases.alias("sequence"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_idx, sequence: bases of other kinds by the id modulo 8. Upper and lower case, 0 to 89 letters,
    ambiguous letters, RNA, gaps, 1,792 to 2,048 letters, and the document's own ASCII letters."""
    s, i = F.col("sequence"), F.col("seq_idx")
    kind = i % 8
    out = (
        F.when(kind == 1, F.lower(s)).when(kind == 2, F.substring(s, F.lit(1), (i % 90).cast("int"))).when(kind == 3, F.translate(s, "AC", "NR"))
        .when(kind == 4, F.translate(s, "T", "U")).when(kind == 5, F.concat(F.translate(s, "G", "-"), F.repeat(F.lit("-"), (i % 400).cast("int"))))
        .when(kind == 6, F.substring(F.repeat(s, 8), F.lit(1), F.lit(2048) - (i % 257).cast("int"))).when(kind == 7, F.coalesce(F.regexp_replace("text", "[^ -~]", ""), F.lit(""))).otherwise(s)
    )
    text = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_idx"), "text")
    salted = [F.md5(F.concat(i.cast("string"), F.lit(x))) for x in SALTS]
    bases = F.translate(F.concat(*salted), "0123456789abcdef", "ACGTACGTACGTACGT")
    return text.withColumn("sequence", bases).select("seq_idx", out.alias("sequence"))


def reference(s: DataFrame) -> DataFrame:
    return s.agg(F.min_by("sequence", "seq_idx").alias("reference"))


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)
