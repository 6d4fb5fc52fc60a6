"""Converters and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import count_of
from helixframe.operators.scans import kmer_frequencies, kmers, known_kmers, word_counts


def fasta_features(records: DataFrame, k: int = 3, vocabulary: list[str] | None = None) -> DataFrame:
    """id, label, length, percentages of letters and one kmer_ column for each word of the vocabulary, null where a record lacks it.

    Without a vocabulary the observed k-mers are taken: at most 4^k columns. A record's words are counted where it lies.
    """
    n = F.greatest(F.length("sequence"), F.lit(1))
    s = F.upper("sequence")
    base = records.select("id", "label", F.length("sequence").alias("length"), (count_of(s, "GC") * 100 / n).alias("gc_content"),
                       *[(count_of(s, x) * 100 / n).alias(f"{x.lower()}_content") for x in "ATCGN"], known_kmers(k).alias("__found"))
    if vocabulary is None:
        vocabulary = sorted(r["kmer"] for r in kmers(records.select("sequence"), k).distinct().collect())
    found = F.col("__found")
    shares = [F.when(n > 0, n / F.size(found)).alias(f"kmer_{w}") for w, n in zip(vocabulary, word_counts(found, vocabulary))]
    return base.select("*", *shares).drop("__found")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def dense_kmer_table(seqs: DataFrame, k: int = 3, first: int | None = None) -> DataFrame:
    """id, length and a kmer_ column for every observed word, 0 where a sequence lacks it; of the first sequences only if asked."""
    rows = seqs if first is None else seqs.where(F.col("seq_idx") < first)
    wide = kmer_frequencies(rows, k).groupBy("seq_idx").pivot("kmer").agg(F.first("freq"))
    words = [c for c in wide.columns if c != "seq_idx"]
    joined = rows.select("seq_idx", F.length("sequence").alias("length")).join(wide, "seq_idx", "left")
    return joined.select(F.col("seq_idx").alias("id"), "length", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"kmer_{c}") for c in words])


def save_prepared(df: DataFrame, folder: str, source: str, stamp: str = "latest") -> str:
    """Write a prepared table as CSV to a folder named after its source; the path."""
    path = f"{folder}/{source.rpartition('.')[0] or source}_preprocessed_{stamp}"
    df.write.csv(path, header=True)
    return path


def save_model(model, path: str) -> str:
    """Store a fitted Spark ML pipeline; read it with ``PipelineModel.load``."""
    model.write().overwrite().save(path)
    return path


def save_metrics(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def config_text(config: dict, kind: str = "json") -> str:
    """A model's configuration as JSON or YAML."""
    import json

    if kind == "json":
        return json.dumps(config, indent=2, sort_keys=True)
    import yaml

    return yaml.safe_dump(config, sort_keys=True)


def config_from(text: str, kind: str = "json") -> dict:
    import json

    if kind == "json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)
