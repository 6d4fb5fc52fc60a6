"""Readers for FASTA, FASTQ and delimited files; all reading and parsing is done by Spark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from helixframe import constants as C
from helixframe.functions.sequence import client_type, header_label
from helixframe.operators.validation import type_validation

# The extensions and the size that an upload may have.
ALLOWED = ("csv", "txt", "fasta", "fa", "fas", "fastq", "fq", "json", "xlsx", "tsv", "gbk", "gff")
MOST_BYTES = 500 * 1024 * 1024
#: What stands between two FASTA records.
FASTA_SEPARATOR = "\n>"


def source_lines(reader: DataFrameReader | DataStreamReader, path: str, separator: str) -> DataFrame:
    """value, file, block (where its split begins) of the texts between separators, from a reader of tables or of streams."""
    rows = reader.option("lineSep", separator).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def fasta_records(lines: DataFrame) -> DataFrame:
    """file, lines of each record, its header first, from ``source_lines`` of whole files cut at a line that starts with ">".

    Records are split by the reader itself, so a large file is read in parallel; text before the first header of a
    file is dropped. One row a file is joined, to records where they lie: dealt by file, all of a file would be sorted in one task."""
    records = lines.withColumn("at", F.monotonically_increasing_id())
    # A record after the first of its file lost its ">" to the separator; the first one still has it, or is a preamble.
    starts = records.where("block = 0").groupBy("file").agg(F.min("at").alias("start"))
    records = records.join(F.broadcast(starts), "file", "left")
    value = F.when(F.col("value").startswith(">"), F.expr("substring(value, 2)")).when(F.col("at") == F.col("start"), F.lit(None)).otherwise(F.col("value"))
    rows = records.select("file", value.alias("value")).where("value is not null and trim(value) <> ''")
    return rows.select("file", F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))


def fasta(spark: SparkSession, path: str, comments: str = "skip") -> DataFrame:
    """id, description, sequence, length, label of each record; lines are joined.

    Text before the first header is dropped; lines that start with # are skipped, or kept as part of the
    sequence with ``comments='keep'``.
    """
    out = parsed_fasta(fasta_records(source_lines(spark.read, path, FASTA_SEPARATOR)), comments)
    return out.select("id", "description", "sequence", "length", "label").where("id <> ''")


def parsed_fasta(rows: DataFrame, comments: str = "skip") -> DataFrame:
    """file, id, description, sequence, length, label of ``fasta_records``; an id may be empty."""
    header = F.trim(F.col("lines")[0])
    keep = F.filter(F.expr("slice(lines, 2, size(lines))"), lambda x: ~x.startswith("#") | F.lit(comments == "keep"))
    sequence = F.regexp_replace(F.array_join(keep, ""), r"\s", "")
    out = rows.select("file", F.substring_index(header, " ", 1).alias("id"), header.alias("description"), sequence.alias("sequence"))
    return out.withColumn("length", F.length("sequence")).withColumn("label", header_label(F.col("description")))


def client_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence, length, type: letters of the nucleotide codes only, in upper case; empty records are dropped."""
    rows = fasta(spark, path, comments="keep")
    s = F.upper(F.regexp_replace("sequence", "(?i)[^ATCGURYNWSMKBDHV]", ""))
    return rows.select("id", s.alias("sequence")).where("sequence <> ''").select("id", "sequence", F.length("sequence").alias("length"), client_type(F.col("sequence")).alias("type"))


def clean_fasta(records: DataFrame, kind: str = "dna") -> DataFrame:
    """Upper case, letters of the alphabet only, empty records and repeated rows dropped."""
    alphabet = {"dna": C.DNA, "rna": C.RNA, "protein": C.AMINO}[kind]
    s = F.regexp_replace(F.upper("sequence"), f"[^{alphabet}]", "")
    return records.withColumn("sequence", s).withColumn("length", F.length("sequence")).where("length > 0").dropDuplicates()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of each line of text files, ``line`` counting from 0 in its file.

    Files are read in splits: the lines of each are counted, and a split starts after those before it."""
    return numbered(source_lines(spark.read, path, "\n"))


def numbered(lines: DataFrame) -> DataFrame:
    """``numbered_lines`` of ``source_lines`` of whole files."""
    rows = lines.select("file", "block", F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r", "").alias("value"))
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("shift"))
    return rows.join(F.broadcast(splits), ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """id, sequence, quality, length and mean phred of each read, from files of four-line records."""
    return parsed_fastq(numbered_lines(spark, path)).where("well_formed").drop("file", "well_formed")


def parsed_fastq(lines: DataFrame) -> DataFrame:
    """file, id, sequence, quality, length, mean_quality of numbered lines, and whether a record has its signs and three lines at least."""
    place = F.pmod("line", F.lit(4))
    part = lambda k: F.max(F.when(place == k, F.col("value")))
    records = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record"))
    rows = records.agg(*[part(k).alias(f"l{k}") for k in range(4)])
    rows = rows.select(
        "file", F.expr("substring(l0, 2)").alias("id"), F.col("l1").alias("sequence"), F.coalesce("l3", F.lit("")).alias("quality"), F.expr("coalesce(l0 like '@%' and l2 is not null, false)").alias("well_formed")
    )
    total = F.expr("aggregate(filter(split(quality, ''), c -> c <> ''), 0, (a, c) -> a + ascii(c) - 33)")
    return rows.withColumn("length", F.length("sequence")).withColumn("mean_quality", total / F.greatest(F.length("quality"), F.lit(1)))


def delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """CSV or TSV with a header; without ``separator`` a tab in the first line decides."""
    if separator is None:
        head = spark.read.text(path).limit(1).collect()
        separator = "\t" if head and "\t" in head[0]["value"] else ","
    return spark.read.csv(path, sep=separator, header=True, inferSchema=True)


def sample(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """At most ``rows`` rows of a delimited file, for previews and statistics that ask for a sample."""
    return delimited(spark, path).limit(rows)


def safe(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame | None:
    """A sample of a delimited file, or None where there is no such file or it has no columns; other errors show."""
    try:
        return sample(spark, path, rows)
    except AnalysisException:
        return None


def sequence_lengths(df: DataFrame) -> DataFrame:
    """Lengths of the first column whose name holds ``seq`` and that is text."""
    names = [c for c, kind in df.dtypes if "seq" in c.lower() and kind == "string"]
    if not names:
        raise ValueError("no column of sequences")
    n = F.length(names[0])
    return df.where(F.col(names[0]).isNotNull()).agg(F.count("*").alias("rows"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("avg")).withColumn("column", F.lit(names[0]))


def text_input(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each line of ``text`` that is not blank, as ``sequence``."""
    return df.select(*keep, F.explode(F.split("text", "\n")).alias("sequence")).where(F.trim("sequence") != "")


def json_payload(spark: SparkSession, path: str) -> DataFrame:
    """seq_idx, sequence of the field ``sequences`` of JSON bodies."""
    bodies = spark.read.schema("sequences array<string>").json(path)
    return bodies.select(F.explode("sequences").alias("sequence")).select(F.monotonically_increasing_id().alias("seq_idx"), "sequence")


SEQUENCE_KINDS = ("dna", "rna", "protein")


def read(spark: SparkSession, path: str, kind: str = "general", name: str | None = None) -> DataFrame:
    """Reader by the extension of ``name`` (or the path) and the kind of dataset; other extensions raise an error.

    A delimited file of a kind of sequences has to have a text column named after them.
    """
    end = (name or path).rstrip("/").rpartition(".")[2].lower()
    if end in ("fasta", "fa", "fas"):
        return fasta(spark, path)
    if end in ("fastq", "fq"):
        return fastq(spark, path)
    if end in ("csv", "tsv", "txt"):
        out = delimited(spark, path)
        if kind in SEQUENCE_KINDS and not any("seq" in c.lower() for c in out.columns):
            raise ValueError("no column of sequences")
        return out
    raise ValueError(f"no reader for .{end}")


def ingest(spark: SparkSession, path: str, store: str, kind: str, name: str, size: int) -> DataFrame:
    """Check an upload, read and validate it, store it as Parquet under ``store``; its row of metadata.

    Uploads of a wrong extension, size or without records raise an error.
    """
    wrong = validate_upload(name, size)
    if wrong:
        raise ValueError("; ".join(wrong))
    rows = read(spark, path, kind, name)
    if "sequence" not in rows.columns:
        rows.write.parquet(store)
        return spark.read.parquet(store).agg(F.count("*").alias("rows")).withColumn("status", F.lit("valid"))
    rows.withColumn("seq_idx", F.monotonically_increasing_id()).write.parquet(store)
    kept = spark.read.parquet(store)
    checked = type_validation(kept, kind)
    return kept.agg(F.count("*").alias("rows"), F.sum("length").alias("total_length")).crossJoin(checked).withColumn("stored", F.lit(store))


def validate_upload(name: str, size: int) -> list[str]:
    """What is wrong with an upload: its extension or its size; nothing if it is fine."""
    found = [] if name.rpartition(".")[2].lower() in ALLOWED else [f"extension of {name} is not allowed"]
    return found + ([f"{size} bytes are over the limit"] if size > MOST_BYTES else [])
