"""Uploads as a stream: new FASTA or FASTQ files are read, checked and stored once, bad records in a table of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe import constants as C
from helixframe.sources import readers

KINDS = ("fasta", "fastq")


def fault(rows: DataFrame, kind: str) -> Column:
    """Why a record is refused, or null: its form, no id, no letters, letters of no code, a quality of another length."""
    other = F.length(F.translate(F.upper("sequence"), C.IUPAC, "")) > 0
    out = F.when(F.col("well_formed") == F.lit(False), "malformed") if kind == "fastq" else F.when(F.lit(False), "")
    out = out.when(F.coalesce("id", F.lit("")) == "", "no id").when(F.coalesce("sequence", F.lit("")) == "", "no sequence").when(other, "letters of no code")
    return out.when(F.length("quality") != F.length("sequence"), "quality of another length") if kind == "fastq" else out


def store_batch(lines: DataFrame, batch: int, store: str, kind: str) -> None:
    """The batch's records under ``store``/records, refused ones under rejected, a row of counts under batches, each in the
    folder of the batch's number, which a repeated batch overwrites."""
    rows = readers.parsed_fastq(readers.numbered(lines)) if kind == "fastq" else readers.parsed_fasta(readers.fasta_records(lines))
    rows = rows.withColumn("fault", fault(rows, kind)).persist()
    try:
        write = lambda df, part: df.write.mode("overwrite").parquet(f"{store}/{part}/batch={batch}")
        write(rows.where("fault is null").drop("fault", "well_formed"), "records")
        write(rows.where("fault is not null").drop("well_formed"), "rejected")
        good = F.col("fault").isNull()
        write(rows.agg(F.count_if(good).alias("records"), F.count_if(~good).alias("rejected"), F.coalesce(F.sum(F.when(good, F.col("length"))), F.lit(0)).alias("letters")), "batches")
    finally:
        rows.unpersist()


def ingest(spark: SparkSession, folder: str, store: str, kind: str = "fasta", files: int = 100, endless: bool = False) -> StreamingQuery:
    """Start a stream of the files in ``folder``, ``files`` a batch at most; it ends when all are stored, or with ``endless`` waits for more.

    The stream's place is kept under ``store``/checkpoint. A stream that stops, by an error or by hand, goes on from there: a batch that
    was not finished comes again with the same files and number and overwrites what it had stored, so every record is stored once.
    Files must be whole when they appear in the folder. Empty files give no records.
    """
    if kind not in KINDS:
        raise ValueError(f"no stream of {kind}; there are {', '.join(KINDS)}")
    lines = readers.source_lines(spark.readStream.option("maxFilesPerTrigger", files), folder, "\n" if kind == "fastq" else readers.FASTA_SEPARATOR)
    writer = lines.writeStream.foreachBatch(lambda df, n: store_batch(df, n, store, kind)).option("checkpointLocation", f"{store}/checkpoint")
    return (writer if endless else writer.trigger(availableNow=True)).start()
