"""Streams of uploads that stop and start again, and row-wise operators on streams."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.sources import readers
from helixframe.streaming import ingest as stream
from helixframe.streaming.stateless import stream_operator


def stored(spark, store, part):
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{store}/{part}")


def test_every_record_is_stored_once_over_stops_and_starts(spark, tmp_path, monkeypatch):
    """Files in batches of two; a batch that fails after it has stored its records, and one that fails before; more files later; old files do not come again."""
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    rng, want = random.Random(2), {}
    for f in range(5):
        text = "junk before\n" if f == 1 else ""
        for k in range(rng.randint(1, 9)):
            want[f"s{f}_{k}"] = s = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 300)))
            text += f">s{f}_{k} a name\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n# note\n"
        (folder / f"{f}.fa").write_text(text + (">empty\n" if f == 2 else ">odd\nAC?T\n" if f == 3 else "> \nACGT\n" if f == 4 else ""))
    whole, calls = stream.store_batch, []

    def breaks(df, n, *rest):
        calls.append(n)
        if len(calls) == 1:
            whole(df, n, *rest)
            raise RuntimeError("after storing")
        if len(calls) == 3:
            raise RuntimeError("before storing")
        whole(df, n, *rest)

    monkeypatch.setattr(stream, "store_batch", breaks)
    for last in (False, False, True):
        query = stream.ingest(spark, str(folder), store, files=2)
        if last:
            assert query.awaitTermination(120) and query.exception() is None
        else:
            with pytest.raises(StreamingQueryException):
                query.awaitTermination(120)
    assert calls == [0, 0, 1, 1, 2]
    (folder / "late.fasta").write_text(">late\nACGT")
    want["late"] = "ACGT"
    assert stream.ingest(spark, str(folder), store, files=2).awaitTermination(120) and calls[5:] == [3]
    got = stored(spark, store, "records").collect()
    assert len(got) == len(want) and {r["id"]: r["sequence"] for r in got} == want
    assert sorted((r["id"], r["fault"]) for r in stored(spark, store, "rejected").collect()) == [("", "no id"), ("empty", "no sequence"), ("odd", "letters of no code")]
    told = stored(spark, store, "batches").agg(F.sum("records"), F.sum("rejected"), F.sum("letters")).first()
    assert tuple(told) == (len(want), 3, sum(map(len, want.values())))
    with pytest.raises(ValueError):
        stream.ingest(spark, str(folder), store, "bam")


def test_fastq_streams_refuse_bad_reads(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nAC\n+\nIII\nr3\nAC\n+\nII\n@r4\n\n+\n\n")
    (folder / "b.fq").write_text("@r5\nGG\n+\nI!\n")
    assert stream.ingest(spark, str(folder), store, "fastq").awaitTermination(120)
    assert {r["id"]: r["mean_quality"] for r in stored(spark, store, "records").collect()} == {"r1": 40.0, "r5": 20.0}
    assert sorted(r["fault"] for r in stored(spark, store, "rejected").collect()) == ["malformed", "no sequence", "quality of another length"]
    assert readers.fastq(spark, str(folder)).count() == 4


def test_row_operators_run_on_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ACGT"), (2, "GGGC")], "id long, sequence string")
    rows.write.parquet(str(tmp_path / "in"))
    gc = lambda df: df.select("id", S.gc_length(F.col("sequence")).alias("gc"))
    query = stream_operator(spark, str(tmp_path / "in"), rows.schema, gc).writeStream.format("memory").queryName("shares").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and {r["id"]: r["gc"] for r in spark.table("shares").collect()} == {1: 0.5, 2: 1.0}
