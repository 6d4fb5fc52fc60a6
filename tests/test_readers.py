"""Readers over files of several splits, by extension, and in pieces."""

import io

from pyspark.sql import functions as F

from helixframe.sources import pieces, readers


def test_fastq_is_read_in_splits(spark, tmp_path):
    reads = [(f"r{k}", "ACGT" * (k % 30), ("@" + "I" * 200)[: 4 * (k % 30)]) for k in range(2000)]
    for name, part in (("a.fastq", reads[:1500]), ("b.fastq", reads[1500:])):
        (tmp_path / name).write_text("".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in part))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert readers.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        got = sorted((r["id"], r["sequence"], r["quality"]) for r in readers.fastq(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(reads)


def test_pieces_equal_records_wherever_files_are_cut(spark, tmp_path):
    """Every size of range from one byte on: headers, lines and comments across borders, a preamble, records without letters or id."""
    text = "junk\n>a first one\nACGT\nAC GT\n# note ACGT\nTT\n>b\n\n>c\tx\r\nGG\r\n>\nAAAA\n>d last\nACGTACGTACGTACGTAC"
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text("# only\n>e\nA\nC\n")
    (tmp_path / "c.fa").write_text("")
    (tmp_path / "_skipped").write_text(">no\nA")
    want = sorted((r["id"], r["sequence"]) for r in readers.fasta(spark, str(tmp_path) + "/*.fa").collect())
    assert ("d", "ACGTACGTACGTACGTAC") in want and len(want) == 5
    data = {f: (tmp_path / f).read_bytes() for f in ("a.fa", "b.fa")}
    for size in range(1, len(text) + 2):
        for most in (1, 3, 100):
            got = {}
            for f, raw in data.items():
                record = None
                for at in range(0, len(raw), size):
                    for nth, header, _, letters in pieces.ranged(io.BytesIO(raw), at, min(at + size, len(raw)), pieces.Parser(most)):
                        assert len(letters) <= most
                        if header is not None:
                            record = (f, at, nth)
                            got[record] = [header.split(" ")[0], ""]
                        if record is not None:
                            got[record][1] += letters
            assert sorted(map(tuple, (v for v in got.values() if v[0]))) == [(i.split(" ")[0], s) for i, s in want], size
    for size, most in ((1, 1), (7, 3), (20, 5), (1 << 20, 4)):
        rows = pieces.fasta_pieces(spark, str(tmp_path), size, most)
        assert sorted((r["id"], r["sequence"]) for r in pieces.assembled(rows).collect()) == want


def test_a_record_of_fifty_million_letters_is_read_in_pieces(spark, tmp_path):
    line = "ACGTTGCA" * 10 + "\n"
    (tmp_path / "long.fa").write_text(">small\nAC\n>long one\n" + line * 625_000 + ">after\nGG\n")
    rows = pieces.fasta_pieces(spark, str(tmp_path), 8 << 20)
    got = {r["id"]: (r["n"], r["pieces"], r["most"], r["end"]) for r in rows.groupBy("id").agg(F.sum(F.length("letters")).alias("n"), F.count("*").alias("pieces"), F.max(F.length("letters")).alias("most"), F.max(F.col("offset") + F.length("letters")).alias("end")).collect()}
    assert got["small"] == (2, 1, 2, 2) and got["after"] == (2, 1, 2, 2)
    assert got["long"][0] == got["long"][3] == 50_000_000 and got["long"][1] >= 48 and got["long"][2] == 1 << 20
    # Every piece holds the letters of its offset.
    wrong = rows.where("id = 'long'").where(F.substring("letters", 1, 8) != F.substring(F.lit("ACGTTGCA" * 2), (F.col("offset") % 8 + 1).cast("int"), F.lit(8)))
    assert wrong.count() == 0


def test_readers_by_extension(spark, tmp_path):
    import pytest

    (tmp_path / "a.fq").write_text("@r\nACGT\n+\nIIII\n")
    (tmp_path / "a.tsv").write_text("id\tmy_sequence\n1\tACGT\n2\t\n")
    assert readers.read(spark, str(tmp_path / "a.fq")).first()["mean_quality"] == 40.0
    assert readers.read(spark, str(tmp_path / "a.tsv"), "dna").count() == 2 and readers.sequence_lengths(readers.read(spark, str(tmp_path / "a.tsv"))).first()["column"] == "my_sequence"
    assert readers.read(spark, str(tmp_path / "a.tsv"), name="upload.csv").columns == ["id", "my_sequence"]
    (tmp_path / "b.csv").write_text("id,x\n1,2\n")
    for name, kind in (("b.csv", "protein"), ("b.xlsx", "general")):
        with pytest.raises(ValueError):
            readers.read(spark, str(tmp_path / "b.csv"), kind, name)
    assert readers.safe(spark, str(tmp_path / "none.csv")) is None and readers.safe(spark, str(tmp_path / "b.csv"), 1).count() == 1
