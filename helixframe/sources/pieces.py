"""FASTA files as pieces of letters: a data source that cuts files into byte ranges, for records of any length.

A range reads the headers that begin in it and the letters that lie in it. What comes before its first header belongs to a record
of an earlier range, which a table of one row a range tells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a range, letters of a piece at most, bytes that are read at once, letters that leave a task together.
RANGE, PIECE, READ, SENT = 32 << 20, 1 << 20, 1 << 20, 4 << 20
SCHEMA = "file string, block int, nth int, header string, offset long, letters string"
FORMAT = "fasta_pieces"


@dataclass
class Range(InputPartition):
    file: str
    block: int
    start: int
    end: int


@dataclass
class Parser:
    """Pieces (nth header of the range or 0 for what continues, header with its first piece, offset, letters) of the lines that it is fed."""

    most: int
    nth: int = 0
    header: str | None = None
    offset: int = 0
    held: list[bytes] = field(default_factory=list)
    size: int = 0

    def begin(self, header: bytes) -> Iterator[tuple]:
        yield from self.flush()
        self.nth, self.offset, self.header = self.nth + 1, 0, header.decode("utf-8", "replace").strip()

    def add(self, letters: bytes) -> Iterator[tuple]:
        letters = b"".join(letters.split())
        self.held.append(letters)
        self.size += len(letters)
        if self.size >= self.most:
            whole = b"".join(self.held)
            for at in range(0, len(whole) - self.most + 1, self.most):
                yield self.piece(whole[at : at + self.most])
            rest = whole[len(whole) // self.most * self.most :]
            self.held, self.size = [rest], len(rest)

    def piece(self, letters: bytes) -> tuple:
        out = (self.nth, self.header, self.offset, letters.decode("latin-1"))
        self.header, self.offset = None, self.offset + len(letters)
        return out

    def flush(self) -> Iterator[tuple]:
        if self.size or self.header is not None:
            yield self.piece(b"".join(self.held))
        self.held, self.size = [], 0


class PiecesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range, self.piece = options["path"], int(options.get("rangeBytes", RANGE)), int(options.get("pieceLetters", PIECE))

    def partitions(self) -> list[Range]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        infos = system.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        if infos == [info] and info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and i.base_name[0] not in "._")
        return [Range(f, k, at, min(at + self.range, size)) for f, size in files for k, at in enumerate(range(0, size, self.range))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        held: list = []
        with system.open_input_file(partition.file) as source:
            for piece in ranged(source, partition.start, partition.end, Parser(self.piece)):
                held.append((partition.file, partition.block, *piece))
                if sum(len(p[-1]) for p in held[-64:]) >= SENT or len(held) >= 8192:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address (local, HDFS, S3, GCS), and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string()]
    names = ["file", "block", "nth", "header", "offset", "letters"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def line_begin(source, at: int) -> int:
    """Where the line begins that the byte before ``at`` and the byte at it belong to; ``at`` itself after a line's end."""
    end = at
    while end > 0:
        start = max(0, end - READ)
        source.seek(start)
        found = source.read(end - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return 0


def ranged(source, start: int, end: int, parser: Parser) -> Iterator[tuple]:
    """The pieces of a byte range: lines after ">" are headers, whole even where they pass its end; lines after "#" are left out."""
    begin = line_begin(source, start)
    source.seek(begin)
    # Of a line that begins before the range only letters count here: its sign tells what it is.
    fresh, letters = begin == start, begin < start and source.read(1) not in (b">", b"#")
    at = start
    while at < end:
        source.seek(at)
        data = source.read(min(READ, end - at))
        i = 0
        while i < len(data):
            stop = data.find(b"\n", i)
            sign = data[i : i + 1] if fresh else b""
            if sign == b">":
                line = data[i + 1 : stop if stop >= 0 else len(data)]
                if stop < 0:
                    source.seek(at + len(data))
                    while (more := source.read(READ)) and (stop := more.find(b"\n")) < 0:
                        line += more
                    line += more[:stop] if more else b""
                    yield from parser.begin(line)
                    # The header may pass the range's end; then nothing of the range is left.
                    at, data, fresh = at + i + len(line) + 2, b"", True
                    break
                yield from parser.begin(line)
            else:
                letters = letters if not fresh else sign != b"#"
                if letters:
                    yield from parser.add(data[i : stop if stop >= 0 else len(data)])
            fresh, i = stop >= 0, stop + 1 if stop >= 0 else len(data)
        at += len(data)
    yield from parser.flush()


class FastaPieces(DataSource):
    """``spark.read.format("fasta_pieces").option("rangeBytes", n).option("pieceLetters", n).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PiecesReader:
        return PiecesReader(self.options)


def fasta_pieces(spark: SparkSession, path: str, range_bytes: int = RANGE, piece_letters: int = PIECE) -> DataFrame:
    """file, record (unique in its file, rising with the place), id, description, offset, letters: records as pieces of
    ``piece_letters`` at most, every letter once at its offset.

    Text before a file's first header, comments and white space are left out; a record without letters has one empty piece. The files are
    read twice: first for the rows that tell each range what goes on in it. Letters are never shuffled with a record as a whole.
    """
    spark.dataSource.register(FastaPieces)
    rows = spark.read.format(FORMAT).option("rangeBytes", range_bytes).option("pieceLetters", piece_letters).load(path)
    n = F.length("letters")
    per = rows.groupBy("file", "block", "nth").agg(F.sum(n).alias("n"), F.max("header").alias("header"))
    blocks = per.groupBy("file", "block").agg(
        F.sum("n").alias("all"), F.max_by("n", "nth").alias("tail"), F.max("nth").alias("nth"), F.max_by("header", "nth").alias("header")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    read = F.coalesce(F.sum("all").over(earlier), F.lit(0))
    blocks = blocks.withColumn("read", read)
    some = F.col("nth") > 0
    last = lambda c: F.last(F.when(some, c), ignorenulls=True).over(earlier)
    carried = blocks.select(
        "file", "block", last(F.col("block")).alias("from"), last(F.col("nth")).alias("from_nth"), last(F.col("header")).alias("from_header"),
        (F.col("read") - last(F.col("read") + F.col("all") - F.col("tail"))).alias("ahead"),
    )
    heads = per.where("nth > 0").select("file", "block", "nth", F.col("header").alias("own"))
    own = rows.where("nth > 0").join(heads, ["file", "block", "nth"]).select("file", "block", "nth", "own", "offset", "letters")
    rest = rows.where("nth = 0").join(carried.where("from is not null"), ["file", "block"])
    rest = rest.select("file", F.col("from").alias("block"), F.col("from_nth").alias("nth"), F.col("from_header").alias("own"), (F.col("offset") + F.col("ahead")).alias("offset"), "letters")
    record = (F.col("block").cast("long") * (1 << 32) + F.col("nth")).alias("record")
    return own.unionByName(rest).select("file", record, F.substring_index("own", " ", 1).alias("id"), F.col("own").alias("description"), "offset", "letters")


def assembled(pieces: DataFrame) -> DataFrame:
    """id, description, sequence, length of the records of ``fasta_pieces``, each put together in one row; records without an id are left out."""
    part = F.array_sort(F.collect_list(F.struct("offset", "letters")))
    rows = pieces.groupBy("file", "record").agg(F.first("id").alias("id"), F.first("description").alias("description"), part.alias("parts"))
    return rows.where("id <> ''").select("id", "description", F.array_join("parts.letters", "").alias("sequence")).withColumn("length", F.length("sequence"))
