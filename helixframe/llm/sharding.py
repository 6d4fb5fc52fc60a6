"""Sharding by fixed virtual slots.

A record's content decides its virtual slot, one of thousands; the bytes of each slot are summed
up, and a versioned map says which shard holds each slot. Rebalancing edits the map: it moves
slots from shards that are too large to those that are too small and leaves all others in place.
The map has one row a slot and version, whatever the number of records.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import cut, shared_folder

SLOTS = 4096
#: Buckets of ids by which the rows of a shard are numbered.
BUCKETS = 256


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each virtual slot (columns virtual_slot, size): ``slots`` numbers on the driver."""
    out = [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():
        out[r["virtual_slot"]] = r["bytes"]
    return out


def rebalance(shard_of: list[int], sizes: list[int], shards: int, tolerance: float = 0.001) -> list[int]:
    """The map with slots moved until shards differ by little: from the largest shard to the smallest,
    always the largest slot that still shrinks the gap."""
    out = list(shard_of)
    total = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        total[shard] += sizes[slot]
        held[shard].append(slot)
    for shard in range(shards):
        held[shard].sort(key=sizes.__getitem__, reverse=True)
    for _ in range(4 * len(out)):
        high, low = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap = total[high] - total[low]
        if gap <= tolerance * max(1, sum(total) // shards):
            break
        slot = next((s for s in held[high] if 0 < sizes[s] <= gap // 2), None)
        slot = slot if slot is not None else next((s for s in reversed(held[high]) if 0 < sizes[s] < gap), None)
        if slot is None:
            break
        held[high].remove(slot)
        held[low].append(slot)
        held[low].sort(key=sizes.__getitem__, reverse=True)
        total[high] -= sizes[slot]
        total[low] += sizes[slot]
        out[slot] = low
    return out


def initial_map(sizes: list[int], shards: int) -> list[int]:
    """A first map: slots from large to small, each to the shard with the fewest bytes so far."""
    heap = [(0, shard) for shard in range(shards)]
    out = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        size, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + sizes[slot], shard))
    return out


def map_frame(spark: SparkSession, shard_of: list[int], version: int) -> DataFrame:
    """The map as rows (version, virtual_slot, shard)."""
    return spark.range(len(shard_of)).select(
        F.lit(version).alias("version"), F.col("id").cast("int").alias("virtual_slot"), lookup(shard_of, F.col("id")).alias("shard")
    )


def lookup(shard_of: list[int], slot: Column) -> Column:
    return F.get(F.split(F.lit(",".join(map(str, shard_of))), ","), slot.cast("int")).cast("int")


def save_map(spark: SparkSession, path: str, shard_of: list[int], version: int) -> None:
    """Add a version to the stored map; earlier versions stay readable."""
    map_frame(spark, shard_of, version).drop("version").write.parquet(f"{path}/version={version}")


def stored_maps(spark: SparkSession, path: str) -> DataFrame | None:
    """(version, virtual_slot, shard) of all stored versions, None without any."""
    try:
        return spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """The latest version, or the one asked for, and its map: one row a slot."""
    maps = stored_maps(spark, path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    rows = maps.where(F.col("version") == version).orderBy("virtual_slot").collect()
    return version, [r["shard"] for r in rows]


def slotted(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """(doc_id, row, size, text_crc32, virtual_slot) for each row of ``docs``.

    Equal texts share a slot, except where their bytes are over half a shard's fair share: at most
    2 * shards such groups exist, and their records are spread over the slots by id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("content"),
        )
    )
    groups = rows.groupBy("content").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    hot = [r["content"] for r in groups.where(F.col("bytes") * 2 * shards > total).collect()]
    spread = F.xxhash64(F.coalesce("doc_id", "row"), "row") if hot else F.col("content")
    key = F.when(F.col("content").isin(hot), spread).otherwise(F.col("content")) if hot else F.col("content")
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")).drop("content")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: their numbers within the shard, from 0 without gaps, counted by bucket of rows."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(BUCKETS)))
    sizes = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket")
    start = sizes.select("shard", "bucket", (F.sum("count").over(before) - F.col("count")).alias("start"))
    within = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("row")) - 1
    out = rows.withColumn("within", within).join(start, ["shard", "bucket"])
    return out.withColumn("slot", F.col("start") + F.col("within")).drop("start", "within", "bucket")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) as doc_id, size, text_crc32, virtual_slot, shard, slot.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1. ``store`` is the folder of the versioned map (one of its
    own in the shared folder if none is given). Without a version there a first one is made and stored; the latest one is edited
    for the bytes that the slots hold now, stored as the next version, and read for the result. Null texts count as
    empty; repeated rows and rows without doc_id each have their place; no rows give none; other columns are not read.
    """
    spark = docs.sparkSession
    store = store or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = slotted(docs, shards, slots)
    sizes = slot_bytes(rows, slots)
    if stored_maps(spark, store) is None:
        save_map(spark, store, initial_map(sizes, shards), 1)
    version, shard_of = load_map(spark, store)
    edited = rebalance(shard_of, sizes, shards)
    if edited != shard_of:
        save_map(spark, store, edited, version + 1)
        version, edited = load_map(spark, store)
    return numbered(rows.withColumn("shard", lookup(edited, F.col("virtual_slot")))).drop("row")
