"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, shared by driver and executors; a session without it raises an error.

    A folder of one machine would lose its rows with an executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded to BATCH_BYTES for the Python stages that follow.

    Texts of any length then take a bounded share of an executor.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` is written as Parquet to the shared folder and read again.

    The new plan knows the table's true size. A checkpoint would carry the old plan's estimate, which
    multiplies with every join of an iteration.
    """
    spark = df.sparkSession
    df.write.parquet(path := f"{shared_folder(spark)}/step-{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_labels(labels: DataFrame, label: str, keep: Column, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` rows (doc_id, label), chosen by a hash of the id.

    Rows with a null id or label are left out, and an id that is labelled twice counts once
    with its larger label. With no more than ``max_rows`` labelled rows all of them are kept.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .where(keep)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total = known.count()
    if total <= max_rows:
        return known
    grain = 1 << 20
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < int(grain * max_rows / total))


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The complete groups of a partition that is sorted by ``keys``, one after the other.

    A group may cross batches; only the rows of the group at hand are held.
    """
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for batch in batches:
        if batch.empty:
            continue
        change = np.zeros(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            part = batch.iloc[a:b]
            key = tuple(part[k].iloc[0] for k in keys)
            if last is not None and key != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


#: Edges that a task contracts at once.
CONTRACTED = 50_000


def contracted(edges: DataFrame, many: int, held: int) -> tuple[DataFrame, int]:
    """Edges (a, b) from each node to the smallest one that it reaches within its part of the edges, and the number of parts.

    Parts are of ``held`` edges, whatever the number of edges, and dealt without a key, so no node's edges crowd one.
    """
    parts = max(1, -(-many // held))

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b.to_numpy(np.int64) for b in batches if len(b)]
        if held:
            ends = np.concatenate(held)
            nodes, place = np.unique(ends.ravel(), return_inverse=True)
            place = place.reshape(-1, 2)
            root = root_labels(len(nodes), place[:, 0], place[:, 1])
            some = np.flatnonzero(root != np.arange(len(nodes)))
            yield pd.DataFrame({"a": nodes[some], "b": nodes[root[some]]})

    return cut(edges.select("a", "b").repartition(parts).mapInPandas(contract, "a long, b long")), parts


def connected_components(edges: DataFrame, held: int | None = None) -> DataFrame:
    """(node, component) of an undirected graph given as long columns ``a`` and ``b``.

    The component is the smallest node reachable. Tasks contract their parts of ``held`` edges (CONTRACTED without it) once; where there
    is more than one part, large-star and small-star steps follow, each a grouped minimum and a join, with the edges stored
    after each round. The driver only ever sees a count and a checksum.
    """
    first = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now, parts = contracted(first, first.count(), held or CONTRACTED)
    mark = None
    while parts > 1:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        seen = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = step
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def root_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` indices over the pairs (i, j), in memory."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label
