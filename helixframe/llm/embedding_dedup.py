"""Embedding near-duplicates by NN-descent.

Equal vectors are first taken together. Every vector gets a list of near neighbours, at first from
buckets of random hyperplanes; neighbours-of-neighbours joins refine the lists until hardly any changes.
Every pair of at least the threshold that a bucket or a join meets is a link; of the links of one bucket or join,
as many are kept as connect its vectors. A list that is full of links is saturated: it is enlarged and
refined again, and if it is full still, to its whole component. Links are counted within the components, block by
block. An audit compares a sample of fixed size with all vectors; recall is its share of links found.
While an audited link crosses components more tables of buckets are added, and if that does not help
all vectors are compared, so that the result is whole.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import connected_components, cut, root_labels, runs

log = logging.getLogger(__name__)

THRESHOLD = 0.95
#: Places of a list at first and enlarged; bucket tables at first and in each later pass; passes before all are compared.
NEIGHBOURS, ENLARGED, TABLES, MORE_TABLES, PASSES = 8, 16, 12, 12, 3
#: Refinement ends when less than this share of list places changes, or after so many rounds.
CHANGED, MOST_ROUNDS = 0.002, 8
#: Vectors that share a bucket on average; of larger buckets, rows of a block; rows compared exactly at a time.
BUCKET, BUCKET_BLOCK, BLOCK, AT_ONCE = 48, 1024, 4096, 512
#: Vectors that the audit compares with all others.
AUDITED = 1024
SALTS = 16


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable() -> Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = finite & F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & v.isNotNull() & some, F.lit(False))


def classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, id) of the rows with a usable vector, ``id`` being the smallest vec_id of equal vectors;
    and (id, vector, n) of the distinct vectors. The copies of one vector are dealt over SALTS tasks."""
    rows = embeddings.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    partial = rows.groupBy("vector", "salt").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    distinct = cut(partial.groupBy("vector").agg(F.min("id").alias("id"), F.sum("n").alias("n")).select("id", "vector", "n"))
    named = partial.select("vector", "salt").join(distinct.select("id", "vector"), "vector")
    return rows.join(named, ["vector", "salt"]).select("vec_id", "id"), distinct


def spanning(ids: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
    """Links (a, b), ``cosine`` null, that connect what the symmetric matrix ``linked`` connects."""
    root = root_labels(len(ids), *np.nonzero(linked))
    some = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[some], "b": ids[root[some]], "cosine": np.nan})


PAIRS = "a long, b long, cosine double"


def bucketed(distinct: DataFrame, first: int, tables: int, bits: int, threshold: float) -> DataFrame:
    """(a, b, cosine) of the nearest vectors in the same bucket of signs of random projections, and connecting links without cosine.

    A bucket of many vectors is dealt in blocks; each block is compared with itself and with the first one.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["vector"].map(len)):
                x = unit_rows(part["vector"])
                for t in range(first, first + tables):
                    planes = np.random.default_rng((d, t)).standard_normal((d, bits))
                    code = ((x @ planes > 0) << np.arange(bits)).sum(1) if bits else np.zeros(len(x), np.int64)
                    yield pd.DataFrame({"t": t * 100_000 + d, "code": code, "id": part["id"]})

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["t", "code", "block"]):
            if len(group) > 1:
                yield from top_pairs(group["id"].to_numpy(), unit_rows(group["vector"]), threshold)

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(distinct.select("id", "vector").mapInPandas(place, "t long, code long, id long"))
    sizes = placed.groupBy("t", "code").agg(F.ceil(F.count("*") / BUCKET_BLOCK).alias("blocks")).where("blocks > 1")
    dealt = placed.join(F.broadcast(sizes), ["t", "code"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id", "t"), F.col("blocks")), F.lit(0)))
    # The rows of the first block go to every block; a bucket has n / BUCKET_BLOCK blocks of that size, so rows double at most.
    every = F.when((F.col("block") == 0) & (F.col("blocks") > 1), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = dealt.select("t", "code", F.explode(every).alias("block"), "id").join(distinct.select("id", "vector"), "id")
    met = dealt.repartition(parts, "t", "code", "block").sortWithinPartitions("t", "code", "block").select("t", "code", "block", "id", "vector")
    return met.mapInPandas(nearest, PAIRS)


def top_pairs(ids: np.ndarray, x: np.ndarray, threshold: float, many: int = NEIGHBOURS) -> Iterator[pd.DataFrame]:
    """Each row's nearest others among ``x``, at most ``many``, and links that connect all that are linked."""
    linked = np.zeros((len(x), len(x)), bool)
    for at in range(0, len(x), AT_ONCE):
        c = x[at : at + AT_ONCE] @ x.T
        c[np.arange(len(c)), at + np.arange(len(c))] = -2
        linked[at : at + AT_ONCE] = c >= threshold
        k = min(many, len(x) - 1)
        best = np.argpartition(-c, k - 1, axis=1)[:, :k]
        yield pd.DataFrame({"a": np.repeat(ids[at : at + AT_ONCE], k), "b": ids[best].ravel(), "cosine": np.take_along_axis(c, best, 1).ravel()})
    if linked.any():
        yield spanning(ids, linked)


def best_lists(pairs: DataFrame, rooms: DataFrame | None) -> DataFrame:
    """The nearest of each a, as many as its place in ``rooms`` (a, room) or NEIGHBOURS."""
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    ranked = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).withColumn("k", F.row_number().over(w))
    if rooms is None:
        return cut(ranked.where(F.col("k") <= NEIGHBOURS).select("a", "b", "cosine"))
    ranked = ranked.where(F.col("k") <= ENLARGED).join(rooms, "a", "left")
    return cut(ranked.where(F.col("k") <= F.coalesce("room", F.lit(NEIGHBOURS))).select("a", "b", "cosine"))


def joined_lists(lists: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """What a round of neighbours of neighbours finds: the vectors in one list, and its owner, are compared with each other."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for group in runs(batches, ["a"]):
            x, ids = unit_rows(group["vector"]), group["b"].to_numpy()
            c = x @ x.T
            np.fill_diagonal(c, -2)
            i, j = np.nonzero(c > group["worst"].to_numpy()[:, None])
            held.append(pd.DataFrame({"a": ids[i], "b": ids[j], "cosine": c[i, j]}))
            linked = c >= threshold
            if linked.any():
                held.append(spanning(ids, linked))
            if len(held) > 500:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    worst = lists.groupBy("a").agg(F.min("cosine").alias("worst"))
    vectors = worst.join(distinct.select(F.col("id").alias("a"), "vector"), "a").select(F.col("a").alias("b"), "worst", "vector")
    known = lists.select("a", "b").unionByName(worst.select("a", F.col("a").alias("b")))
    joined = known.join(vectors, "b").select("a", "b", "worst", "vector")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartition(parts, "a").sortWithinPartitions("a").mapInPandas(join, PAIRS)


def refined(lists: DataFrame, links: DataFrame, distinct: DataFrame, rooms: DataFrame | None, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Lists and links after rounds of joins, until hardly any place of a list changes."""
    places = lists.count()
    for _ in range(MOST_ROUNDS):
        met = cut(joined_lists(lists, distinct, threshold))
        links = cut(links.unionByName(met.where("isnan(cosine)").select("a", "b")).distinct())
        new = best_lists(lists.unionByName(met.where("not isnan(cosine)")), rooms)
        changed = new.join(lists.select("a", "b"), ["a", "b"], "left_anti").count()
        lists = new
        if changed <= CHANGED * places:
            break
    return lists, links


def audit(distinct: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): how many other vectors, copies counted, each of a sample of AUDITED vectors is linked to, and the smallest
    and the largest of them as b. The sample is of fixed size, so every task can read it."""
    sample = distinct.select("id", "vector").orderBy(F.xxhash64("id", F.lit(11)), "id").limit(AUDITED).toArrow()
    ids = np.array(sample["id"].to_pylist(), np.int64)
    by_length: dict[int, list[int]] = {}
    vectors = sample["vector"].to_pylist()
    for k, v in enumerate(vectors):
        by_length.setdefault(len(v), []).append(k)
    units = {d: (ids[ks], unit_rows(pd.Series([vectors[k] for k in ks]))) for d, ks in by_length.items()}

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["vector"].map(len)):
                if d not in units:
                    continue
                asked, x = units[d]
                own, n = part["id"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
                linked = (x @ unit_rows(part["vector"]).T >= threshold) & (asked[:, None] != own[None, :])
                some = np.flatnonzero(linked.any(1))
                if len(some):
                    m = linked[some]
                    yield pd.DataFrame({"a": asked[some], "low": np.where(m, own, np.iinfo(np.int64).max).min(1), "high": np.where(m, own, np.iinfo(np.int64).min).max(1), "links": m @ n})

    met = distinct.mapInPandas(compare, "a long, low long, high long, links long")
    return met.groupBy("a").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("links").alias("links"))


def compared(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links, a, b) within each component: how many other vectors, copies counted, are linked directly; and rows with
    id null for links (a, b) that connect each pair of blocks.

    Components are dealt out in unordered pairs of blocks by a hash, so no task holds a whole one.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "vector", "n")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, many = [], 0
        for group in runs(batches, ["component", "i", "j"]):
            ids, n, x = group["id"].to_numpy(np.int64), group["n"].to_numpy(np.int64), unit_rows(group["vector"])
            side = group["block"].to_numpy() == group["i"].iloc[0]
            one, two = np.flatnonzero(side), np.flatnonzero(~side) if group["i"].iloc[0] != group["j"].iloc[0] else np.flatnonzero(side)
            same = group["i"].iloc[0] == group["j"].iloc[0]
            total, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
            for at in range(0, len(one), AT_ONCE):
                part = one[at : at + AT_ONCE]
                linked = (x[part] @ x[two].T >= threshold) & (ids[part][:, None] != ids[two][None, :])
                total[part] += linked @ n[two]
                if not same:
                    total[two] += linked.T @ n[part]
                p, q = np.nonzero(linked)
                root = root_labels(len(ids), np.r_[np.arange(len(ids)), part[p]], np.r_[root, two[q]])
            held.append(pd.DataFrame({"id": pd.array(ids, "Int64"), "links": total, "a": pd.array([None] * len(ids), "Int64"), "b": pd.array([None] * len(ids), "Int64")}))
            some = np.flatnonzero(root != np.arange(len(ids)))
            held.append(pd.DataFrame({"id": pd.array([None] * len(some), "Int64"), "links": 0, "a": ids[some], "b": ids[root[some]]}).astype({"a": "Int64", "b": "Int64"}))
            many += len(ids)
            if many > 20_000:
                yield pd.concat(held)
                held, many = [], 0
        if held:
            yield pd.concat(held)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("component", "i", "j")
    met = rows.repartition(4 * parts, *keys).sortWithinPartitions(*keys)
    return met.mapInPandas(count, "id long, links long, a long, b long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without
    vec_id, link with nothing; vectors of different lengths never link; equal vectors always do.
    Repeated vec_ids each get a row and count as vectors of their own; no rows give none; other
    columns are not read. The audit's recall is written to the log.
    """
    of, distinct = classes(embeddings)
    total = distinct.count()
    bits = max(0, int(np.ceil(np.log2(max(1, total) / BUCKET))))
    audited = cut(audit(distinct, threshold))
    ends = audited.select("a", F.explode(F.array("low", "high")).alias("b"))
    lists = links = None
    for number in range(PASSES):
        met = cut(bucketed(distinct, 0 if lists is None else TABLES + (number - 1) * MORE_TABLES, TABLES if lists is None else MORE_TABLES, bits, threshold))
        near, joins = met.where("not isnan(cosine)"), met.where("isnan(cosine)").select("a", "b")
        lists = best_lists(near if lists is None else lists.unionByName(near), None)
        links = joins if links is None else links.unionByName(joins)
        lists, links = refined(lists, links, distinct, None, threshold)
        full = lists.groupBy("a").agg(F.min("cosine").alias("worst"), F.count("*").alias("m")).where((F.col("worst") >= threshold) & (F.col("m") >= NEIGHBOURS))
        rooms = cut(full.select("a", F.lit(ENLARGED).alias("room")))
        if not rooms.isEmpty():
            lists, links = refined(lists, links, distinct, rooms, threshold)
        links = cut(links.unionByName(lists.where(F.col("cosine") >= threshold).select("a", "b")).distinct())
        component = cut(connected_components(links))
        of_end = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        missed = ends.join(of_end("a"), "a", "left").join(of_end("b"), "b", "left").where("ca is null or cb is null or ca <> cb")
        if missed.isEmpty():
            break
    else:
        every = cut(compared(distinct.select(F.lit(0).cast("long").alias("component"), "id", "vector", "n"), threshold))
        component = cut(connected_components(every.where("a is not null").select("a", "b")))
    members = component.select(F.col("node").alias("id"), "component").join(distinct, "id").select("component", "id", "vector", "n")
    counts = cut(compared(cut(members), threshold).where("id is not null").groupBy("id").agg(F.sum("links").alias("links")))
    recall = audited.join(counts.select(F.col("id").alias("a"), F.col("links").alias("found")), "a", "left").agg(F.sum("links"), F.sum(F.least("links", F.coalesce("found", F.lit(0))))).first()
    log.info("audit: %s of %s links of %s vectors found", recall[1], recall[0], min(total, AUDITED))
    result = distinct.select("id", "n").join(component.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    result = result.select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    found = of.join(cut(result), "id").select("vec_id", "n_links", "component_id")
    alone = embeddings.where(~usable()).select(F.col("vec_id").cast("long").alias("vec_id"))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
