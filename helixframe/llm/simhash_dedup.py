"""SimHash near-duplicates by anchor-point covering.

Each text gets a 64-bit fingerprint over word shingles. To find the fingerprints within a few
bits of each other, a covering code supplies anchors: every fingerprint is sent to each anchor
within the code's covering radius plus the threshold, so that two close fingerprints meet at the
anchor nearest to either of them, and the fingerprints of one anchor are compared there.

The 64 bits are taken in three segments; of at most four differing bits one segment holds at most
one. In a segment the first 15 bits use the perfect Hamming code of length 15 (covering radius 1)
and the other bits are kept as they are (radius 0), which gives 2^17 or 2^18 anchors a segment and
up to 15 places for a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bounded_batches, connected_components, cut, root_labels

WORDS = 4
SEED = 42
THRESHOLD = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CODED = 15
#: Groups of up to so many fingerprints are compared pair by pair, larger ones by search from a pivot.
SMALL_GROUP = 256


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes; no words: 0."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    n = len(parts)
    if not n:
        return 0
    k = min(words, n)
    flat = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(size) + np.arange(n)
    starts = ends - size
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(flat[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        total += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): a long with the fingerprint's 64 bits for each row; null text counts as empty."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp.view(np.int64)})

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(each, "doc_id long, fp long")


def _syndromes() -> tuple[np.ndarray, list[np.ndarray]]:
    """The Hamming code of length 15: each word's syndrome, and for each syndrome the patterns of at
    most two bits that lead to a codeword (the one of at most one bit first)."""
    word = np.arange(1 << CODED)
    syndrome = np.zeros(1 << CODED, np.int64)
    for bit in range(CODED):
        syndrome ^= np.where(word >> bit & 1, bit + 1, 0)
    patterns = []
    for s in range(CODED + 1):
        near = [0] if s == 0 else [1 << (s - 1)]
        pairs = [1 << a | 1 << b for a in range(CODED) for b in range(a) if (a + 1) ^ (b + 1) == s]
        patterns.append(np.array(near + pairs * (s > 0), np.int64))
    return syndrome, patterns


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, anchor) for every anchor within covering radius plus threshold."""
    syndrome, patterns = _syndromes()
    at, key = [], []
    index = np.arange(len(fp))
    for number, (low, width) in enumerate(SEGMENTS):
        seg = (fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        coded, free = seg & ((1 << CODED) - 1), seg >> CODED
        s = syndrome[coded]
        home = np.zeros(len(fp), np.int64)
        for k, some in enumerate(patterns):
            here = s == k
            home[here] = coded[here] ^ some[0]
            for pattern in some:
                at.append(index[here])
                key.append((number << 40) | (free[here] << CODED) | (coded[here] ^ pattern))
        for bit in range(width - CODED):
            at.append(index)
            key.append((number << 40) | ((free ^ (1 << bit)) << CODED) | home)
    return np.concatenate(at), np.concatenate(key)


def compare_groups(key: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint linked to it) within each anchor; as many rows as fingerprints at most."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, n])
    root = np.arange(n)
    i, j = [], []
    small = np.repeat(size <= SMALL_GROUP, size)
    left = np.repeat(start + size, size) - np.arange(n) - 1  # rows of the group that follow
    rows = np.flatnonzero(small & (left > 0))
    step = 1
    while len(rows):
        hit = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= threshold
        i.append(rows[hit])
        j.append(rows[hit] + step)
        step += 1
        rows = rows[left[rows] >= step]
    if i:
        root = root_labels(n, np.concatenate(i), np.concatenate(j))
    for a, m in zip(start[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        rest = np.arange(a, a + m)
        while len(rest):
            pivot, rest = rest[0], rest[1:]
            queue = [pivot]
            while queue and len(rest):
                hit = np.bitwise_count(fp[rest] ^ fp[queue.pop()]) <= threshold
                root[rest[hit]] = pivot
                queue.extend(rest[hit].tolist())
                rest = rest[~hit]
    linked = root != np.arange(n)
    pairs = np.unique(np.stack([fp[linked], fp[root[linked]]]), axis=1)
    return pairs[0], pairs[1]


def link_fingerprints(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(node, component) of the fingerprints (column ``fp``, each once) that have a partner."""
    if threshold > THRESHOLD:
        raise ValueError("three segments cover four differing bits")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            at, key = anchors(fp)
            yield pd.DataFrame({"anchor": key, "fp": fp[at].view(np.int64)})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["anchor"].to_numpy(), b["fp"].to_numpy()) for b in batches if len(b)]
        if parts:
            key = np.concatenate([p[0] for p in parts])
            fp = np.concatenate([p[1] for p in parts]).view(np.uint64)
            a, b = compare_groups(key, fp, threshold)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = distinct.mapInPandas(place, "anchor long, fp long")
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = placed.repartition(parts, "anchor").mapInPandas(compare, "a long, b long")
    return connected_components(met)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (columns doc_id, text): doc_id, fp, component_id.

    component_id is the smallest doc_id among the rows reachable over links of at most
    ``threshold`` differing bits, itself included. Null and empty texts have fingerprint zero and
    link like any other; repeated rows stay, each with its result; a null doc_id counts as the
    largest and has no influence on the component of others; no rows give no rows. Other columns
    are not read.
    """
    prints = cut(fingerprints(docs, words))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    component = link_fingerprints(firsts.select("fp"), threshold)
    joined = firsts.join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = cut(joined.join(least, "component").select("fp", "component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their near-duplicate group, all columns kept.

    Of several rows with one doc_id one stays; rows without doc_id stay.
    """
    found = cut(near_duplicates(docs, words, threshold).select("doc_id", "component_id"))
    gone = found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeats = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeats.isEmpty():
        return kept
    once = kept.join(repeats, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(repeats, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def to_hex(fp) -> object:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
