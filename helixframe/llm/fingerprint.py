"""Document fingerprints by I-Match, in DataFrame functions only.

A term belongs to the lexicon if its inverse document frequency ln(N / df) lies in a band. A text's
distinct lexicon terms are sorted, and of several randomised subsets of the lexicon the terms that
the text has are hashed in order: one hash a subset. Subsets of half the lexicon, a quarter and so
on are at hand; a text uses the sizes that leave it about a half, one and two terms a subset or more, so that
a text which shares part of its terms still shares some hashes. Likeness is the share of equal
hashes.

The lexicon can be broadcast: a term of the band occurs in at least N * exp(-high) documents, so
there are at most exp(high) * (mean distinct terms of a document) such terms, however many documents.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Band of ln(N / df).
LOW, HIGH = 0.7, 6.2
#: Randomised subsets of each size.
REPLICAS = 16
#: A text with n lexicon terms uses the sizes 2^-k for k from log2(n) - 1 to log2(n) + 1.
SCALES = 3
MAX_SCALE = 15


def terms(text: Column) -> Column:
    """Hashes of the text's distinct words in lower case; signs at a word's ends are cut off."""
    words = F.split(F.lower(text), r"[\s\p{Punct}]+")
    return F.transform(F.array_distinct(F.filter(words, lambda w: w != "")), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The terms (hashes) whose ln(N / df) over all rows of ``docs`` lies in the band: term, levels, top.

    For each replica a term draws a number; it is in the subset of size 2^-k if that number starts
    with k zero bits. ``levels`` holds these k, four bits for each replica, and ``top`` the largest.
    """
    n = docs.count()
    df = docs.select(F.explode_outer(terms(F.col("text"))).alias("term")).where("term is not null").groupBy("term").count()
    band = df.where((F.col("count") >= n * math.exp(-high)) & (F.col("count") <= n * math.exp(-low))).select("term")
    drawn = f"transform(sequence(0, {REPLICAS - 1}), r -> shiftrightunsigned(xxhash64(term, r), {64 - MAX_SCALE}))"
    level = f"transform({drawn}, v -> {MAX_SCALE} - if(v = 0, 0, length(bin(v))))"
    band = band.select("term", F.expr(level).alias("level"))
    packed = "aggregate(zip_with(level, sequence(0, %d), (k, r) -> shiftleft(cast(k as bigint), 4 * r)), 0L, (x, y) -> x | y)"
    return band.select("term", F.expr(packed % (REPLICAS - 1)).alias("levels"), F.array_max("level").alias("top"))


def subset_hashes(found: str, scale: str) -> Column:
    """Of the sorted terms in the array column ``found`` (term, levels, top), REPLICAS times SCALES
    hashes: for each replica one of the subset of size 2^-scale and those of the next sizes; 0 for
    an empty subset."""
    likely = f"filter({found}, t -> t.top >= {scale})"
    within = lambda rows, step: f"filter({rows}, t -> (shiftrightunsigned(t.levels, 4 * r) & 15L) >= {scale} + {step})"
    steps = f"transform(array({within('likely', 0)}), kept -> array(kept, {', '.join(within('kept', k) for k in range(1, SCALES))}))[0]"
    hashed = "if(size(s) = 0, 0L, xxhash64(transform(s, t -> t.term)))"
    of = f"flatten(transform(sequence(0, {REPLICAS - 1}), r -> transform({steps}, s -> {hashed})))"
    return F.expr(f"transform(array({likely}), likely -> {of})[0]")


def scale_of(found: str) -> Column:
    least = F.floor(F.log2(F.greatest(F.size(found), F.lit(1)).cast("double"))).cast("int") - 1
    return F.least(F.greatest(F.lit(0), least), F.lit(MAX_SCALE - SCALES))


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes, 0 to 1, of fingerprints in the array columns ``a`` and ``b``.

    The hashes of each size that both have are compared, without subsets of which neither has a
    term, and the size with the largest share counts. Equal fingerprints have likeness 1.
    """
    part = lambda c, i: f"transform(sequence(0, {REPLICAS - 1}), r -> {c}[1 + r * {SCALES} + {i}])"
    share = (
        "aggregate(zip_with({x}, {y}, (x, y) -> named_struct('u', int(x <> 0 or y <> 0), 's', int(x <> 0 and x = y))), "
        "named_struct('u', 0, 's', 0), (p, q) -> named_struct('u', p.u + q.u, 's', p.s + q.s), p -> p.s / greatest(p.u, 1))"
    )
    cases = " ".join(
        f"when {a}[0] - {b}[0] = {gap} then greatest(0D, "
        + ", ".join(share.format(x=part(a, i), y=part(b, i + gap)) for i in range(SCALES) if 0 <= i + gap < SCALES)
        + ")"
        for gap in range(1 - SCALES, SCALES)
    )
    return F.expr(f"case when {a} = {b} then 1D {cases} else 0D end")


def id_bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ids that cut the ids into at most ``parts`` ranges of about equal numbers of rows."""
    at = [k / parts for k in range(1, parts)]
    got = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), at, 10_000)).first()[0] if at else None
    return sorted(set(got or []))


def with_edited(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, place, ghost, doc_id, text, n_chars, edited) for each row: its text and its edited text.

    The next document is the next smaller doc_id; the largest follows the smallest. Rows without
    doc_id come after all others; of repeated ids the longer text comes first. Ids are cut into
    ranges, and the first row of each is also given, as a ghost, to the range before it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text.alias("text"))
    bounds = id_bounds(docs, parts)
    # Range 0 has the largest ids. A range's first row is the one of its largest id.
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("key"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    heads = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("key").alias("top")).collect())
    if not heads:
        heads = [(0, 0)]
    before = {top: heads[k - 1][0] for k, (_, top) in enumerate(heads)}
    moved = reduce(lambda c, kv: c.when(F.col("key") == kv[0], F.lit(kv[1])), before.items(), F.when(F.lit(False), F.lit(0)))
    ghosts = rows.where(F.col("key").isin(list(before))).withColumn("bucket", moved.cast("int"))
    order = (F.col("key").desc(), F.length("text").desc(), F.col("text"))
    ghosts = ghosts.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("n = 1").drop("n")
    every = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    w = Window.partitionBy("bucket").orderBy(F.col("ghost"), *order)
    n, after = F.length("text"), F.coalesce(F.lead("text").over(w), F.lit(""))
    half = F.floor(n / 2).cast("int")
    return every.select(
        "bucket", F.row_number().over(w).alias("place"), "ghost", "doc_id", "text", n.cast("long").alias("n_chars"),
        F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(after, F.lit(1), half)).alias("edited"),
    )


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    A text without terms of the lexicon is told by a hash of all its distinct terms, so an empty
    text equals only texts without any word. Null text counts as empty; repeated rows each get a
    row; no rows give none; other columns are not read.
    """
    spark = docs.sparkSession
    parts = parts or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.broadcast(lexicon(docs))
    both = with_edited(docs.select("doc_id", "text"), parts)
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn(
        "told", F.array(*[F.struct(F.lit(k).alias("of"), F.sort_array(terms(F.col(c))).alias("terms")) for k, c in ((0, "text"), (1, "edited"))])
    )
    # A term outside the band only matters as part of the hash of all terms; of a text's terms the
    # first place carries what belongs to the row, and rows that say nothing go before the grouping.
    flat = both.select("bucket", "place", "ghost", "doc_id", "n_chars", F.unhex("edited_sha256").alias("sha"), F.explode("told").alias("told"))
    flat = flat.withColumn("row", F.struct("ghost", "doc_id", "n_chars", "sha", F.xxhash64("told.terms").alias("whole")))
    flat = flat.select("bucket", "place", "told.of", "row", F.posexplode_outer("told.terms").alias("at", "term"))
    first = F.coalesce("at", F.lit(0)) == 0
    flat = flat.select("bucket", "place", "of", F.when(first, F.col("row")).alias("row"), "term")
    found = flat.join(known, "term", "left").where("levels is not null or row is not null")
    side = lambda k: F.sort_array(F.collect_set(F.when(F.col("levels").isNotNull() & (F.col("of") == k), F.struct("term", "levels", "top"))))
    whole = lambda k: F.max(F.when(F.col("of") == k, F.col("row"))).alias(f"r{k}")
    grouped = found.groupBy("bucket", "place").agg(side(0).alias("t0"), side(1).alias("t1"), whole(0), whole(1))
    grouped = grouped.select(
        "bucket", "place", "r0.ghost", "r0.doc_id", "r0.n_chars", F.lower(F.hex("r0.sha")).alias("edited_sha256"), "t0", "t1",
        F.col("r0.whole").alias("w0"), F.col("r1.whole").alias("w1"),
    )
    grouped = grouped.withColumn("s0", scale_of("t0")).withColumn("s1", scale_of("t1"))
    for k in ("0", "1"):
        hashes = F.concat(F.array(F.col(f"s{k}").cast("long")), subset_hashes(f"t{k}", f"s{k}"))
        alone = F.concat(F.array(F.lit(-100).cast("long")), F.array_repeat(F.col(f"w{k}"), REPLICAS * SCALES))
        grouped = grouped.withColumn(f"f{k}", F.when(F.size(f"t{k}") == 0, alone).otherwise(hashes)).drop(f"t{k}", f"w{k}", f"s{k}")
    w = Window.partitionBy("bucket").orderBy("place")
    out = grouped.withColumn("f2", F.lead("f0").over(w))
    out = out.withColumn("f2", F.coalesce("f2", "f0")).where(~F.col("ghost"))
    written = lambda c: F.concat_ws("", F.transform(c, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", written("f0").alias("fingerprint"), written("f1").alias("edited_fingerprint"),
        likeness("f0", "f1").alias("near_edited"), likeness("f0", "f2").alias("near_next"),
    )
