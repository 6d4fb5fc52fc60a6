"""Source divergence audit: how far the term shares of each (lang, source) group are from those of the other sources of its lang.

Term shares are integers, so every sum is exact. The distance of two groups adds up over the lang's kept terms, most of
which most groups lack. Heavy terms, present in many groups, are compared in dense NumPy tiles. For light terms a closed
form takes every group as lacking what the other has, and pairs of a term's postings correct it where both have it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import bounded_batches, cut

#: Letters A to Z and all signs beyond ASCII, in lower-cased UTF-8, where each such sign is of bytes from 0x80 on.
TERM, BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
#: Bytes of a text that are cut into terms at once, and counted terms that a task holds before it sends them on.
PIECE, HELD = 4 << 20, 500_000
#: A kept term is in so many documents of its lang at least.
LEAST_DOCS = 30
#: Shares are parts of SCALE, with ADDED occurrences given to each term.
SCALE, ADDED = 1_000_000_000, 5
#: A term in at least one of so many groups of its lang is heavy; groups of a tile side, about; parts of a lang's terms.
HEAVY, SIDE, SALTS = 8, 256, 64
#: Terms that a group reports.
TOP = 50


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a lower-cased text, by pieces of about PIECE bytes that end between terms."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        after = BREAK.search(raw, end) if end < len(raw) else None
        end = after.start() if after else len(raw)
        yield TERM.findall(raw, at, end)
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it), from whole texts. Nulls count as ''; every row is a document."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))

    def sent(held: dict) -> pd.DataFrame:
        found = [(lang, source, t.decode(), n, within[t]) for (lang, source), (every, within) in held.items() for t, n in every.items()]
        return pd.DataFrame(found, columns=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                every, within = held.setdefault((lang, source), (Counter(), Counter()))
                own: set = set()
                for terms in pieces(text.encode().lower()):
                    every.update(terms)
                    own.update(terms)
                within.update(own)
            if sum(len(every) for every, _ in held.values()) > HELD:
                yield sent(held)
                held = {}
        yield sent(held)

    parts = bounded_batches(rows).mapInPandas(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, v: str = "v") -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * v)), in decimals of 38 digits; null without kept terms."""
    return F.expr(f"case when {v} > 0 then 1 + (cast({SCALE} as decimal(10,0)) * ({n} + {ADDED})) div ({total} + {ADDED} * {v}) end")


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of absolute differences over the batch's terms, for each pair of places of two sides."""
    for batch in batches:
        for (lang, i, j), part in batch.groupby(["lang", "i", "j"]):
            a, b = np.stack(part["a"].to_list()), np.stack(part["b"].to_list())
            sums = np.array([np.abs(b - a[:, [g]]).sum(0) for g in range(a.shape[1])], np.int64)
            at, other = (np.triu_indices(len(sums), 1) if i == j else tuple(np.indices(sums.shape).reshape(2, -1)))
            yield pd.DataFrame({"lang": lang, "i": i, "at": at, "j": j, "other": other, "heavy": sums[at, other]})


def group_pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, a, b, value of all pairs of sources a < b of a lang.

    ``groups``: lang, source, v, side, place, sides, empty (the share of a lacking term), light (the lang's light terms);
    ``postings``: lang, term, source, side, place, sides, p, empty, heavy.
    """
    light = postings.where("not heavy")
    kinds = light.groupBy("lang", "source", "p").count().groupBy("lang", "source").agg(F.collect_list(F.struct("p", F.col("count").alias("m"))).alias("kinds"))
    known = groups.join(kinds, ["lang", "source"], "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<struct<p:bigint,m:bigint>>")))
    pick = lambda df, x, *more: df.select("lang", *more, *[F.col(c).alias(c + x) for c in ("source", "side", "place", "empty", "kinds")])
    left = pick(known, "_a", "v", "light", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("to"))
    right = pick(known, "_b", F.col("side").alias("to"))
    # The side and the place order the pairs here; the names order nothing.
    pairs = left.join(right, ["lang", "to"]).where("struct(side_a, place_a) < struct(side_b, place_b)")
    lacking = lambda mine, other, base: F.aggregate(
        mine, F.lit(0).cast("long"), lambda acc, x: acc + x["m"] * (F.abs(x["p"] - other) - base)
    )
    base = F.abs(F.col("empty_a") - F.col("empty_b"))
    closed = F.col("light") * base + lacking(F.col("kinds_a"), F.col("empty_b"), base) + lacking(F.col("kinds_b"), F.col("empty_a"), base)
    pairs = pairs.select(
        "lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"), F.col("side_a").alias("i"), F.col("place_a").alias("at"), F.col("side_b").alias("j"),
        F.col("place_b").alias("other"), F.when(F.col("v") > 0, closed).otherwise(0).alias("closed"),
    )

    one, two = light.alias("one"), light.alias("two")
    met = one.join(two, (F.col("one.lang") == F.col("two.lang")) & (F.col("one.term") == F.col("two.term")))
    met = met.where("struct(one.side, one.place) < struct(two.side, two.place)")
    x, y, ex, ey = (F.col(c) for c in ("one.p", "two.p", "one.empty", "two.empty"))
    fix = F.abs(x - y) - F.abs(x - ey) - F.abs(ex - y) + F.abs(ex - ey)
    both = met.groupBy(F.col("one.lang").alias("lang"), F.col("one.side").alias("i"), F.col("one.place").alias("at"), F.col("two.side").alias("j"), F.col("two.place").alias("other")).agg(F.sum(fix).alias("both"))

    keys = ["lang", "i", "at", "j", "other"]
    tiles = _heavy_rows(groups, postings.where("heavy")).mapInPandas(_tiles, "lang string, i int, at int, j int, other int, heavy long")
    tiles = tiles.groupBy(*keys).agg(F.sum("heavy").alias("dense"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pairs.join(both, keys, "left").join(tiles, keys, "left").select("lang", "a", "b", (F.col("closed") + zero("both") + zero("dense")).alias("value"))


def _heavy_rows(groups: DataFrame, heavy: DataFrame) -> DataFrame:
    """lang, term, i, j, a, b: the dense shares of each heavy term in the groups of two sides, i <= j.

    The shares of lacking terms come from a row a side, copied to each of SALTS parts of the lang's terms, as a lang may hold most terms.
    """
    base = groups.groupBy("lang", "side", "sides").agg(F.array_sort(F.collect_list(F.struct("place", "empty")))["empty"].alias("empty"))
    base = base.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    filled = heavy.groupBy("lang", "term", "side").agg(F.map_from_entries(F.collect_list(F.struct("place", "p"))).alias("found"))
    every = heavy.select("lang", "term", "sides").distinct()
    every = every.select("lang", "term", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"))
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    rows = every.join(filled, ["lang", "term", "side"], "left").withColumn("salt", salt).join(base, ["lang", "side", "salt"])
    dense = F.transform("empty", lambda e, k: F.coalesce(F.col("found")[k], e))
    rows = rows.select("lang", "term", "side", "sides", F.when(F.col("found").isNull(), F.col("empty")).otherwise(dense).alias("shares"))
    a = rows.select("lang", "term", F.col("side").alias("i"), F.col("shares").alias("a"), F.explode(F.sequence(F.col("side"), F.col("sides") - 1)).alias("j"))
    return a.join(rows.select("lang", "term", F.col("side").alias("j"), F.col("shares").alias("b")), ["lang", "term", "j"]).select("lang", "term", "i", "j", "a", "b")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) that occurs.

    Part ``pair``: the distance to each other source of the lang, over all its kept terms. Part ``term``: the ``top`` terms
    whose share in the group passes that in the lang by most. Ranks go by value from the largest, then by item in UTF-8 order.

    Null lang, source and text count as ''. A group without terms has pairs, at the shares of lacking terms; a lang without
    kept terms has pairs of value 0 and no terms; a lang of one source has no pairs. Repeated rows are documents of their
    own. Columns other than lang, source and text are ignored; an empty table gives no rows.
    """
    counts = cut(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("lang_n"), F.count("*").alias("k")).where(F.col("d") >= least_docs)
    kept = cut(kept.drop("d"))
    found = cut(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "k"))

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct()
    langs = groups.groupBy("lang").agg(F.count("*").alias("g"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    langs = langs.join(size, "lang", "left").fillna(0, ["v", "lang_total"])
    # Counted by number of groups first: a lang may hold most of the terms.
    widths = kept.groupBy("lang", "k").agg(F.count("*").alias("m")).join(langs.select("lang", "g"), "lang")
    heavy = widths.where(F.col("k") * HEAVY < F.col("g")).groupBy("lang").agg(F.sum("m").alias("light"))
    langs = langs.join(heavy, "lang", "left").fillna(0, ["light"]).withColumn("sides", F.ceil(F.col("g") / SIDE).cast("int"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
    groups = groups.withColumn("side", F.pmod(F.xxhash64("source"), F.col("sides")).cast("int"))
    place = F.row_number().over(Window.partitionBy("lang", "side").orderBy("source")) - 1
    groups = cut(groups.withColumn("place", place).withColumn("empty", share("0", "total")))

    own = found.join(groups.select("lang", "source", "side", "place", "sides", "total", "v", "g", "lang_total", "empty"), ["lang", "source"])
    own = own.select(
        "lang", "term", "source", "side", "place", "sides", "empty", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"), (F.col("k") * HEAVY >= F.col("g")).alias("heavy"),
    )
    pairs = group_pairs(groups, own.drop("q"))
    two = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    pairs = pairs.select("lang", "value", two).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def oracle(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """DuckDB SQL of ``audit``: all groups against all terms, without the split into heavy and light."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = lambda n, total: f"cast(1 + ({SCALE}::hugeint * ({n} + {ADDED})) // ({total} + {ADDED} * v) as bigint)"
    return f"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(t, '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
kept as (select lang, term, count(*) lang_n from w group by all having count(distinct r) >= {least_docs}),
langs as (select lang, count(*) v, sum(lang_n) lang_total from kept group by all),
n as (select lang, source, term, count(*) n from w group by all),
g as (select distinct lang, source from d),
x as (select g.lang, g.source, k.term, coalesce(n.n, 0) n, k.lang_n from g join kept k on k.lang = g.lang
      left join n on n.lang = g.lang and n.source = g.source and n.term = k.term),
t as (select lang, source, sum(n) total from x group by all),
p as (select x.lang, x.source, x.term, x.n, {share('x.n', 'total')} p, {share('x.lang_n', 'lang_total')} q
      from x join t on t.lang = x.lang and t.source = x.source join langs on langs.lang = x.lang),
far as (select s.lang, s.source, o.source item, cast(sum(abs(s.p - o.p)) as bigint) as value
        from p s join p o on o.lang = s.lang and o.term = s.term and o.source <> s.source group by all),
pair as (select a.lang, a.source, 'pair' part, b.source item, coalesce(far.value, 0) as value
         from g a join g b on a.lang = b.lang and a.source <> b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
term as (select lang, source, 'term' part, term item, p - q as value from p where n > 0 and p > q),
every as (select * from pair union all select * from term),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from every)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {top}"""
