"""Spelling variants: words one letter apart, met by anagram keys, and the chain of ever more frequent forms of each word.

The anagram key of a word is the sum of its code points' fifth powers, so it does not depend on the order of its letters. A word
that another exceeds by one letter has that word's key less one letter's power; two words that exchange one letter share a key less
one power each. Every word sends its own key and its keys less each of its letters. The letters' order is verified within the key:
by a hash of what is left, which splits words of the same letters, and then on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import bounded_batches, cut

#: Least letters and occurrences of a word; a form occurs so many times as often as its word.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: Of the checksums of document and run, those that this divides lose a letter.
SLIP = 31
#: Characters of a text that are read at once, words that a task holds before it sends them on, and keys that it sends at once.
PIECE, HELD, SENT = 4 << 20, 200_000, 1 << 16
#: Latin letters up to U+00FF; in Latin-1 each is one byte, and what Latin-1 lacks becomes a question mark.
RUN = "[a-z\\xc0-\\xff]"
#: An odd base of the order's hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def texts(text: str) -> Iterator[bytes]:
    """The lower-cased text in Latin-1, in pieces of about PIECE characters that end between runs."""
    held = b""
    for at in range(0, len(text), PIECE):
        held += text[at : at + PIECE].encode("latin-1", "replace").lower()
        last = max(held.rfind(b" "), held.rfind(b"\n"))
        if last >= 0 and at + PIECE < len(text):
            yield held[:last]
            held = held[last:]
    yield held


def slip(run: bytes, start: int) -> bytes:
    """The run, without one letter where SLIP divides the checksum; ``start`` is the checksum of the document's id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, slips: bool = False, least: int = LEAST_LETTERS) -> DataFrame:
    """word, n: the runs of Latin letters of whole texts, with at least ``least`` letters, and their occurrences.

    ``slips`` removes a letter of those runs whose checksum with the document's id says so.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    run = re.compile(f"{RUN}{{{least},}}".encode())

    def sent(every: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": [w.decode("latin-1") for w in every], "n": list(every.values())}).astype({"word": object, "n": "int64"})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch["i"], batch["t"]):
                start = zlib.crc32(f"{i}:".encode())
                for raw in texts(t):
                    found = run.findall(raw)
                    if not slips:
                        every.update(found)
                        continue
                    for w, n in Counter(found).items():
                        w = slip(w, start)
                        if len(w) >= least:
                            every[w] += n
            if len(every) > HELD:
                yield sent(every)
                every = Counter()
        yield sent(every)

    return bounded_batches(rows).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def order_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """Of each word its number, the place left out (-1: none), the anagram key and the order's hash of what is left, and whether the
    place begins a run of one letter.

    All places of a word take one pass: sums of powers are kept from the left, and what follows a place moves one to the left.
    """
    n = np.array([len(w) for w in words], np.int64)
    point = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    first = np.cumsum(n) - n
    word = np.repeat(np.arange(len(words)), n)
    place = np.arange(len(point)) - first[word]
    power = np.ones(int(n.max(initial=0)) + 1, np.uint64)
    power[1:] = np.uint64(BASE)
    power = np.cumprod(power, dtype=np.uint64)
    letter = (point + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    letter ^= letter >> np.uint64(29)
    term = letter * power[place]
    left = np.cumsum(term, dtype=np.uint64)
    before = left - term - np.r_[np.uint64(0), left][first][word]
    fifth = point**5
    total = lambda x: np.add.reduceat(x, first, dtype=np.uint64) if len(x) else np.zeros(0, np.uint64)
    key, order = total(fifth), total(term)
    rest = before + (order[word] - before - term) * np.uint64(INVERSE)
    begins = np.r_[True, (point[1:] != point[:-1]) | (place[1:] == 0)][: len(point)]
    return (
        np.r_[np.arange(len(words)), word], np.r_[np.full(len(words), -1), place], np.r_[key, key[word] - fifth].view(np.int64),
        np.r_[order, rest].view(np.int64), np.r_[np.ones(len(words), bool), begins],
    )


def postings(words: DataFrame) -> DataFrame:
    """id, place, key, rest, begins of every word (columns id, word, none empty) and place of it, and of the word itself at place -1."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["word"].str.len().to_numpy()
            part = (np.cumsum(size) - size) // SENT
            for p in np.unique(part):
                some = batch[part == p]
                word, place, key, rest, begins = order_keys(some["word"].tolist())
                out = pd.DataFrame({"id": some["id"].to_numpy()[word], "place": place.astype(np.int32), "key": key, "rest": rest, "begins": begins})
                for at in range(0, len(out), SENT):
                    yield out[at : at + SENT]

    return words.select("id", "word").mapInPandas(send, "id long, place int, key long, rest long, begins boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b of all words (column word, distinct, none empty) that differ by exactly one inserted, deleted or replaced letter, in both orders.

    A word and place meet at most one word a letter of the alphabet, so no key is crowded. Words of any length
    send numbers only; the words themselves come back for the pairs that met.
    """
    known = words.select("word", F.xxhash64("word").alias("id"))
    sent = cut(postings(known))
    less = sent.where("place >= 0")
    longer = less.where("begins").select("key", "rest", F.col("id").alias("i"), "place")
    own = sent.where("place < 0").select("key", "rest", F.col("id").alias("j"))
    added = longer.join(own, ["key", "rest"]).select("i", "j", "place", F.lit(True).alias("add"))
    one = less.select("key", "rest", "place", F.col("id").alias("i"))
    two = less.select("key", "rest", "place", F.col("id").alias("j"))
    exchanged = one.join(two, ["key", "rest", "place"]).where("i < j").select("i", "j", "place", F.lit(False).alias("add"))
    met = added.unionByName(exchanged).join(known.select(F.col("id").alias("i"), F.col("word").alias("a")), "i").join(known.select(F.col("id").alias("j"), F.col("word").alias("b")), "j")
    left = lambda w: F.expr(f"concat(substr({w}, 1, place), substr({w}, place + 2))")
    proved = F.when(F.col("add"), left("a") == F.col("b")).otherwise((F.length("a") == F.length("b")) & (F.col("a") != F.col("b")) & (left("a") == left("b")))
    pairs = met.where(proved)
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
    return pairs.select(both).select("x.*")


def variants(docs: DataFrame, slips: bool = False, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words with at least ``least_letters`` letters and ``least_count`` occurrences.

    A word's form is its near word of largest n, the smallest of those in code-point order, if that n is ``times`` the word's own at
    least, else null; form_n is the form's n. The root follows forms to the last, and is the word itself without a form.

    Null and empty texts hold no words; a null id counts as empty text in the checksum of a slip. Repeated rows count each time;
    columns other than doc_id and text are ignored; an empty table gives no rows. Texts and words may be of any length.
    """
    if times < 2:
        raise ValueError("a form occurs at least twice as often as its word")
    words = cut(word_counts(docs, slips, least_letters).where(F.col("n") >= least_count))
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("b").alias("form"))).alias("x")
    near = pairs.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    out = words.join(near, "word", "left")
    has = -F.col("x.m") >= times * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("x.form")).alias("form"), F.when(has, -F.col("x.m")).alias("form_n"))
    out = cut(out)
    # Each step of a chain has ``times`` the occurrences of the one before, so chains end soon; every round doubles the steps taken.
    step = out.where("form is not null").select("word", F.col("form").alias("root"))
    most = out.agg(F.max("form_n")).first()[0] or 0
    taken = 1
    while least_count * times**taken < most:
        nearer = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(step.join(nearer, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        taken *= 2
    return out.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
