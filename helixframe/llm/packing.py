"""Packing documents into training sequences: Martello-Toth dominance reduction, then best fit.

Tasks tokenise the texts and cut long documents into pieces. What remains to pack is the number of
pieces of each length, at most ``capacity`` numbers, whatever the corpus. On these numbers small
sets that provably dominate every other set holding their largest piece are fixed for good, and the
rest is placed best-fit from long to short. The plan is a list of bin patterns with multiplicities;
every piece finds its sequence and offset from its length and its number among the pieces of that
length, which tasks count by bucket.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm.common import bounded_batches, cut

CAPACITY = 2048
END_ID = 0
#: Buckets of ids by which the pieces of a length are numbered.
BUCKETS = 256
#: The cut into words of byte-level vocabularies, as published with them.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space this long are beyond the stack of the ranked encoder.
_SPACES = re.compile(r"\s{1000}")
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _letter_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves,
    those from U+0100 on for the others in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    later = iter(range(256, 512))
    return {chr(b if b in printable else next(later)): b for b in range(256)}


class _Ids:
    """Texts to ids as little-endian unsigned 32-bit numbers, equal to those of
    ``Tokenizer.encode(text, add_special_tokens=False)``.

    A byte-level vocabulary whose ids follow the order of its merges is the same as a table of ranks,
    with which ``tiktoken`` gives the same ids in a third of the time. Other vocabularies, and texts
    that spell a special token or hold very long white space, go through the tokeniser itself.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranked(json.load(f))

    def _ranked(self, known: dict) -> tiktoken.Encoding | None:
        model, cut = known["model"], known.get("pre_tokenizer") or {}
        plain = not known.get("normalizer") and {k: cut.get(k) for k in BYTE_LEVEL} == BYTE_LEVEL
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or odd or model["type"] != "BPE":
            return None
        merged = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merged)):
            return None
        byte = _letter_bytes()
        ranks = {bytes(map(byte.__getitem__, w)): i for w, i in model["vocab"].items() if w not in self.special}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.special) or _SPACES.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array.array("I", ids).tobytes()


_LOADED: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    if path not in _LOADED:
        _LOADED[path] = _Ids(path)
    return _LOADED[path]


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, row (number of the document's row), piece, start, length, ids_crc32.

    A document's ids end in id 0; null text counts as empty. Only documents of more than
    ``capacity`` ids are cut; their first piece takes the remainder.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _ids(tokenizer)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "row", "piece", "start", "length", "ids_crc32")}
            for doc, row, text in zip(batch["doc_id"], batch["row"], batch["text"]):
                raw = table.encode(text or "") + END_ID.to_bytes(4, "little")
                n = len(raw) // 4
                at, number = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    out["doc_id"].append(doc)
                    out["row"].append(row)
                    out["piece"].append(number)
                    out["start"].append(at)
                    out["length"].append(size)
                    out["ids_crc32"].append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    at, number = at + size, number + 1
            frame = pd.DataFrame(out)
            frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
            yield frame

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
    return rows.mapInPandas(each, schema)


@dataclass
class Pattern:
    """``times`` equal bins, each with these pieces from the left."""

    lengths: list[int]
    times: int
    reduced: bool


class _Numbers:
    """How many pieces there are of each length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.of = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.of)

    def take(self, length: int, times: int = 1) -> None:
        self.of[length] -= times
        if not self.of[length]:
            del self.of[length]
            del self.order[bisect_left(self.order, length)]

    def largest_upto(self, limit: int, without: list[int]) -> int | None:
        k = bisect_right(self.order, limit) - 1
        while k >= 0:
            if self.of[self.order[k]] > without.count(self.order[k]):
                return self.order[k]
            k -= 1
        return None

    def smallest(self, many: int, without: list[int], over: int = 0) -> list[int]:
        """The ``many`` smallest pieces longer than ``over`` besides those in ``without``, or as many as there are."""
        out: list[int] = []
        for k in range(bisect_right(self.order, over), len(self.order)):
            length = self.order[k]
            out += [length] * min(many - len(out), self.of[length] - without.count(length))
            if len(out) == many:
                break
        return out


def dominant_sets(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix sets that dominate every other set with their largest piece; the patterns and what is left.

    For the largest piece j, let i be the largest other piece that fits beside it. {j} dominates if
    nothing fits; {j, i} if it fills the bin or no two others fit beside j; {j, i, b}, b the largest
    that fits beside both, if no three fit beside j and no two pieces longer than b fit together.
    """
    left = _Numbers(counts)
    patterns: list[Pattern] = []
    for j in sorted(counts, reverse=True):
        while left.of.get(j):
            room = capacity - j
            i = left.largest_upto(room, [j])
            low = left.smallest(3, [j])
            if i is None:
                chosen = [j]
            elif i == room or len(low) < 2 or low[0] + low[1] > room:
                chosen = [j, i]
            else:
                b = left.largest_upto(room - i, [j, i])
                others = left.smallest(2, [j], over=b or 0)
                three = len(low) == 3 and sum(low) <= room
                two = len(others) == 2 and sum(others) <= room
                if b is None or three or two:
                    break
                chosen = [j, i, b]
            need = Counter(chosen)
            # Taking pieces away keeps every condition true, so the set is fixed as often as there are pieces for it.
            times = min(left.of[k] // v for k, v in need.items())
            for k, v in need.items():
                left.take(k, v * times)
            patterns.append(Pattern(chosen, times, True))
    return patterns, left.of


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on numbers of equal lengths: equal bins are kept as one with a multiplicity."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(room: int, content: tuple[int, ...], times: int) -> None:
        if room not in bins or not bins[room]:
            insort(rooms, room)
        bins[room].append((content, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                room, content, times, fresh = capacity, (), -(-n // (capacity // length)), True
            else:
                room, fresh = rooms[k], False
                content, times = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[k]
            each = room // length
            full = min(times, n // each)
            if full:
                put(room - each * length, (*content, *[length] * each), full)
                n -= full * each
            if n and full < times:
                put(room - n % each * length if n < each else room, (*content, *[length] * n) if n < each else content, 1 if n < each else times - full)
                if n < each:
                    n, full = 0, full + 1
                    if not fresh and times - full:
                        put(room, content, times - full)
            elif not n and full < times and not fresh:
                put(room, content, times - full)
    return [Pattern(list(content), times, False) for room in sorted(bins) for content, times in bins[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = dominant_sets(counts, capacity)
    return fixed + best_fit(left, capacity)


def placements(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length the runs of its pieces in order: first number, sequence, offset, pieces a bin."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for p in patterns:
        offset = 0
        for length, many in Counter(p.lengths).items():
            runs[length].append((used[length], sequence, offset, many))
            used[length] += many * p.times
            offset += many * length
        sequence += p.times
    return {k: np.array(v, np.int64) for k, v in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; every sequence is filled from 0 without gaps.

    Needs a long column ``length`` (1 to capacity) and ``doc_id``, ``row``, ``piece`` to tell pieces
    apart; other columns are kept. No pieces give no rows.
    """
    bucket = F.pmod(F.xxhash64("row", "piece"), F.lit(BUCKETS))
    pieces = pieces.withColumn("__bucket", bucket)
    sizes = pieces.groupBy("length", "__bucket").count()
    total = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    where = placements(plan(total, capacity))

    first = sizes.select(
        "length", "__bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("count")).alias("__before")
    )
    numbered = pieces.withColumn(
        "__number", F.row_number().over(Window.partitionBy("__bucket", "length").orderBy("row", "piece")) - 1
    ).join(first, ["length", "__bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        n = number.to_numpy(np.int64)
        size = length.to_numpy(np.int64)
        out = np.zeros((len(n), 2), np.int64)
        for k in np.unique(size):
            here = size == k
            runs = where[int(k)]
            at = np.searchsorted(runs[:, 0], n[here], "right") - 1
            start, sequence, offset, many = runs[at].T
            past = n[here] - start
            out[here, 0] = sequence + past // many
            out[here, 1] = offset + past % many * k
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    placed = numbered.withColumn("__place", place("length", F.col("__number") + F.col("__before")))
    keep = [c for c in pieces.columns if c not in ("__bucket", "sequence_id", "offset")]
    return placed.select(*keep, "__place.sequence_id", "__place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are pieces of one id; repeated rows and rows without doc_id are packed
    each; an empty table gives no rows; other columns are not read.
    """
    pieces = cut(tokenised_pieces(docs, tokenizer, capacity))
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
