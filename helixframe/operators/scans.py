"""Sequence scans: a row a sequence in, a row a hit out. Input columns: seq_idx, sequence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe import constants as C
from helixframe.functions import protein as P
from helixframe.functions import sequence as S


#: Rows, hits, and letters of ORFs that a task holds in Python before it hands them on.
CHUNK, HITS, LETTERS = 1024, 1 << 14, 1 << 24


def motif_hits(seqs: DataFrame, motifs: tuple = C.MOTIFS, upper: bool = True) -> DataFrame:
    """seq_idx, family, motif, score, position, region for every non-overlapping hit of the table's patterns, from 0;
    the region is of 100 letters on both sides of the position.

    Positions of hits need a scan that carries its place; with SQL functions it is quadratic in the
    hits, so the patterns run over Arrow batches, each linear in the sequence.
    """
    compiled = [(f, n, float(score), re.compile(p)) for f, n, p, _, score in motifs]
    rows = seqs.select("seq_idx", (F.upper("sequence") if upper else F.col("sequence")).alias("s"))

    def frame(batch: pd.DataFrame, held: list[tuple[int, int, int]]) -> pd.DataFrame:
        at, kinds, position = (np.array([h[j] for h in held], np.int64) for j in range(3))
        names = [np.array([c[j] for c in compiled], object)[kinds] for j in range(2)]
        score, texts = np.array([c[2] for c in compiled])[kinds], batch["s"].tolist()
        region = [texts[i][max(0, p - 100) : p + 100] for i, _, p in held]
        return pd.DataFrame({
            "seq_idx": batch["seq_idx"].iloc[at].to_numpy(), "family": names[0], "motif": names[1], "score": score, "position": position, "region": np.array(region, object),
        })

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Hits go on as soon as there are HITS of them, so that memory grows neither with a batch nor with a sequence."""
        for whole in batches:
            for start in range(0, len(whole), CHUNK):
                batch, held = whole[start : start + CHUNK], []
                for i, s in enumerate(batch["s"]):
                    for k, (_, _, _, pattern) in enumerate(compiled if s else ()):
                        for m in pattern.finditer(s):
                            held.append((i, k, m.start()))
                            if len(held) == HITS:
                                yield frame(batch, held)
                                held = []
                yield frame(batch, held)

    schema = T.StructType([rows.schema["seq_idx"], *T._parse_datatype_string("family string, motif string, score double, position int, region string").fields])
    return rows.mapInPandas(scan, schema)


def promoters(seqs: DataFrame) -> DataFrame:
    """Promoter motifs with a strength by the GC of the region of 100 letters around."""
    hits = motif_hits(seqs, tuple(m for m in C.MOTIFS if m[0] == "promoter"))
    gc = S.gc_unambiguous(F.col("region"))
    strength = F.when(gc.between(0.4, 0.6), 0.8).when(gc.between(0.3, 0.7), 0.6).otherwise(0.4)
    return hits.select("seq_idx", "motif", "position", strength.alias("strength"))


def cpg_islands(seqs: DataFrame, width: int = 200, step: int = 50) -> DataFrame:
    """Windows with over half G and C and over 0.6 percent CpG; windows are not merged. ``width`` is a multiple of ``step``.

    Pieces of ``step`` letters are counted once; a window adds the counts of its pieces and the pairs across their borders.
    """
    u = F.upper("sequence")
    cut = F.regexp_extract_all(u, F.lit(f"(?s)(.{{{step}}})"), F.lit(1))
    counted = F.transform(
        cut, lambda x: F.struct(S.count_of(x, "CG").alias("gc"), S.occurrences(x, "CG").alias("cg"), x.endswith("C").alias("c"), x.startswith("G").alias("g"))
    )
    windows = F.ceil((F.length(u) - width) / step).cast("int")
    pieces = seqs.select("seq_idx", windows.alias("windows"), counted.alias("x")).where("windows > 0")
    many = width // step
    gc = lambda i: reduce(lambda a, b: a + b, [F.col("x")[i + j]["gc"] for j in range(many)])
    cg = lambda i: reduce(
        lambda a, b: a + b, [F.col("x")[i + j]["cg"] for j in range(many)] + [(F.col("x")[i + j]["c"] & F.col("x")[i + j + 1]["g"]).cast("int") for j in range(many - 1)]
    )
    found = F.transform(F.sequence(F.lit(0), F.col("windows") - 1), lambda i: F.struct((i * step).alias("start"), (gc(i) / width).alias("gc"), (cg(i) * 100 / width).alias("cpg")))
    w = pieces.select("seq_idx", F.explode(F.filter(found, lambda x: (x["gc"] > 0.5) & (x["cpg"] > 0.6))).alias("w")).select("seq_idx", "w.*")
    return w.select(
        "seq_idx", "start", (F.col("start") + width).alias("end"), "gc", "cpg", F.least(F.col("cpg") / 2, F.lit(1.0)).alias("methylation")
    )


def _orf_places(s: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts (from 0) and ends (exclusive) of all ORFs of a sequence: each ATG with the next stop in its frame."""
    x = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
    if len(x) < 6:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = x[:-2].astype(np.int32) << 16 | x[1:-1].astype(np.int32) << 8 | x[2:]
    number = lambda w: int.from_bytes(w.encode(), "big")
    start = np.flatnonzero(code == number("ATG"))
    stop = np.flatnonzero(np.isin(code, [number(w) for w in C.STOPS]))
    end = np.full(len(start), -1)
    for frame in range(3):
        mine, stops = np.flatnonzero(start % 3 == frame), stop[stop % 3 == frame]
        at = np.searchsorted(stops, start[mine])
        some = at < len(stops)
        end[mine[some]] = stops[at[some]] + 3
    return start[end >= 0], end[end >= 0]


def orfs(seqs: DataFrame, column: str = "sequence", text: bool = True) -> DataFrame:
    """Every ATG at any offset with its first stop in frame; the other input columns stay. start from 0, end exclusive.

    The next stop of each frame is found by a sorted search over Arrow batches: with SQL functions
    it takes a walk from every ATG, which is quadratic in long sequences. ORFs go on as soon as they have LETTERS
    letters, so that memory grows neither with a batch nor with a sequence. ``text``: with the column orf.
    """

    def frame(batch: pd.DataFrame, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        at = np.repeat(np.array([h[0] for h in held], np.int64), np.array([len(h[1]) for h in held], np.int64))
        start, end = (np.concatenate([h[k] for h in held] or [np.zeros(0, np.int64)]) for k in (1, 2))
        out = {c: batch[c].iloc[at].reset_index(drop=True) for c in kept}
        out |= {"start": start, "end": end, "orf_length": end - start}
        if text:
            whole = batch[column].tolist()
            out["orf"] = np.array([whole[i][a:b] for i, a, b in zip(at, start, end)], object)
        return pd.DataFrame(out)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                batch, held, size = whole[at : at + CHUNK], [], 0
                for i, s in enumerate(batch[column]):
                    start, end = _orf_places(s) if s else (np.zeros(0, np.int64),) * 2
                    done = size + np.cumsum((end - start if text else 0) + np.full(len(start), 256))
                    for piece in np.unique(done // LETTERS):
                        if piece:
                            yield frame(batch, held)
                            held = []
                        mine = done // LETTERS == piece
                        held.append((i, start[mine], end[mine]))
                    size = int(done[-1] % LETTERS) if len(done) else size
                yield frame(batch, held)

    kept = [c for c in seqs.columns if c != column]
    schema = T.StructType([*[seqs.schema[c] for c in kept], *T._parse_datatype_string("start int, end int, orf_length int" + (", orf string" if text else "")).fields])
    return seqs.mapInPandas(scan, schema)


def frames(seqs: DataFrame) -> DataFrame:
    """seq_idx, n (its length), frame (1 to 3, -1 to -3), strand: the sequence or its reverse complement from each offset."""
    s = F.replace(F.upper("sequence"), F.lit("U"), F.lit("T"))
    both = seqs.select("seq_idx", F.length("sequence").alias("n"), s.alias("s")).withColumn("r", S.reverse_complement(F.col("s")))
    six = F.array(
        *[F.struct(F.lit(sign * (k + 1)).alias("frame"), F.expr(f"substr({c}, {k + 1})").alias("strand")) for sign, c in ((1, "s"), (-1, "r")) for k in range(3)]
    )
    return both.select("seq_idx", "n", F.explode(six).alias("x")).select("seq_idx", "n", "x.frame", "x.strand")


def adaptive_minimum(seqs: DataFrame, min_length: int = 300) -> DataFrame:
    """One row: the minimum ORF length, lowered for small inputs."""
    total = F.sum(F.length("sequence"))
    mean = F.avg(F.length("sequence"))
    return seqs.agg(F.when(total < 50_000, F.greatest(F.lit(60), (mean * 0.3).cast("int"))).otherwise(min_length).alias("min_length"))


def genes(seqs: DataFrame, min_length: int = 300) -> DataFrame:
    """ORFs of all six frames from the adaptive minimum on, with coding potential."""
    found = orfs(frames(seqs), "strand").crossJoin(F.broadcast(adaptive_minimum(seqs, min_length)))
    kept = found.where("orf_length >= min_length")
    return kept.select("seq_idx", "frame", "start", "end", "orf_length", "min_length", S.coding_potential(F.col("orf")).alias("coding_potential"))


#: The number of a base by its letter (64: unknown), and the residue by the number of a codon.
_BASE = np.full(256, 64, np.int64)
_BASE[[ord(b) for b in C.BASES]] = range(4)
_RESIDUE = np.frombuffer((C.CODE + "X").encode(), np.uint8)


def _protein(s: str) -> str:
    """What ``S.translate_from`` gives, by a table of codons."""
    x = _BASE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    x = x[: len(x) // 3 * 3].reshape(-1, 3)
    return _RESIDUE[np.minimum(x[:, 0] * 16 + x[:, 1] * 4 + x[:, 2], 64)].tobytes().decode()


def six_frame_proteins(seqs: DataFrame) -> DataFrame:
    """seq_idx, n (the sequence's length), frame, protein.

    Strands are translated over Arrow batches, once: as a SQL function the translation is put in wherever a query uses the
    protein, and walks through the codons each time.
    """
    given = frames(seqs)

    def translated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch[at : at + CHUNK]
                yield part.drop(columns="strand").assign(protein=[None if s is None else _protein(s) for s in part["strand"]])

    return given.mapInPandas(translated, T.StructType([*[given.schema[c] for c in ("seq_idx", "n", "frame")], T.StructField("protein", T.StringType())]))


def snvs(seqs: DataFrame, reference: DataFrame) -> DataFrame:
    """Mismatches to the one reference sequence (column reference), place by place."""
    both = seqs.crossJoin(F.broadcast(reference.select("reference").limit(1)))
    n = F.least(F.length("sequence"), F.length("reference"))
    first = lambda c: F.slice(S.letters(F.col(c)), 1, n)
    pairs = F.zip_with(first("sequence"), first("reference"), lambda a, r: F.when(a != r, F.struct(r.alias("ref"), a.alias("alt"))))
    hits = both.select("seq_idx", F.posexplode(pairs).alias("position", "x")).where("x is not null")
    return hits.select("seq_idx", "position", "x.ref", "x.alt")


def tail_indels(seqs: DataFrame, reference: DataFrame) -> DataFrame:
    """One insertion or deletion at the end where the lengths differ."""
    both = seqs.crossJoin(F.broadcast(reference.select("reference").limit(1)))
    n, r = F.length("sequence"), F.length("reference")
    kind = F.when(n > r, "insertion").when(n < r, "deletion")
    return both.select("seq_idx", kind.alias("kind"), F.least(n, r).alias("position"), F.abs(n - r).alias("size")).where("kind is not null")


def _first(name: str, s: Column, pattern: str, score: float) -> Column:
    at = F.instr(s, pattern)
    return F.when(at > 0, F.struct(F.lit(name).alias("name"), (at - 1).alias("position"), F.lit(score).alias("confidence")))


def _loose(table: tuple, s: Column, score: float) -> Column:
    return F.array_compact(F.array(*[F.coalesce(*[_first(f"{name}_PARTIAL", s, p, score) for p in ps]) for name, ps in table]))


def _exploded(rows: DataFrame, found: Column, *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode(found).alias("x")).select(*keys, "x.name", "x.position", "x.confidence")


def bacterial_signatures(seqs: DataFrame) -> DataFrame:
    """First hits of the strict literals; without any, for sequences under 500, one of each loose class."""
    s = F.col("sequence")
    strict = F.array_compact(F.array(*[_first(n, s, p, 0.8) for n, p in C.BACTERIAL]))
    found = F.when((F.size(strict) == 0) & (F.length(s) < 500), _loose(C.BACTERIAL_LOOSE, s, 0.6)).otherwise(strict)
    return _exploded(seqs, found, "seq_idx")


def viral_signatures(seqs: DataFrame) -> DataFrame:
    return _exploded(seqs, F.array_compact(F.array(*[_first(n, F.col("sequence"), p, 0.7) for n, p in C.VIRAL])), "seq_idx")


def resistance_genes(seqs: DataFrame) -> DataFrame:
    """Protein literals in six frames; in short sequences also an S and a K within ten residues of each other."""
    rows = six_frame_proteins(seqs)
    p = F.col("protein")
    s, k = F.instr(p, "S"), F.instr(p, "K")
    near = F.when(
        (F.col("n") < 1000) & (s > 0) & (k > 0) & (F.abs(s - k) < 10),
        F.struct(F.lit("POTENTIAL_BETA_LACTAMASE").alias("name"), (F.least(s, k) - 1).alias("position"), F.lit(0.5).alias("confidence")),
    )
    found = F.array_compact(F.array(*[_first(n, p, x, 0.8) for n, x, _ in C.RESISTANCE], near))
    return _exploded(rows, found, "seq_idx", "frame")


def pathogenicity_factors(seqs: DataFrame) -> DataFrame:
    found = F.array_compact(F.array(*[_first(n, F.col("protein"), x, 0.8) for n, x in C.VIRULENCE]))
    return _exploded(six_frame_proteins(seqs), found, "seq_idx", "frame")


def _sites(small: Column) -> Column:
    p = F.col("protein")
    strict = F.array_compact(F.array(*[_first(n, p, x, 0.9) for n, x in C.ENZYME]))
    return F.when((F.size(strict) == 0) & small, _loose(C.ENZYME_LOOSE, p, 0.6)).otherwise(strict)


def drug_proteins(seqs: DataFrame) -> DataFrame:
    """Proteins of six frames that are long enough, with their sites and druggability."""
    rows = six_frame_proteins(seqs)
    rows = rows.where(F.length("protein") > F.when(F.col("n") < 500, 20).otherwise(50)).withColumn("sites", _sites(F.col("n") < 500))
    score = P.druggability(F.col("protein"), F.size("sites") > 0)
    return rows.withColumn("score", score).withColumn("druggable", F.col("score") > F.when(F.col("n") < 500, 0.4).otherwise(0.7))


def enzyme_sites(seqs: DataFrame) -> DataFrame:
    return _exploded(drug_proteins(seqs), F.col("sites"), "seq_idx", "frame")


def top_targets(seqs: DataFrame, many: int = 5) -> DataFrame:
    """The druggable proteins with the highest scores, by sequence and frame on ties."""
    d = drug_proteins(seqs).where("druggable")
    return d.orderBy(F.desc("score"), "seq_idx", F.desc("frame")).limit(many).select("seq_idx", "frame", "score")


def known_kmers(k: int, upper: bool = True) -> Column:
    """Every overlapping k-mer of known letters of the column sequence, in one pass."""
    s = F.upper("sequence") if upper else F.col("sequence")
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=([ATCG]{{{k}}}))."), F.lit(1))


def kmers(seqs: DataFrame, k: int, upper: bool = True) -> DataFrame:
    """The input columns but the sequence, and kmer: every overlapping k-mer of known letters, cut out in one pass."""
    return seqs.select(*[c for c in seqs.columns if c != "sequence"], F.explode(known_kmers(k, upper)).alias("kmer"))


def word_counts(found: Column, words: list[str]) -> list[Column]:
    """How often each word is among ``found``, within the row; 0 where there is none."""
    return [F.coalesce(F.size(found) - F.size(F.array_remove(found, w)), F.lit(0)) for w in words]


#: Letters whose k-mers are numbered at a time, and the most letters of a k-mer that a number holds.
NUMBERED, NUMBER_LETTERS = 1 << 19, 31


def numbered_kmers(texts: list[str | None], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of its text, number) of every overlapping k-mer of known letters, two bits a letter, of NUMBERED letters at a time."""

    def numbers() -> tuple[np.ndarray, np.ndarray]:
        x = _BASE[np.frombuffer("?".join(held).encode("latin-1", "replace"), np.uint8)]
        many = len(x) - k + 1
        number, known = np.zeros(many, np.int64), np.ones(many, bool)
        for j in range(k):
            number = number << 2 | x[j : j + many] & 3
            known &= x[j : j + many] < 4
        return np.repeat(place, [len(p) + 1 for p in held])[:many][known], number[known]

    held, place, size = [], [], 0
    for i, s in enumerate(texts):
        for at in range(0, len(s or "") - k + 1, NUMBERED):
            held.append(s[at : at + NUMBERED + k - 1])
            place.append(i)
            size += len(held[-1])
            if size >= NUMBERED:
                yield numbers()
                held, place, size = [], [], 0
    if held:
        yield numbers()


def kmer_of(number: np.ndarray, k: int) -> np.ndarray:
    """The k-mers of these numbers."""
    at = number[:, None] >> (2 * np.arange(k - 1, -1, -1)) & 3
    return np.frombuffer(C.BASES.encode(), np.uint8)[at].view(f"S{k}").ravel().astype(str).astype(object)


def kmer_number(word: str) -> int:
    return sum(C.BASES.index(b) << 2 * j for j, b in enumerate(reversed(word)))


def kmer_totals(seqs: DataFrame, k: int, upper: bool = True) -> DataFrame:
    """kmer, count: of every k-mer of known letters over all sequences, counted over Arrow batches, so that k-mers are no rows."""
    if k > NUMBER_LETTERS:
        return kmers(seqs, k, upper=upper).groupBy("kmer").count()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, number in numbered_kmers(batch["s"].tolist(), k):
                kinds, n = np.unique(number, return_counts=True)
                yield pd.DataFrame({"kmer": kmer_of(kinds, k), "n": n})

    texts = seqs.select((F.upper("sequence") if upper else F.col("sequence")).alias("s"))
    return texts.mapInPandas(count, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("count"))


def kmer_frequencies(seqs: DataFrame, k: int) -> DataFrame:
    """Long form: count over the sequence's valid k-mers."""
    counts = kmers(seqs, k).groupBy("seq_idx", "kmer").count()
    total = F.sum("count").over(Window.partitionBy("seq_idx"))
    return counts.select("seq_idx", "kmer", "count", (F.col("count") / total).alias("freq"))


def top_kmers(seqs: DataFrame, sizes: tuple[int, ...], many: int, upper: bool = True) -> DataFrame:
    """The most frequent k-mers of each size, by k-mer on ties."""
    w = Window.partitionBy("k").orderBy(F.desc("count"), "kmer")
    out = None
    for k in sizes:
        one = kmer_totals(seqs, k, upper).select(F.lit(k).alias("k"), "kmer", "count")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= many)


def discriminative_kmers(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), fold: float = 2.0) -> DataFrame:
    """k-mers over ``fold`` times as frequent in a label's sequences as in the rest (columns also: label); case counts."""
    out = None
    for k in sizes:
        c = kmers(labelled.select("label", "sequence"), k, upper=False).groupBy("label", "kmer").count()
        c = c.withColumn("k", F.lit(k))
        out = c if out is None else out.unionByName(c)
    own, every = Window.partitionBy("k", "label"), Window.partitionBy("k")
    kmer = Window.partitionBy("k", "kmer")
    out = out.withColumn("t", F.sum("count").over(own)).withColumn("tt", F.sum("count").over(every)).withColumn("kk", F.sum("count").over(kmer))
    rest = F.col("kk") - F.col("count")
    freq, other = F.col("count") / F.col("t"), rest / F.greatest(F.col("tt") - F.col("t"), F.lit(1))
    out = out.withColumn("freq", freq).withColumn("rest_freq", other).withColumn("fold", F.col("freq") / (F.col("rest_freq") + 0.001))
    return out.where(rest > 0).where(F.col("fold") > fold).select("label", "k", "kmer", "freq", "rest_freq", "fold")


def conserved_motifs(seqs: DataFrame, sizes: tuple[int, ...] = (6, 7, 8), least: float = 0.1) -> DataFrame:
    total = seqs.agg(*[F.sum(F.greatest(F.length("sequence") - k + 1, F.lit(0))).alias(f"n{k}") for k in sizes])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n")) for k in sizes])).alias("x")
    top = top_kmers(seqs, sizes, 20, upper=False).join(F.broadcast(total.select(pairs).select("x.*")), "k")
    freq = F.col("count") / F.col("n")
    return top.select("k", "kmer", "count", freq.alias("freq"), (freq * F.col("k")).alias("score")).where(F.col("freq") > least)
