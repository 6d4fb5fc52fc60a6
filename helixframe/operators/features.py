"""Feature tables of sequences: k-mer encodings, the numeric feature vector, composition and evolution features.

Input columns: seq_idx, sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe import constants as C
from helixframe.functions import protein as P
from helixframe.functions import sequence as S
from helixframe.operators import scans

#: The most words of a dense k-mer encoding before k is lowered to 2.
MOST_WORDS = 10_000
#: The codon that counts as preferred for each residue.
PREFERRED = (
    "TTT", "CTG", "TCT", "TAT", "TGT", "TGG", "CCT", "CAT", "CAG", "CGT", "ATT", "ATG", "ACT", "AAT", "AAG", "GTT", "GCT", "GAT", "GAG", "GGT",
)


def alphabet(seqs: DataFrame) -> list[str]:
    """The letters seen, sorted; case counts."""
    found = seqs.select(F.explode(F.array_distinct(S.letters(F.col("sequence")))).alias("letter")).distinct()
    return sorted(r["letter"] for r in found.collect())


def dense_kmers(seqs: DataFrame, k: int = 3, letters: list[str] | None = None) -> DataFrame:
    """seq_idx, frequencies: of every word of k letters over the alphabet seen, in sorted order.

    Counts are over length - k + 1, at least 1; k becomes 2 where there were over MOST_WORDS words.
    """
    letters = alphabet(seqs) if letters is None else sorted(letters)
    k = 2 if len(letters) ** k > MOST_WORDS else k
    words = ["".join(w) for w in product(letters, repeat=k)]
    n = F.length("sequence") - k + 1
    counts = seqs.select("seq_idx", F.explode(S.words(F.col("sequence"), k)).alias("word")).groupBy("seq_idx", "word").count()
    maps = counts.groupBy("seq_idx").agg(F.map_from_entries(F.collect_list(F.struct("word", "count"))).alias("counts"))
    found = seqs.join(maps, "seq_idx", "left")
    total = F.greatest(n, F.lit(1))
    known = F.coalesce("counts", F.create_map().cast("map<string,bigint>"))
    freq = F.transform(F.array(*map(F.lit, words)), lambda w: F.coalesce(known[w], F.lit(0)) / total)
    return found.select("seq_idx", freq.alias("frequencies"))


def vocabulary(seqs: DataFrame, sizes: tuple[int, ...] = (3, 4, 5, 6), many: int = 100) -> dict[int, list[str]]:
    """The ``many`` most frequent known k-mers of each size, by k-mer on ties: a bounded model on the driver."""
    out: dict[int, list[str]] = {k: [] for k in sizes}
    for r in scans.top_kmers(seqs, sizes, many).orderBy("k", "rank").collect():
        out[r["k"]].append(r["kmer"])
    return out


def vocabulary_frequencies(seqs: DataFrame, words: dict[int, list[str]], many: int = 100) -> DataFrame:
    """seq_idx, kmer_<k> arrays: each word's count over the sequence's known k-mers, filled up to ``many`` with zeros.

    A row is a whole sequence, so its words are counted where it lies, over Arrow batches, and nothing is shuffled.
    """
    if any(k > scans.NUMBER_LETTERS for k in words):
        raise ValueError(f"k-mers have {scans.NUMBER_LETTERS} letters at most")

    def shares(texts: list[str | None], k: int) -> list[np.ndarray]:
        total, kinds = np.zeros(len(texts)), len(words[k])
        counts = np.zeros((len(texts), max(kinds, many)))
        number = np.array([scans.kmer_number(w) for w in words[k]], np.int64)
        order = np.argsort(number)
        for row, found in scans.numbered_kmers(texts, k):
            total += np.bincount(row, minlength=len(texts))
            if kinds:
                at = np.minimum(np.searchsorted(number[order], found), kinds - 1)
                hit = number[order][at] == found
                counts[:, :kinds] += np.bincount(row[hit] * kinds + order[at[hit]], minlength=len(texts) * kinds).reshape(-1, kinds)
        return list(counts / np.maximum(total, 1)[:, None])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), scans.CHUNK):
                part = whole[start : start + scans.CHUNK]
                texts = part["s"].tolist()
                yield pd.DataFrame({"seq_idx": part["seq_idx"].reset_index(drop=True)} | {f"kmer_{k}": shares(texts, k) for k in words})

    given = seqs.select("seq_idx", F.upper("sequence").alias("s"))
    fields = [T.StructField(f"kmer_{k}", T.ArrayType(T.DoubleType())) for k in words]
    return given.mapInPandas(each, T.StructType([given.schema["seq_idx"], *fields]))


def numeric_features(s: Column) -> dict[str, Column]:
    """The features of a sequence without k-mers, by name: composition, physico-chemical, structural."""
    u = F.upper(s)
    n = F.length(u)
    pairs = {f"{p}_freq": S.ratio(S.occurrences(u, p), F.when(n > 0, F.greatest(n - 1, F.lit(1))).otherwise(0)) for p in C.FEATURE_PAIRS}
    orfs = S.inframe_orfs(u)
    return {f"{x}_freq": S.share(u, x) for x in "ATCG"} | pairs | {
        "gc_content": S.gc_length(u), "purine_pyrimidine_ratio": F.when(n == 0, 0.0).otherwise(S.purine_ratio(u)), "melting_temp": S.melting(u),
        "entropy": S.entropy(u) / 2, "repeat_content": S.repeat_score(u), "cpg_score": S.cpg_score(u),
        "log_length": F.log10(F.greatest(n, F.lit(1))) / 6, "max_orf_ratio": orfs["longest"] / F.greatest(n, F.lit(1)),
        "orf_count": F.least(orfs["orfs"] / 10, F.lit(1.0)), "codon_bias": S.codon_bias(u), "periodicity": S.periodicity(u),
    }


def feature_table(seqs: DataFrame, words: dict[int, list[str]] | None = None, many: int = 100) -> DataFrame:
    """seq_idx, features: 8 composition, ``many`` for each k-mer size, 6 physico-chemical, 5 structural features."""
    named = numeric_features(F.col("sequence"))
    names = list(named)
    out = seqs.select("seq_idx", *[named[c].cast("double").alias(f"__{c}") for c in names])
    middle = [F.array().cast("array<double>")]
    if words:
        out = out.join(vocabulary_frequencies(seqs, words, many), "seq_idx")
        middle = [F.col(f"kmer_{k}") for k in words]
    first, rest = F.array(*[F.col(f"__{c}") for c in names[:8]]), F.array(*[F.col(f"__{c}") for c in names[8:]])
    return out.select("seq_idx", F.concat(first, *middle, rest).alias("features"))


def feature_names(words: dict[int, list[str]] | None = None, many: int = 100) -> list[str]:
    named = list(numeric_features(F.col("sequence")))
    middle = [f"kmer_{k}_{w}" for k, ws in (words or {}).items() for w in [*ws, *[f"feature_{i}" for i in range(len(ws), many)]]]
    return named[:8] + middle + named[8:]


def pathogen_scores(seqs: DataFrame) -> DataFrame:
    s = F.col("sequence")
    return seqs.select(
        "seq_idx", S.virulence(s).alias("virulence"), S.resistance(s).alias("resistance"), S.phylogenetic_markers(s).alias("phylogenetic"), S.host_interaction(s).alias("host"),
    )


def drug_target_features(seqs: DataFrame) -> DataFrame:
    """seq_idx, protein (translated to the first stop), 20 residue shares and four scores; zeros for an empty protein."""
    p = F.col("protein")
    rows = seqs.select("seq_idx", S.translate_to_stop(F.col("sequence")).alias("protein"))
    return rows.select(
        "seq_idx", "protein", P.residue_frequencies(p).alias("shares"), P.hydrophobicity(p).alias("hydrophobicity"), P.net_charge(p).alias("net_charge"),
        P.secondary_structure(p).alias("secondary"), P.binding_potential(p).alias("binding"),
    )


def evolution_features(seqs: DataFrame) -> DataFrame:
    """Codon usage, substitution patterns and selection pressure of each sequence, as they stand (case counts)."""
    s = F.col("sequence")
    n, known = F.length(s), F.filter(S.frame_codons(s), lambda c: c.rlike("^[ACGT]{3}$"))
    many = lambda ps: reduce(lambda a, b: a + b, [S.occurrences(s, p) for p in ps])
    six = S.words(s, 6)
    return seqs.select(
        "seq_idx", S.ratio(F.size(F.filter(known, lambda c: c.isin(*PREFERRED))), F.size(known)).alias("bias_score"), F.size(F.array_distinct(known)).alias("codons"),
        F.when(n > 1, many(("AG", "GA", "CT", "TC")) / F.greatest(n - 1, F.lit(1))).otherwise(0.0).alias("transition_ratio"),
        F.when(n > 1, many(("AC", "CA", "AT", "TA", "GC", "CG", "GT", "TG")) / F.greatest(n - 1, F.lit(1))).otherwise(0.0).alias("transversion_ratio"),
        S.occurrences(s, "CG").alias("cpg_sites"), S.gc_unambiguous(s).alias("gc"),
        F.when(n <= 5, 0.0).otherwise(F.size(F.array_distinct(six)) / F.least(F.lit(4096), F.greatest(n - 5, F.lit(1)))).alias("conservation"),
    )


def biological_features(seqs: DataFrame, kind: str = "dna") -> DataFrame:
    """The columns that the feature extraction step adds: counts and shares of bases, GC and 16 pairs, or of residues, mass and pI."""
    s, n = F.upper("sequence"), F.length("sequence")
    if kind == "protein":
        shares = [S.share(s, x).alias(f"{x}_freq") for x in C.AMINO]
        return seqs.select("*", *shares, P.molecular_weight(s).alias("molecular_weight"), P.isoelectric_point(s).alias("isoelectric_point"))
    bases = [c for x in "ATGC" for c in (S.count_of(s, x).alias(f"{x}_count"), S.share(s, x).alias(f"{x}_freq"))]
    pairs = [(S.occurrences(s, a + b) / F.greatest(F.lit(1), n - 1)).alias(f"{a}{b}_freq") for a in "ATGC" for b in "ATGC"]
    return seqs.select("*", *bases, S.gc_unambiguous(s).alias("gc_content"), *pairs)


def one_hot_3d(df: DataFrame, column: str, width: int, letters: str = "ACGT") -> DataFrame:
    """``one_hot``: for each place an array of 0 and 1 over the fixed alphabet; padding is all zeros."""
    known = F.array(*map(F.lit, letters))
    rows = F.transform(F.slice(F.coalesce(S.letters(F.col(column)), F.array().cast("array<string>")), 1, width), lambda c: F.transform(known, lambda x: (x == c).cast("int")))
    return df.withColumn("one_hot", F.slice(F.concat(rows, F.array_repeat(F.array_repeat(F.lit(0), len(letters)), width)), 1, width))
