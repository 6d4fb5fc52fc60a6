"""Scalar functions on nucleotide sequences: Column in, Column out, no Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe import constants as C


def occurrences(s: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def count_of(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def gc_length(s: Column) -> Column:
    """(G+C) over the length, 0 for an empty sequence."""
    return ratio(count_of(s, "GC"), F.length(s))


def gc_unambiguous(s: Column) -> Column:
    """(G+C+S) over the unambiguous letters."""
    return ratio(count_of(F.upper(s), "GCS"), count_of(F.upper(s), "ACGTUSW"))


def share(s: Column, letters: str) -> Column:
    return ratio(count_of(s, letters), F.length(s))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, *C.COMPLEMENT))


def translate_from(s: Column) -> Column:
    """Residues of the codons from the start; * for stops, X for unknown codons; a partial codon is dropped."""
    return F.array_join(F.transform(frame_codons(s), residue), "")


def residue(codon: Column) -> Column:
    at = [F.instr(F.lit(C.BASES), F.substring(codon, k, 1)) - 1 for k in (1, 2, 3)]
    known = (at[0] >= 0) & (at[1] >= 0) & (at[2] >= 0)
    return F.when(known, F.substring(F.lit(C.CODE), at[0] * 16 + at[1] * 4 + at[2] + 1, F.lit(1))).otherwise(F.lit("X"))


def letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def words(s: Column, k: int) -> Column:
    """Every overlapping word of k letters, cut in one pass: a substring at each place would walk from the start each time."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits over all letters; 0 for an empty sequence."""
    n = F.length(s)
    kinds = F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")
    terms = F.transform(kinds, lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def purine_ratio(s: Column) -> Column:
    """(A+G) over (C+T), at most 10."""
    return F.least(count_of(s, "AG") / F.greatest(count_of(s, "CT"), F.lit(1)), F.lit(10.0))


def melting(s: Column) -> Column:
    gc = count_of(s, "GC")
    return ratio(gc * 4 + (F.length(s) - gc) * 2, F.length(s)) / 100


def shifted_matches(s: Column, size: int, shift: int) -> Column:
    """At how many places the ``size`` letters equal those ``shift`` places on (``size`` or more), in one pass over the letters."""
    return F.regexp_count(s, F.lit(rf"(?s)(?=(.{{{size}}}).{{{shift - size}}}\1)."))


def repeat_score(s: Column) -> Column:
    """Twice the share of positions whose two letters are repeated by the next two, at most 1."""
    n = F.length(s)
    return F.when(n < 6, F.lit(0.0)).otherwise(F.least(shifted_matches(s, 2, 2) * 2 / F.greatest(n, F.lit(1)), F.lit(1.0)))


def cpg_score(s: Column) -> Column:
    """Half of observed over expected CpG, at most 1; 0 for short sequences or without C or G."""
    n, c, g = F.length(s), count_of(s, "C"), count_of(s, "G")
    expected = F.greatest(c * g / F.greatest(n, F.lit(1)), F.lit(1.0))
    return F.when((n < 20) | (c == 0) | (g == 0), F.lit(0.0)).otherwise(F.least(occurrences(s, "CG") / expected, F.lit(2.0)) / 2)


def periodicity(s: Column) -> Column:
    """The largest share of letters equal to the one 1, 2 or 3 places on; 0 for short sequences."""
    n = F.length(s)

    def match(d: int) -> Column:
        use = F.floor(n / 2) - 1 >= d
        return F.when(use, shifted_matches(s, 1, d) / F.greatest(n - d, F.lit(1))).otherwise(F.lit(0.0))

    return F.when(n < 6, F.lit(0.0)).otherwise(F.greatest(*[match(d) for d in (1, 2, 3)]))


def codons(s: Column) -> Column:
    """The known codons from the start."""
    return F.regexp_extract_all(s, F.lit(r"(?s)\G(?:(?![ACGT]{3})...)*+([ACGT]{3})"), F.lit(1))


def coding_potential(s: Column) -> Column:
    """Twice the share of ATG, TGG, TTT, AAA and GAA among the known codons, at most 1."""
    every = codons(s)
    good = F.filter(every, lambda c: c.isin("ATG", "TGG", "TTT", "AAA", "GAA"))
    return F.least(ratio(F.size(good), F.size(every)) * 2, F.lit(1.0))


def upper_kinds(s: Column) -> Column:
    """The distinct letters in upper case, spaces at the ends left out. Each letter counts on its own, as in SQL: one that has no single
    upper-case letter stays as it is, and a sharp s becomes the capital one, not two S."""
    kinds = F.array_distinct(letters(F.trim(s)))
    single = F.transform(kinds, lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "\u00df", "\u1e9e")))
    return F.array_distinct(single)


def purity(kinds: Column, alphabet: str) -> Column:
    """The share of distinct letters that an alphabet knows."""
    known = F.array_intersect(kinds, F.array(*[F.lit(c) for c in alphabet]))
    return ratio(F.size(known), F.size(kinds))


def sequence_type(s: Column) -> Column:
    """dna, rna, protein or unknown by the share of distinct letters that an alphabet knows."""
    kinds = upper_kinds(s)
    has_u = F.array_contains(kinds, "U")
    return (
        F.when((purity(kinds, C.DNA) > 0.9) & ~has_u, "dna")
        .when((purity(kinds, C.RNA) > 0.9) & has_u, "rna")
        .when(purity(kinds, C.AMINO) > 0.8, "protein")
        .otherwise("unknown")
    )


def header_label(header: Column, strict: bool = False) -> Column:
    """Label of a FASTA header: its last word, or the last part by | or _.

    A disease word anywhere in it gives affected, else a normal word gives normal, so unaffected
    is affected; ``strict`` asks for normal words first.
    """
    words = F.split(F.trim(header), r"\s+")

    def of(part: Column) -> Column:
        low = F.lower(part)
        ill = reduce(lambda a, b: a | b, [low.contains(w) for w in C.DISEASE_WORDS])
        well = reduce(lambda a, b: a | b, [low.contains(w) for w in C.NORMAL_WORDS])
        return F.when(well, "normal").when(ill, "affected").otherwise(part) if strict else F.when(ill, "affected").when(well, "normal").otherwise(part)

    return (
        F.when(F.size(words) > 1, of(F.element_at(words, -1)))
        .when(header.contains("|"), of(F.substring_index(header, "|", -1)))
        .when(header.contains("_"), of(F.substring_index(header, "_", -1)))
        .otherwise("unknown")
    )


def pad(s: Column, n: int) -> Column:
    """Cut to n letters or fill up: with N if all letters are nucleotides, else with X."""
    return F.when(F.upper(s).rlike("^[ACGTUN]*$"), F.rpad(s, n, "N")).otherwise(F.rpad(s, n, "X"))


def client_type(s: Column) -> Column:
    """DNA or RNA if all letters (four kinds at most) are of that alphabet, PROTEIN otherwise; empty counts as DNA."""
    u = F.upper(s)
    return F.when(u.rlike("^[ATCG]*$"), "DNA").when(u.rlike("^[AUCG]*$"), "RNA").otherwise("PROTEIN")


def frame_codons(s: Column, offset: int = 0) -> Column:
    """All whole codons from ``offset`` on, cut out in one pass."""
    return F.regexp_extract_all(F.substring(s, offset + 1, 1 << 30), F.lit("(?s)(...)"), F.lit(1))


def inframe_orfs(s: Column) -> Column:
    """struct(longest, orfs) over the three forward frames: from an ATG to the next stop in frame, not nested.

    Each match begins where the last one ended, so codons stay in frame, and no loop gives back what it took: one pass a frame.
    """
    stops = "|".join(C.STOPS)
    pattern = rf"(?s)\G(?:(?!ATG)...)*+(ATG(?:(?!{stops})...)*+(?:{stops}))"
    found = [F.regexp_extract_all(F.substring(s, k + 1, 1 << 30), F.lit(pattern), F.lit(1)) for k in range(3)]
    longest = F.array_max(F.transform(F.concat(*found), F.length))
    return F.struct(F.when(s.isNotNull(), F.coalesce(longest, F.lit(0))).alias("longest"), F.when(s.isNotNull(), F.size(F.concat(*found))).alias("orfs"))


def codon_bias(s: Column) -> Column:
    """Twice the share of the most frequent known codon, at most 1; 0 unless the length is a multiple of 3."""
    known = codons(s)
    # Equal codons stand together once they are sorted: the longest run of them, at four letters each.
    runs = F.regexp_extract_all(F.concat(F.array_join(F.sort_array(known), ","), F.lit(",")), F.lit(r"(...,)\1*+"), F.lit(0))
    most = F.array_max(F.transform(runs, F.length)) / 4
    return F.when((F.length(s) % 3 == 0) & (F.size(known) > 0), F.least(most * 2 / F.greatest(F.size(known), F.lit(1)), F.lit(1.0))).otherwise(0.0)


def translate_to_stop(s: Column) -> Column:
    """Residues of the known codons up to the first stop; unknown codons are left out; U counts as T."""
    known = F.filter(frame_codons(F.replace(F.upper(s), F.lit("U"), F.lit("T"))), lambda c: c.rlike("^[ACGT]{3}$"))
    return F.substring_index(F.array_join(F.transform(known, residue), ""), "*", 1)


def _present(s: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(s, F.lit(w)).cast("int") for w in words])


def virulence(s: Column) -> Column:
    return _present(s, C.VIRULENCE_WORDS) / len(C.VIRULENCE_WORDS)


def resistance(s: Column) -> Column:
    return _present(s, C.RESISTANCE_WORDS) / len(C.RESISTANCE_WORDS)


def _counted(s: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [occurrences(s, w) for w in words])


def phylogenetic_markers(s: Column) -> Column:
    return F.least(_counted(s, C.PHYLOGENETIC_WORDS) / 10, F.lit(1.0))


def host_interaction(s: Column) -> Column:
    return F.least(_counted(s, C.HOST_WORDS) / 5, F.lit(1.0))


def quality_issues(s: Column) -> Column:
    """The issues of a nucleotide sequence as text: ambiguous letters, gaps, other letters, shortness."""
    u = F.upper(s)
    ambiguous, gaps = count_of(u, C.AMBIGUOUS_BASES), count_of(u, "-")
    other = F.length(F.translate(u, C.DNA + C.AMBIGUOUS_BASES + "-", ""))
    return F.array_compact(
        F.array(
            F.when(ambiguous > 0, F.concat(F.lit("Contains "), ambiguous, F.lit(" ambiguous bases"))),
            F.when(gaps > 0, F.concat(F.lit("Contains "), gaps, F.lit(" gaps"))),
            F.when(other > 0, F.concat(F.lit("Contains "), other, F.lit(" invalid characters"))),
            F.when(F.length(s) < 50, F.concat(F.lit("Very short sequence ("), F.length(s), F.lit(" bp)"))),
        )
    )
