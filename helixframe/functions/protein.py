"""Scalar functions on residue sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe import constants as C
from helixframe.functions.sequence import count_of, letters, share


def weighted(p: Column, weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [count_of(p, k) * v for k, v in weights.items()])


def approximate_weight(p: Column) -> Column:
    """Sum of whole residue weights, without loss of water."""
    return weighted(p, C.RESIDUE_WEIGHTS)


def hydrophobicity(p: Column) -> Column:
    """Mean of the residues' values, summed in whole tenths, so that no order of the sum shows."""
    n = F.length(p)
    tenths = weighted(p, {k: round(10 * v) for k, v in C.KYTE_DOOLITTLE.items()})
    return F.when(n == 0, F.lit(0.0)).otherwise(tenths / F.greatest(n * 10, F.lit(1)))


def net_charge(p: Column) -> Column:
    return share(p, "KRH") - share(p, "DE")


def secondary_structure(p: Column) -> Column:
    return share(p, "AEHKQR") + share(p, "FILVWY")


def druggability(p: Column, has_site: Column) -> Column:
    """Mean of a composition product and the share of the 20 residues; 0.2 more with an enzyme site."""
    one = F.lit(1.0)
    parts = F.least(share(p, "AILMFWYV") * 1.5, one) * F.least(share(p, "DEKR") * 2, one) * F.least(share(p, "STNQ") * 2, one)
    score = (parts + F.size(F.array_distinct(letters(p))) / 20) / 2
    return F.when(F.length(p) == 0, F.lit(0.0)).when(has_site, F.least(score + 0.2, one)).otherwise(score)


def residue_frequencies(p: Column) -> Column:
    """The shares of the 20 residues, in alphabetical order; zeros for an empty protein."""
    return F.array(*[share(p, x) for x in C.AMINO])


def binding_potential(p: Column) -> Column:
    """Share of the binding words that occur, and share of aromatic and branched residues; 0 for an empty protein."""
    words = reduce(lambda a, b: a + b, [F.contains(p, F.lit(w)).cast("int") for w in C.BINDING_WORDS])
    return F.when(F.length(p) == 0, F.lit(0.0)).otherwise(words / len(C.BINDING_WORDS) + share(p, "FWYILV"))


def gene_function(p: Column) -> Column:
    """struct(enzyme_type, domain_family, confidence) by words and the share of cysteine."""
    has = lambda *ws: reduce(lambda a, b: a | b, [F.contains(p, F.lit(w)) for w in ws])
    kinase, receptor, zinc = has("CATALYTIC", "KINASE"), has("BINDING", "RECEPTOR"), count_of(p, "C") > F.length(p) * 0.1
    return F.struct(
        F.when(kinase, "kinase").when(receptor, "receptor").otherwise("unknown").alias("enzyme_type"),
        F.when(~kinase & ~receptor & zinc, "zinc_finger").otherwise("unknown").alias("domain_family"),
        F.when(kinase, 0.8).when(receptor, 0.7).when(zinc, 0.6).otherwise(0.0).alias("confidence"),
    )


def is_standard(p: Column) -> Column:
    return (F.length(p) > 0) & p.rlike(f"^[{C.AMINO}]+$")


def molecular_weight(p: Column) -> Column:
    """Average mass of the chain; 0 unless all residues are among the 20."""
    return F.when(is_standard(p), weighted(p, C.RESIDUE_MASSES) - C.WATER_MASS * (F.length(p) - 1)).otherwise(0.0)


def isoelectric_point(p: Column) -> Column:
    """The pH of no net charge, by halving the interval until it is at most 1e-4 wide; 7 unless all residues are among the 20."""
    n_end = F.coalesce(*[F.when(p.startswith(k), v) for k, v in C.N_END_PK_OF.items()], F.lit(C.N_END_PK))
    c_end = F.coalesce(*[F.when(p.endswith(k), v) for k, v in C.C_END_PK_OF.items()], F.lit(C.C_END_PK))
    once = lambda value, of: F.transform(F.array(value), of)[0]
    # Counts and ends are taken once, before the halvings, which then look at no letters.
    known = F.struct(*[count_of(p, k).alias(k) for k in (*C.POSITIVE_PK, *C.NEGATIVE_PK)], n_end.alias("n_end"), c_end.alias("c_end"))

    def charge(x: Column, ph: Column) -> Column:
        plus = [(x[k], F.lit(v)) for k, v in C.POSITIVE_PK.items()] + [(F.lit(1), x["n_end"])]
        minus = [(x[k], F.lit(v)) for k, v in C.NEGATIVE_PK.items()] + [(F.lit(1), x["c_end"])]
        up = [n / (F.pow(F.lit(10.0), ph - pk) + 1) for n, pk in plus]
        down = [n / (F.pow(F.lit(10.0), pk - ph) + 1) for n, pk in minus]
        return reduce(lambda a, b: a + b, up) - reduce(lambda a, b: a + b, down)

    def halve(x: Column, state: Column) -> Column:
        def side(up: Column) -> Column:
            low, high = F.when(up, state["ph"]).otherwise(state["low"]), F.when(up, state["high"]).otherwise(state["ph"])
            return F.struct(((low + high) / 2).alias("ph"), low.alias("low"), high.alias("high"))

        wide = (state["high"] - state["low"]) > 0.0001
        return F.when(wide, once(charge(x, state["ph"]) > 0, side)).otherwise(state)

    start = F.struct(F.lit(C.PH_START).alias("ph"), F.lit(C.PH_LOW).alias("low"), F.lit(C.PH_HIGH).alias("high"))
    point = once(known, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, lambda state, _: halve(x, state))["ph"])
    return F.when(is_standard(p), point).otherwise(7.0)
