"""The drivers that put scans together: genes, mutations, pathogens, motifs, biomarkers, and the comprehensive analysis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe import constants as C
from helixframe.functions import protein as P
from helixframe.functions import sequence as S
from helixframe.operators import ordered, scans
from helixframe.storage import stored

#: A batch of sequences: so many at most, and so many letters.
BATCH_SEQUENCES, BATCH_LETTERS = 100, 500_000
#: Places of a range in which the starts of batches are followed by one task.
RANGE = 1 << 16


def predicted_genes(seqs: DataFrame, min_length: int = 300) -> DataFrame:
    """Genes with their protein's predicted function."""
    found = scans.orfs(scans.frames(seqs), "strand").crossJoin(F.broadcast(scans.adaptive_minimum(seqs, min_length))).where("orf_length >= min_length")
    p = S.translate_from(F.col("orf"))
    return found.select(
        "seq_idx", "frame", "start", "end", "orf_length", S.coding_potential(F.col("orf")).alias("coding_potential"), P.gene_function(p).alias("function")
    ).select("*", "function.*").drop("function")


def gene_totals(seqs: DataFrame, min_length: int = 300) -> DataFrame:
    """One row: all ORFs, those kept, the long ones (twice the minimum, 200 at least), their mean length, the minimum."""
    found = scans.orfs(scans.frames(seqs), "strand", text=False).select("orf_length")
    least = scans.adaptive_minimum(seqs, min_length)
    long = F.greatest(F.col("min_length") * 2, F.lit(200))
    return found.crossJoin(F.broadcast(least)).groupBy("min_length").agg(
        F.count("*").alias("orfs"), F.count_if(F.col("orf_length") >= F.col("min_length")).alias("kept"), F.count_if(F.col("orf_length") >= long).alias("long"), F.avg("orf_length").alias("mean_length")
    )


def mutation_totals(seqs: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """One row: SNVs and indels against the reference (none without it), oncogenic sites, SNVs a base."""
    sites = scans.motif_hits(seqs, C.ONCOGENIC, upper=False).agg(F.count("*").alias("oncogenic"))
    bases = seqs.agg(F.sum(F.length("sequence")).alias("bases"))
    if reference is None:
        none = F.lit(0).cast("long")
        return sites.crossJoin(bases).select(none.alias("snvs"), none.alias("indels"), "oncogenic", F.lit(0.0).alias("mutation_rate"))
    snvs = scans.snvs(seqs, reference).agg(F.count("*").alias("snvs"))
    indels = scans.tail_indels(seqs, reference).agg(F.count("*").alias("indels"))
    return snvs.crossJoin(indels).crossJoin(sites).crossJoin(bases).select("snvs", "indels", "oncogenic", S.ratio(F.col("snvs"), F.col("bases")).alias("mutation_rate"))


def drug_totals(seqs: DataFrame) -> DataFrame:
    """One row: enzyme sites and druggable proteins of all sequences."""
    return scans.drug_proteins(seqs).agg(F.coalesce(F.sum(F.size("sites")), F.lit(0)).alias("enzyme_sites"), F.count_if("druggable").alias("druggable"))


def pathogen_signatures(seqs: DataFrame) -> DataFrame:
    """seq_idx, kind, name, position, confidence of all four kinds of signatures."""
    parts = {
        "bacterial": scans.bacterial_signatures(seqs), "viral": scans.viral_signatures(seqs),
        "resistance": scans.resistance_genes(seqs), "pathogenicity": scans.pathogenicity_factors(seqs),
    }
    out = None
    for kind, rows in parts.items():
        one = rows.select("seq_idx", F.lit(kind).alias("kind"), "name", "position", "confidence")
        out = one if out is None else out.unionByName(one)
    return out


#: Antibiotic classes by the resistance gene's name.
ANTIBIOTICS = {"BETA_LACTAMASE": "beta_lactams", "AMINOGLYCOSIDE": "aminoglycosides", "TETRACYCLINE": "tetracyclines"}


def antibiotic_class(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ANTIBIOTICS.items() for x in pair])
    return F.coalesce(table[name], F.lit("unknown"))


def motif_totals(seqs: DataFrame) -> DataFrame:
    """kind, hits of promoters, enhancers, sites of transcription factors, splice sites and CpG islands."""
    kinds = F.when(F.col("family").startswith("splice"), "splice").otherwise(F.col("family"))
    hits = scans.motif_hits(seqs).groupBy(kinds.alias("kind")).agg(F.count("*").alias("hits"))
    return hits.unionByName(scans.cpg_islands(seqs).agg(F.count("*").alias("hits")).select(F.lit("cpg_island").alias("kind"), "hits"))


def biomarkers(seqs: DataFrame, labelled: bool) -> DataFrame:
    """kind, label, kmer, value: discriminative k-mers with their fold if there are labels (column label), else conserved motifs with their score."""
    if labelled:
        found = scans.discriminative_kmers(seqs)
        return found.select(F.lit("discriminative_kmers").alias("kind"), "label", "kmer", F.col("fold").alias("value"))
    found = scans.conserved_motifs(seqs)
    return found.select(F.lit("conserved_motifs").alias("kind"), F.lit(None).cast("string").alias("label"), "kmer", F.col("score").alias("value"))


ANALYSES = ("gene_discovery", "mutation_analysis", "drug_targets", "pathogen_detection", "motif_analysis", "biomarker_generation", "evolutionary_analysis")


def comprehensive(seqs: DataFrame, config: dict[str, bool] | None = None, min_length: int = 300) -> DataFrame:
    """analysis, metric, value of the analyses that ``config`` asks for; none or an empty one asks for all."""
    wanted = [a for a in ANALYSES if not config or config.get(a, True)]
    long = lambda df, analysis, cols: df.select(F.explode(F.array(*[F.struct(F.lit(analysis).alias("analysis"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select("x.*")
    counted = lambda df, analysis, key, n: df.select(F.lit(analysis).alias("analysis"), F.col(key).alias("metric"), F.col(n).cast("double").alias("value"))
    made = {
        "gene_discovery": lambda: long(gene_totals(seqs, min_length), "gene_discovery", ["orfs", "kept", "long", "mean_length"]),
        "mutation_analysis": lambda: long(mutation_totals(seqs), "mutation_analysis", ["snvs", "indels", "oncogenic", "mutation_rate"]),
        "drug_targets": lambda: long(drug_totals(seqs), "drug_targets", ["enzyme_sites", "druggable"]),
        "pathogen_detection": lambda: counted(pathogen_signatures(seqs).groupBy("kind").count(), "pathogen_detection", "kind", "count"),
        "motif_analysis": lambda: counted(motif_totals(seqs), "motif_analysis", "kind", "hits"),
        "biomarker_generation": lambda: counted(biomarkers(seqs, False).groupBy("kind").count(), "biomarker_generation", "kind", "count"),
        "evolutionary_analysis": lambda: long(_evolution(seqs), "evolutionary_analysis", ["mean_bias", "mean_gc"]),
    }

    out = None
    for a in wanted:
        one = made[a]()
        out = one if out is None else out.unionByName(one)
    return out


def _evolution(seqs: DataFrame) -> DataFrame:
    from helixframe.operators.features import evolution_features

    return evolution_features(seqs).agg(F.avg("bias_score").alias("mean_bias"), F.avg("gc").alias("mean_gc"))


def chunks(seqs: DataFrame, size: int = BATCH_LETTERS) -> DataFrame:
    """seq_idx, chunk (from 1; null if not cut), sequence: sequences over ``size`` letters are cut."""
    n = F.length("sequence")
    at = F.when(n > size, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array(F.lit(0)))
    rows = seqs.select("seq_idx", (n > size).alias("large"), F.col("sequence").alias("s"), F.explode(at).alias("k"))
    return rows.select("seq_idx", F.when(F.col("large"), F.col("k") + 1).alias("chunk"), F.substring(F.col("s"), F.col("k") * size + 1, F.lit(size)).alias("sequence"))


def _leaps(n: np.ndarray, many: int, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, taken as a batch's start, the next start and the batches up to it (a large sequence has one a chunk)."""
    ends = np.r_[0, np.cumsum(n)]
    at, large = np.arange(len(n)), n > letters
    next_large = np.minimum.accumulate(np.where(large, at, len(n))[::-1])[::-1]
    to = np.minimum(np.minimum(np.searchsorted(ends, ends[:-1] + letters, "right") - 1, at + many), next_large)
    return np.where(large, at + 1, to), np.where(large, -(-n // letters), 1)


def greedy_batches(seqs: DataFrame, many: int = BATCH_SEQUENCES, letters: int = BATCH_LETTERS) -> DataFrame:
    """seq_idx, chunk, batch: whole sequences in order of seq_idx, a new batch before ``many`` or ``letters`` are
    passed; each chunk of a large sequence is a batch of its own.

    The rule is sequential, but a batch spans at most ``many`` places. So a range of places maps each of the ``many`` places at
    which its first batch may start to that of the next range and to the batches between. These maps are joined to those of ever
    longer runs of ranges, which gives every range its first start and its first number; then each range numbers its own rows.
    Only ids and lengths move. A null sequence counts as empty; sequences of one id follow by length.
    """
    size = max(RANGE, many)
    rows = seqs.select(F.col("seq_idx").cast("long").alias("seq_idx"), F.coalesce(F.length("sequence"), F.lit(0)).cast("long").alias("n"), F.monotonically_increasing_id().alias("k"))
    placed = ordered.running(rows, ["seq_idx", "n", "k"]).drop("k")
    spread = stored(ordered.blocks(placed, size, after=many))

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        block = int(group["block"].iloc[0])
        to, cost = _leaps(group["n"].to_numpy(np.int64), many, letters)
        own = int((group["at"] // size == block).sum())
        # Places from the end of the range on stay; every round doubles the batches followed.
        to, cost = np.r_[to[:own], np.arange(own, len(group) + 1)], np.r_[cost[:own], np.zeros(len(group) + 1 - own, np.int64)]
        for _ in range(own.bit_length()):
            to, cost = to[to], cost + cost[to]
        first = np.arange(min(many, own))
        return pd.DataFrame({"block": block, "first": first, "next": to[first] - own, "batches": cost[first]})

    leap = spread.groupBy("block").applyInPandas(follow, "block long, first long, next long, batches long")
    spark = seqs.sparkSession
    ranges = (placed.agg(F.max("at")).first()[0] or 0) // size + 1
    known, run = spark.createDataFrame([(0, 0, 0)], "block long, first long, number long"), 1
    leap = stored(leap) if ranges > 1 else leap
    while run < ranges:
        ahead = known.join(leap, ["block", "first"]).select((F.col("block") + run).alias("block"), F.col("next").alias("first"), (F.col("number") + F.col("batches")).alias("number"))
        known = stored(known.unionByName(ahead))
        after = leap.select((F.col("block") - run).alias("block"), F.col("first").alias("next"), F.col("next").alias("then"), F.col("batches").alias("more"))
        leap = stored(leap.join(after, ["block", "next"]).select("block", "first", F.col("then").alias("next"), (F.col("batches") + F.col("more")).alias("batches")))
        run *= 2

    def number(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        block, at, batch = (int(group[c].iloc[0]) for c in ("block", "first", "number"))
        n = group["n"].to_numpy(np.int64)
        to, cost = _leaps(n, many, letters)
        own = int((group["at"] // size == block).sum())
        out = np.full(own, batch - 1)
        while at < own:
            out[at : to[at]] = batch
            at, batch = int(to[at]), batch + int(cost[at])
        ids, n = group["seq_idx"].to_numpy()[:own], n[:own]
        chunks = np.where(n > letters, -(-n // letters), 1)
        row = np.repeat(np.arange(own), chunks)
        nth = np.arange(len(row)) - (np.cumsum(chunks) - chunks)[row]
        chunk = pd.array(nth + 1, "Int64")
        chunk[n[row] <= letters] = pd.NA
        return pd.DataFrame({"seq_idx": ids[row], "chunk": chunk, "batch": out[row] + nth})

    return spread.join(known, "block").groupBy("block").applyInPandas(number, "seq_idx long, chunk long, batch long")


def batch_rollup(seqs: DataFrame, min_length: int = 300, many: int = BATCH_SEQUENCES, letters: int = BATCH_LETTERS) -> DataFrame:
    """metric, value over the batches: ORFs, genes by each batch's own minimum, long genes (1000 on), their mean length, signatures, motifs."""
    placed = stored(greedy_batches(seqs, many, letters).select("seq_idx", F.coalesce("chunk", F.lit(0)).alias("chunk"), "batch"))
    rows = chunks(seqs, letters).withColumn("chunk", F.coalesce("chunk", F.lit(0))).join(placed, ["seq_idx", "chunk"])
    n = F.length("sequence")
    least = rows.groupBy("batch").agg(F.sum(n).alias("t"), F.avg(n).alias("m"))
    least = least.select("batch", F.when(F.col("t") < 50_000, F.greatest(F.lit(60), (F.col("m") * 0.3).cast("int"))).otherwise(min_length).alias("min_length"))
    keyed = rows.select(F.struct("batch", "seq_idx", "chunk").alias("seq_idx"), "sequence")
    # Batches hold a bounded number of letters, so that their ORFs are evenly dealt.
    found = scans.orfs(scans.frames(keyed), "strand", text=False).select(F.col("seq_idx.batch").alias("batch"), "orf_length").join(least, "batch")
    kept = F.col("orf_length") >= F.col("min_length")
    genes = found.agg(
        F.count("*").alias("total_orfs_found"), F.count_if(kept).alias("protein_coding_orfs"), F.count_if(kept & (F.col("orf_length") >= 1000)).alias("long_orfs"),
        F.coalesce(F.avg(F.when(kept, F.col("orf_length"))), F.lit(0.0)).alias("average_orf_length"),
    )
    total = placed.agg((F.max("batch") + 1).alias("batches"), F.count_if(F.col("chunk") > 0).alias("chunks"))
    one = genes.crossJoin(total)
    cols = one.columns
    wide = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")).select("x.*")
    signs = pathogen_signatures(keyed).where("kind <> 'pathogenicity'").groupBy("kind").count()
    motifs = motif_totals(keyed)
    return wide.unionByName(signs.select(F.concat(F.lit("total_"), "kind").alias("metric"), F.col("count").cast("double").alias("value"))).unionByName(
        motifs.select(F.concat(F.lit("total_"), "kind").alias("metric"), F.col("hits").cast("double").alias("value"))
    )


def grade(high: Column, moderate: Column) -> Column:
    return F.when(high, "HIGH").when(moderate, "MODERATE").otherwise("LOW")


def insights(counts: DataFrame) -> DataFrame:
    """Labels from one row of counts: virulence, resistance, druggable, enzyme_sites, promoters, enhancers, tf_sites,
    discriminative, frequent_motifs, oncogenic, snvs."""
    c = F.col
    return counts.select(
        grade((c("virulence") > 5) & (c("resistance") > 3), (c("virulence") > 2) | (c("resistance") > 1)).alias("outbreak_potential"),
        grade((c("druggable") > 3) & (c("enzyme_sites") > 2), (c("druggable") > 1) | (c("enzyme_sites") > 0)).alias("therapeutic_potential"),
        F.least((c("promoters") * 3 + c("enhancers") * 2 + c("tf_sites")) / 10, F.lit(10.0)).alias("regulatory_potential"),
        grade(c("discriminative") > 20, c("discriminative") > 10).alias("discriminative_power"),
        grade(c("frequent_motifs") > 5, c("frequent_motifs") > 2).alias("clinical_applicability"),
        F.when(c("snvs") == 0, 0.0).otherwise(F.least(c("oncogenic") * 100 / F.greatest(c("snvs"), F.lit(1)), F.lit(100.0))).alias("pathogenic_potential"),
    )


def insight_counts(analysis: DataFrame) -> DataFrame:
    """The row that ``insights`` takes, from what ``comprehensive`` found; analyses that were not asked for count as 0."""
    of = {
        "virulence": ("pathogen_detection", "pathogenicity"), "resistance": ("pathogen_detection", "resistance"), "druggable": ("drug_targets", "druggable"), "enzyme_sites": ("drug_targets", "enzyme_sites"),
        "promoters": ("motif_analysis", "promoter"), "enhancers": ("motif_analysis", "enhancer"), "tf_sites": ("motif_analysis", "tf_site"), "discriminative": ("biomarker_generation", "discriminative_kmers"),
        "frequent_motifs": ("biomarker_generation", "conserved_motifs"), "oncogenic": ("mutation_analysis", "oncogenic"), "snvs": ("mutation_analysis", "snvs"),
    }
    return analysis.agg(*[F.coalesce(F.sum(F.when((F.col("analysis") == a) & (F.col("metric") == m), F.col("value"))), F.lit(0.0)).alias(n) for n, (a, m) in of.items()])
