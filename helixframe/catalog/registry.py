"""The registered queries: name to function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.catalog.base import NUMBERS, PART, QUERIES, load, query, r6, reference, seqs  # noqa: F401
from helixframe.functions import protein as P
from helixframe.functions import sequence as S
from helixframe.ml import models as M
from helixframe.operators import metrics, prep, profile, relational, scans

@query
def motif_counts(spark, d):
    hits = scans.motif_hits(seqs(spark, d))
    return hits.groupBy("family", "motif").agg(F.count("*").alias("hits"), F.count_distinct("seq_idx").alias("sequences"))


@query
def motif_positions(spark, d):
    return scans.motif_hits(seqs(spark, d)).groupBy("family", "motif", "position").agg(F.count("*").alias("hits"))


@query
def oncogenic_hits(spark, d):
    from helixframe.constants import ONCOGENIC

    return scans.motif_hits(seqs(spark, d), ONCOGENIC, upper=False).select("seq_idx", "motif", "position", "score")


@query
def promoter_strength(spark, d):
    return scans.promoters(seqs(spark, d))


@query
def cpg_islands(spark, d):
    return scans.cpg_islands(seqs(spark, d)).select("seq_idx", "start", "end", r6(F.col("gc"), "gc"), r6(F.col("cpg"), "cpg"), r6(F.col("methylation"), "methylation"))


@query
def orf_all(spark, d):
    o = scans.orfs(seqs(spark, d))
    return o.select("seq_idx", "start", "end", "orf_length", S.translate_from(F.col("orf")).alias("protein"), F.right(F.col("orf"), F.lit(3)).alias("stop"))


@query
def orf_six_frame(spark, d):
    return scans.orfs(scans.frames(seqs(spark, d)), "strand", text=False).groupBy("frame").agg(F.count("*").alias("orfs"), F.max("orf_length").alias("longest"))


@query
def gene_stats(spark, d):
    return scans.genes(seqs(spark, d), 60).groupBy("seq_idx").agg(
        F.count("*").alias("genes"), F.max("orf_length").alias("longest"), F.min("min_length").alias("min_length"), r6(F.max("coding_potential"), "coding")
    )


@query
def snv_vs_reference(spark, d):
    s = seqs(spark, d)
    return scans.snvs(s, reference(s)).groupBy("position", "ref", "alt").agg(F.count("*").alias("n"))


@query
def mutation_stats(spark, d):
    s = seqs(spark, d)
    n = scans.snvs(s, reference(s)).agg(F.count("*").alias("snvs"))
    return n.crossJoin(s.agg(F.sum(F.length("sequence")).alias("bases"))).select("snvs", r6(F.col("snvs") / F.col("bases"), "mutation_rate"))


@query
def tail_indels(spark, d):
    s = seqs(spark, d).withColumn("sequence", F.expr("substr(sequence, 1, 200 + cast(seq_idx % 56 as int))"))
    return scans.tail_indels(s, reference(s.where("seq_idx > 10")))


@query
def bacterial_signatures(spark, d):
    return scans.bacterial_signatures(seqs(spark, d))


@query
def viral_signatures(spark, d):
    return scans.viral_signatures(seqs(spark, d))


@query
def resistance_genes(spark, d):
    return scans.resistance_genes(seqs(spark, d))


@query
def pathogenicity_factors(spark, d):
    return scans.pathogenicity_factors(seqs(spark, d))


@query
def enzyme_sites(spark, d):
    return scans.enzyme_sites(seqs(spark, d))


@query
def druggable_proteins(spark, d):
    return scans.drug_proteins(seqs(spark, d)).select("seq_idx", "frame", r6(F.col("score"), "score"), "druggable")


@query
def top_targets(spark, d):
    return scans.top_targets(seqs(spark, d)).select("seq_idx", "frame", r6(F.col("score"), "score"))


@query
def composition(spark, d):
    chars = seqs(spark, d).select(F.explode(S.letters(F.col("sequence"))).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    total = chars.agg(F.sum("n").alias("total"))
    return chars.crossJoin(F.broadcast(total)).select("letter", "n", r6(F.col("n") * 100 / F.col("total"), "percentage"))


@query
def gc_stats(spark, d):
    """Over the first 1000 sequences, which is the feature; deviation is that of the population."""
    g = seqs(spark, d).where("seq_idx < 1000").select((S.gc_unambiguous(F.col("sequence")) * 100).alias("gc"))
    return g.agg(r6(F.avg("gc"), "mean"), r6(F.stddev_pop("gc"), "std"), r6(F.min("gc"), "min"), r6(F.max("gc"), "max"))


@query
def length_stats(spark, d):
    """Lengths of the documents; the median is the upper one, taken by rank over counted lengths."""
    n = load(spark, d, "documents").select(F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    s = n.agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"), F.expr("percentile_disc(0.5) within group (order by n desc)").alias("upper_median"))
    return s.select("rows", "total", r6(F.col("mean"), "mean"), "min", "max", F.col("upper_median").cast("long").alias("upper_median"))


@query
def sequence_features(spark, d):
    s = F.col("sequence")
    return seqs(spark, d).select(
        "seq_idx", r6(S.gc_length(s), "gc"), r6(S.gc_unambiguous(s), "gc_unambiguous"),
        *[r6(S.share(s, x), f"share_{x.lower()}") for x in "ATCG"],
        r6((S.share(s, "A") + S.share(s, "T")) / (S.share(s, "G") + S.share(s, "C") + 0.001), "at_gc_ratio"),
        r6(S.entropy(s), "entropy"), r6(S.purine_ratio(s), "purine_ratio"), r6(S.melting(s), "melting"),
        r6(S.repeat_score(s), "repeat_score"), r6(S.cpg_score(s), "cpg_score"), r6(S.periodicity(s), "periodicity"),
        r6(F.log10(F.greatest(F.length(s), F.lit(1))) / 6, "log_length"), r6(S.coding_potential(s), "coding_potential"),
    )


@query
def dinucleotide_freq(spark, d):
    s, n = F.col("sequence"), F.greatest(F.lit(1), F.length("sequence") - 1)
    pairs = [a + b for a in "ATGC" for b in "ATGC"]
    rows = F.array(*[F.struct(F.lit(p).alias("pair"), (S.occurrences(s, p) / n).alias("freq")) for p in pairs])
    return seqs(spark, d).select("seq_idx", F.explode(rows).alias("x")).select("seq_idx", "x.pair", r6(F.col("x.freq"), "freq"))


@query
def reverse_complements(spark, d):
    return seqs(spark, d).select("seq_idx", S.reverse_complement(F.col("sequence")).alias("reverse_complement"))


@query
def six_frame_proteins(spark, d):
    return scans.six_frame_proteins(seqs(spark, d)).drop("n")


@query
def protein_features(spark, d):
    p = F.col("protein")
    return scans.six_frame_proteins(seqs(spark, d)).where("frame = 1").select(
        "seq_idx", P.approximate_weight(p).cast("long").alias("weight"), r6(P.hydrophobicity(p), "hydrophobicity"), r6(P.net_charge(p), "net_charge"), r6(P.secondary_structure(p), "secondary")
    )


@query
def codon_usage(spark, d):
    c = seqs(spark, d).select("seq_idx", F.explode(S.codons(F.col("sequence"))).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("codon", "n", r6(F.col("n") / F.col("t"), "freq"))


@query
def substitution_patterns(spark, d):
    s, n = F.col("sequence"), F.greatest(F.length("sequence") - 1, F.lit(1))
    many = lambda ps: sum((S.occurrences(s, p) for p in ps[1:]), S.occurrences(s, ps[0]))
    return seqs(spark, d).select(
        "seq_idx", r6(many(["AG", "GA", "CT", "TC"]) / n, "transitions"),
        r6(many(["AC", "CA", "AT", "TA", "GC", "CG", "GT", "TG"]) / n, "transversions"), S.occurrences(s, "CG").cast("long").alias("cpg_sites"),
    )


@query
def selection_pressure(spark, d):
    n = F.length("sequence")
    six = S.words(F.col("sequence"), 6)
    ratio = F.when(n <= 5, 0.0).otherwise(F.size(F.array_distinct(six)) / F.least(F.lit(4096), F.greatest(n - 5, F.lit(1))))
    return seqs(spark, d).select("seq_idx", r6(S.gc_unambiguous(F.col("sequence")), "gc"), r6(ratio, "complexity"))


@query
def sequence_types(spark, d):
    t = load(spark, d, "documents").select("doc_id", S.sequence_type(F.coalesce("text", F.lit(""))).alias("of_text"))
    return t.join(seqs(spark, d).select(F.col("seq_idx").alias("doc_id"), S.sequence_type(F.col("sequence")).alias("of_bases")), "doc_id")


@query
def header_labels(spark, d):
    h = F.concat_ws("_", F.lit("seq"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, ["affected", "unaffected", "normal", "wildtype", "x1"])), (F.col("doc_id") % 5 + 1).cast("int")))
    return load(spark, d, "documents").select("doc_id", S.header_label(h).alias("label"), S.header_label(h, strict=True).alias("strict_label"))


@query
def sequence_quality(spark, d):
    s = F.translate(F.coalesce(F.col("text"), F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    n = F.length(s)
    known = S.count_of(s, "ATCGURYSWKMBDHVN-")
    one = load(spark, d, "documents").select(S.count_of(s, "NRYSWKMBDHV").alias("amb"), S.count_of(s, "-").alias("gaps"), (n - known).alias("bad"), n.alias("n"))
    return one.agg(
        F.sum("amb").alias("ambiguous"), F.count_if(F.col("amb") > 0).alias("with_ambiguous"), F.sum("gaps").alias("gaps"), F.sum("bad").alias("invalid"),
        F.count_if(F.col("n") < 50).alias("short"), F.count_if(F.col("n") == 0).alias("empty"),
        F.count_if((F.col("n") > 0) & (F.col("gaps") * 2 > F.col("n"))).alias("mostly_gaps"),
    )


@query
def kmer_freq(spark, d):
    return scans.kmer_frequencies(seqs(spark, d), 3).select("seq_idx", "kmer", "count", r6(F.col("freq"), "freq"))


@query
def kmer_vocab_topn(spark, d):
    return scans.top_kmers(seqs(spark, d), (3, 4, 5, 6), 100).select("k", "kmer", "count", F.col("rank").cast("long").alias("rank"))


@query
def discriminative_kmers(spark, d):
    lab = load(spark, d, "labels").select(F.col("doc_id").alias("seq_idx"), F.col("quality").cast("string").alias("label"))
    out = scans.discriminative_kmers(seqs(spark, d).join(lab, "seq_idx"), fold=1.05)
    return out.select("label", "k", "kmer", r6(F.col("freq"), "freq"), r6(F.col("fold"), "fold"))


@query
def conserved_motifs(spark, d):
    out = scans.conserved_motifs(seqs(spark, d), least=0.0)
    return out.select("k", "kmer", "count", F.round("freq", 9).alias("freq"), F.round("score", 9).alias("score"))


@query
def integer_encode(spark, d):
    e = prep.integer_encode(seqs(spark, d), "sequence", 300)
    return e.select("seq_idx", F.posexplode("codes").alias("pos", "code")).groupBy("pos", "code").agg(F.count("*").alias("n"))


@query
def one_hot(spark, d):
    e = prep.one_hot(seqs(spark, d), "sequence", 256)
    return e.select(F.posexplode("one_hot").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("n"))


@query
def pad_truncate(spark, d):
    return seqs(spark, d).select("seq_idx", S.pad(F.col("sequence"), 300).alias("padded"), S.pad(F.concat(F.col("sequence"), F.lit("Q")), 100).alias("cut"))


@query
def column_profile(spark, d):
    p = profile.column_profile(load(spark, d, "lineitem"), NUMBERS)
    return p.select("column", "n", "missing", "distinct", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "q25", "q50", "q75")])


@query
def distribution_shape(spark, d):
    return profile.distribution_shape(load(spark, d, "lineitem"), NUMBERS).select("column", r6(F.col("skew"), "skew"), r6(F.col("kurt"), "kurt"), "shape")


@query
def iqr_outliers(spark, d):
    return profile.iqr_outliers(load(spark, d, "customer"), ["c_acctbal"]).unionByName(profile.iqr_outliers(load(spark, d, "events"), ["value"])).select("column", "outliers", r6(F.col("percentage"), "percentage"))


@query
def correlation_pairs(spark, d):
    return profile.correlations(load(spark, d, "lineitem"), NUMBERS).select("a", "b", r6(F.col("r"), "r"), (F.abs("r") > 0.7).alias("strong"))


@query
def feature_relationships(spark, d):
    return profile.feature_relationships(load(spark, d, "lineitem"), NUMBERS).select("a", "strongest_positive", "strongest_negative", r6(F.col("mean_strength"), "mean_strength"))


@query
def quality_numeric(spark, d):
    return profile.quality_numeric(load(spark, d, "customer"), ["c_acctbal", "c_nationkey"]).select("column", r6(F.col("mean"), "mean"), r6(F.col("median"), "median"), r6(F.col("std"), "std"), "distinct", "outliers")


@query
def quality_categorical(spark, d):
    return profile.quality_categorical(load(spark, d, "customer"), ["c_mktsegment"]).unionByName(profile.quality_categorical(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query
def duplicate_rows(spark, d):
    return profile.duplicate_rows(load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query
def quality_score(spark, d):
    return profile.quality_score(load(spark, d, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment"), ["c_acctbal", "c_nationkey"])


@query
def value_histogram(spark, d):
    return profile.histogram(load(spark, d, "lineitem"), "l_extendedprice")


def gappy(spark, d):
    """events with nulls in value at every seventh id."""
    return load(spark, d, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


@query
def impute_mean(spark, d):
    return prep.impute(gappy(spark, d), ["value"], "mean").select("event_id", F.round("value", 4).alias("value"))


@query
def impute_median(spark, d):
    return prep.impute(gappy(spark, d), ["value"], "median").select("event_id", F.round("value", 4).alias("value"))


@query
def impute_mode(spark, d):
    e = gappy(spark, d).withColumn("event_type", F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    return prep.impute(e, ["event_type"], "mode").groupBy("event_type").agg(F.count("*").alias("n"))


@query
def forward_fill(spark, d):
    return prep.forward_fill(gappy(spark, d), "value", "event_id", "user_id").select("event_id", "value")


@query
def drop_sparse_rows(spark, d):
    e = gappy(spark, d).withColumn("event_type", F.when(F.col("event_id") % 14 != 0, F.col("event_type"))).select("event_type", "value", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id"))
    return prep.drop_sparse(e, 0.5).agg(F.count("*").alias("rows"), F.count("value").alias("known"))


def _scaled(spark, d, how):
    return prep.scale(load(spark, d, "part").select("p_partkey", *PART), PART, how).select("p_partkey", *[r6(F.col(c), c) for c in PART])


@query
def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@query
def scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


@query
def polynomial_features(spark, d):
    p = prep.polynomial(load(spark, d, "part").select("p_partkey", *PART), PART)
    return p.select("p_partkey", *[F.round(c, 2).alias(c) for c in p.columns if c.startswith("poly_")])


@query
def interaction_features(spark, d):
    p = prep.interactions(load(spark, d, "part").select("p_partkey", *PART), PART)
    return p.select("p_partkey", F.round("p_size_x_p_retailprice", 2).alias("p_size_x_p_retailprice"))


@query
def log_features(spark, d):
    p = prep.log_transform(load(spark, d, "part").select("p_partkey", *PART), PART)
    return p.select("p_partkey", *[r6(F.col(f"log_{c}"), f"log_{c}") for c in PART])


@query
def remove_outliers_iqr(spark, d):
    cols = ["l_extendedprice", "l_quantity"]
    return prep.remove_outliers_iqr(load(spark, d, "lineitem"), cols).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 0).alias("total"))


@query
def remove_outliers_z(spark, d):
    e = load(spark, d, "events")
    return prep.remove_outliers_z(e, ["value"], 2.0).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def anova_f(spark, d):
    e = load(spark, d, "embeddings")
    n = len(e.select("embedding").first()[0])
    wide = e.select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])
    return prep.anova_f(wide, [f"e{i}" for i in range(n)], "label").select("feature", F.round("f_score", 4).alias("f_score"))


@query
def label_encode(spark, d):
    return prep.label_encode(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", F.col("code").cast("long").alias("code"))


@query
def stratified_split(spark, d):
    return prep.stratified_split(load(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")


def predicted(spark, d):
    """labels with a deterministic score and prediction."""
    score = F.expr("cast(conv(substr(md5(cast(doc_id as string)), 1, 4), 16, 10) as double)") / 65536
    lab = load(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), F.round(score, 2).alias("score"))
    return lab.withColumn("prediction", (F.col("score") >= 0.4).cast("int"))


@query
def confusion(spark, d):
    return metrics.confusion(predicted(spark, d))


@query
def weighted_scores(spark, d):
    w = metrics.weighted_scores(predicted(spark, d))
    return w.select(*[r6(F.col(c), c) for c in w.columns])


@query
def roc_points(spark, d):
    return metrics.roc_points(predicted(spark, d)).select("score", r6(F.col("tpr"), "tpr"), r6(F.col("fpr"), "fpr"))


@query
def roc_auc(spark, d):
    return metrics.auc(predicted(spark, d)).select(r6(F.col("auc"), "auc"))


@query
def regression_scores(spark, d):
    x = load(spark, d, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1000).alias("prediction"))
    w = metrics.regression_scores(x)
    return w.select(*[F.round(c, 4).alias(c) for c in w.columns])


@query
def knn_predict(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return metrics.knn_predict(e, e.where("id % 50 = 0")).select("q", "prediction")


@query
def visible_page(spark, d):
    o = load(spark, d, "orders")
    v = relational.visible(o, F.col("o_custkey") % 10 == 1, F.col("o_orderstatus") == "F", o_orderpriority="1-URGENT")
    return relational.page(v, "o_totalprice", "asc", 20, 50, tie="o_orderkey").select("o_orderkey", "o_totalprice")


@query
def status_counts(spark, d):
    return relational.status_counts(load(spark, d, "orders"), "o_orderstatus", {"completed": ["F"], "active": ["O", "P"], "failed": ["X"]})


@query
def job_stats(spark, d):
    w = relational.job_stats(load(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice")
    return w.select("o_custkey", "jobs", "done", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"))


@query
def best_by_group(spark, d):
    return relational.best_by(load(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey")


#: Datasets of different sizes, widths and classes: the rows of each return flag and quantity.
def datasets(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(
        F.count("*").alias("rows"), F.count_distinct("l_suppkey").alias("features"), F.count_distinct(F.col("l_linenumber") * (F.col("l_quantity") % 3)).alias("classes")
    )
    task = F.when(F.col("l_quantity") % 3 == 0, "protein_classification").otherwise("general")
    return rows.select(F.concat_ws("-", "l_returnflag", F.col("l_quantity").cast("int")).alias("name"), (F.col("rows") * F.col("l_quantity").cast("int")).alias("rows"), "features", "classes", task.alias("task"))


@query
def model_ranking(spark, d):
    names = ["random_forest", "xgboost", "gradient_boosting", "svm", "logistic_regression", "knn", "naive_bayes"]
    return M.ranked(datasets(spark, d), names)


@query
def rf_classify(spark, d):
    rows = M.embedded(load(spark, d, "embeddings"))
    model = M.pipeline(M.classifier("random_forest", classes=10).setNumTrees(20).setMaxDepth(6)).fit(rows)
    return model.transform(rows).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query
def logistic_regression(spark, d):
    rows = M.embedded(load(spark, d, "embeddings"))
    model = M.pipeline(M.classifier("logistic_regression", n=500)).fit(rows)
    return model.transform(rows).select("id", "label", "prediction")


@query
def kmeans(spark, d):
    return M.clusters(M.embedded(load(spark, d, "embeddings")), 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query
def pca(spark, d):
    return M.principal_components(M.embedded(load(spark, d, "embeddings")), 2).select("id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))
