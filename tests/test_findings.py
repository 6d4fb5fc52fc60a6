"""Small cases of what a review found."""

import math
import re

import duckdb
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from helixframe.catalog.base import seqs
from helixframe.catalog.oracles import ORACLES
from helixframe.functions import protein as P
from helixframe.functions import sequence as S
from helixframe.ml import models, search, training
from helixframe.operators import discovery, neighbours, scans


def test_sequence_types_count_letters_as_the_sql_does(spark):
    """A sharp s is one letter, in upper case too; so is every letter without a single upper-case one."""
    texts = [" Der Stein, weiß", "enteer Der weiß", "Gerẞß", "ŉacd", "ﬁACDE", "ıug", "éacg", "", " ", "acgu", "ac gt ", "ßACDEFGHIK", "acgtß"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = dict(con.execute(f"select doc_id, of_text from ({ORACLES['sequence_types']})").fetchall())
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["t"] for r in rows.select("doc_id", S.sequence_type(F.col("text")).alias("t")).collect()}
    assert got == want
    assert got[11] == "protein" and got[1] == "unknown"


def test_ridge_candidates_rank_by_exact_scores(spark):
    """The same rows in every fold: penalties then only lose, by less than sums of doubles tell."""
    rows = spark.range(30_000).select((F.col("id") % 3).cast("int").alias("k"), F.floor(F.col("id") / 3).alias("n"))
    rows = rows.select("k", (900.1 + F.col("n") % 200 / 7 + F.col("n") % 50 / 1000).alias("label"), array_to_vector(F.array((1 + F.col("n") % 50).cast("double"))).alias("raw"))
    for some in (rows, rows.repartition(7)):
        got = {(r["alpha"], r["fold"]): r for r in search.ridge_search(some, [1e-3, 1e-6, 1e-4, 0.0], F.col("k")).collect()}
        assert [got[a, 0]["rank"] for a in (0.0, 1e-6, 1e-4, 1e-3)] == [1, 2, 3, 4]
        assert len({r["score"] for r in got.values()}) <= 4 and len(got) == 12
    bad = rows.limit(1).select("k", F.lit(float("inf")).alias("label"), "raw")
    assert [r["score"] for r in search.ridge_search(rows.unionByName(bad), [0.0], F.col("k")).collect()] == pytest.approx([got[0.0, 0]["score"]] * 3)


def test_equal_rows_are_filled_from_one_search(spark):
    """Rows of few different features, with ties, gaps and zeros of both signs, against all pairs."""
    rows = [(i, [float(i % 7), None, 3.0, float("nan"), 0.0, -0.0][i % 6], float(i % 3), None if i % 5 == 0 else i * 1.5) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, v double")
    vector = F.array("a", "b")
    near = neighbours.nearest(df.where("v is not null").select("id", vector.alias("vector")), df.where("v is null").select(F.col("id").alias("q"), vector.alias("qv")), 4)
    want = {r["q"]: r["m"] for r in near.join(df, "id").groupBy("q").agg(F.avg("v").alias("m")).collect()}
    got = {r["id"]: r["v"] for r in neighbours.impute_nearest(df, "id", "v", ["a", "b"], 4).collect()}
    assert len(got) == 400 and got == {i: pytest.approx(want[i] if v is None else v) for i, _, _, v in rows}


def test_a_fill_looks_at_different_features_only(spark, monkeypatch):
    """Of 30,000 rows with 20 different values at most 20 queries and 100 rows are compared."""
    df = spark.range(30_000).select("id", (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("v"))
    seen, search_ = [], neighbours.nearest_pruned
    monkeypatch.setattr(neighbours, "nearest_pruned", lambda rows, queries, k: seen.append((rows.count(), queries.count())) or search_(rows, queries, k))
    assert neighbours.impute_nearest(df, "id", "v", ["x"]).where("v is null").isEmpty()
    assert seen and seen[0][0] <= 100 and seen[0][1] <= 20


def test_strands_are_translated_once_whatever_uses_the_protein(spark):
    """The translation stands in the plan once, and gives what the SQL function gives, for letters of all kinds."""
    texts = ["", "A", "ATGTAA", "atgnnnATGRYK", "AUGUUU", "ATG\u00e9\u1e9eAT\U0001f600GGC", None, "ATGCATGCATGA"]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq_idx long, sequence string")
    got = scans.six_frame_proteins(rows)
    want = scans.frames(rows).select("seq_idx", "n", "frame", S.translate_from(F.col("strand")).alias("protein"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    plan = scans.top_targets(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "regexp_extract_all" not in plan


def test_hits_go_on_before_a_batch_ends(spark):
    """A sequence of 90,000 hits is handed on in pieces; none is lost and regions are whole."""
    text = "GT" * 90_000
    rows = spark.createDataFrame([(0, text), (1, "ACGGTA"), (2, None)], "seq_idx long, sequence string").coalesce(1)
    one = (("splice_donor", "GT", "GT", 2, 0.5),)
    got = scans.motif_hits(rows, one).toPandas().sort_values(["seq_idx", "position"])
    assert got[got.seq_idx == 0]["position"].tolist() == [m.start() for m in re.finditer("GT", text)] and got[got.seq_idx == 1]["position"].tolist() == [3]
    assert got["region"].tolist()[:2] == [text[:100], text[:102]] and got["region"].tolist()[-1] == "ACGGTA"
    assert scans.HITS < 90_000


def test_points_look_at_letters_before_the_halvings(spark):
    """The counts stand in the plan once, not in each of the steps."""
    plan = spark.createDataFrame([("ACDK",)], "p string").select(P.isoelectric_point(F.col("p")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(p") <= 8


def test_fits_use_all_cores_on_a_table_of_one_file(spark, tmp_path, monkeypatch):
    """Rows of one partition are dealt to as many as there are cores, none lost, the same in every run."""
    e = spark.range(200).select(F.col("id").alias("vec_id"), (F.col("id") % 2).alias("label"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding")).coalesce(1)
    rows = models.embedded(e)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert sorted(r["id"] for r in rows.collect()) == list(range(200)) and rows.collect() == models.embedded(e).collect()
    seen, split = [], training.split
    monkeypatch.setattr(training, "split", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or split(rows, *a))
    training.one_click(e.select("vec_id", "label", F.col("embedding")[0].alias("x")), "label", "vec_id")
    assert seen[0] >= spark.sparkContext.defaultParallelism


def test_a_consensus_reads_its_predictions_once(spark):
    rows = spark.createDataFrame([("a", "x", [0.9, 0.1]), ("a", "y", [0.4, 0.6]), ("a", "y", None), ("b", "x", None)], "model string, prediction string, probability array<double>")
    got = training.consensus(rows)
    assert [tuple(r) for r in got.orderBy("model").collect()] == [("a", "y", 2, 0.75, "BIOLOGICALLY_DIVERSE"), ("b", "x", 1, None, "HOMOGENEOUS_PATTERN")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") + got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_orfs_go_on_before_a_batch_ends(spark):
    """Nested ORFs whose letters add up to many times the text are handed on in pieces; none is lost."""
    text = "ATG" * 4000 + "TAA"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "ATGTAG")], "seq_idx long, sequence string").coalesce(1)
    got = scans.orfs(rows)
    sizes = got.withColumn("n", F.length("orf")).groupBy("seq_idx").agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("end").alias("e"), F.sum("n").alias("s"), F.min(F.col("orf").endswith("TAA") | F.col("orf").endswith("TAG")).alias("ok"))
    assert [tuple(r) for r in sizes.orderBy("seq_idx").collect()] == [(1, 4000, 0, 12003, 3 * 4000 * 4001 // 2 + 12000, True), (3, 1, 0, 6, 6, True)]
    assert got.drop("orf").exceptAll(scans.orfs(rows, text=False)).isEmpty() and scans.LETTERS < 3 * 4000 * 4001 // 2


def test_word_counts_come_from_all_documents(spark):
    """A word of every document of 40 counts 40 times, not as often as a part of them holds it."""
    line_dedup = pytest.importorskip("helixframe.llm.line_dedup")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("one line of words").alias("text"))
    counts = line_dedup.word_counts(docs)
    want = 40 if line_dedup.RARE >= 40 else line_dedup.RARE + int(2 * math.log2(40))
    assert (counts > 0).any() and set(counts[counts > 0].tolist()) == {want}


def test_drug_targets_are_looked_for_in_all_sequences(spark):
    """Sites and druggable proteins of sequences from number 20 on count, and none are 0."""
    d = "/root/testdata/sf0.001"
    s = seqs(spark, d).where("seq_idx >= 20")
    want = scans.drug_proteins(s).agg(F.sum(F.size("sites")).alias("n"), F.count_if("druggable").alias("druggable")).first()
    got = {r["metric"]: r["value"] for r in discovery.comprehensive(s, dict.fromkeys(discovery.ANALYSES, False) | {"drug_targets": True}).collect()}
    assert got == {"enzyme_sites": want["n"], "druggable": want["druggable"]} and want["n"] > 0
    none = discovery.comprehensive(s.limit(0), dict.fromkeys(discovery.ANALYSES, False) | {"drug_targets": True}).collect()
    assert {r["metric"]: r["value"] for r in none} == {"enzyme_sites": 0, "druggable": 0}


def test_insights_count_drug_targets_of_all_sequences(spark):
    """The therapeutic label comes from sequences beyond the first twenty too."""
    s = seqs(spark, "/root/testdata/sf0.001").where("seq_idx >= 20")
    found = discovery.comprehensive(s, dict.fromkeys(discovery.ANALYSES, False) | {"drug_targets": True})
    assert discovery.insights(discovery.insight_counts(found)).first()["therapeutic_potential"] == "HIGH"
