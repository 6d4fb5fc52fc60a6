"""Splits, reports, validators and sinks against plain computations."""

import hashlib
from collections import Counter
from math import ceil

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from helixframe.functions import protein as P
from helixframe.ml import models as M
from helixframe.ml import training
from helixframe.operators import discovery, features, metrics, prep, profile, validation
from helixframe.sources import sinks


def plain_split(rows, test=0.2, validation=0.1):
    total = len(rows)
    if 0 < total < 20:
        test, validation = min(0.2, max(0.1, 2 / total)), min(0.1, max(0.05, 1 / total))
    order = lambda some: sorted(some, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    counts = Counter(label for _, label in rows)
    apart = min(counts.values()) >= 2
    groups = [order([r for r in rows if r[1] == k]) for k in counts] if apart else [order(rows)]
    out, rest = {}, []
    for g in groups:
        n = ceil(len(g) * test)
        out |= {i: "test" for i, _ in g[:n]}
        rest.append(g[n:])
    if not (apart and min(map(len, rest)) >= 2):
        rest = [order([r for g in rest for r in g])]
    for g in rest:
        n = ceil(len(g) * (validation / (1 - test)))
        out |= {i: "validation" for i, _ in g[:n]} | {i: "train" for i, _ in g[n:]}
    return out


@pytest.mark.parametrize("sizes", [[70, 50, None, 30], [12, 3, 2], [5, 4], [8, 1], [90, 2], [1]])
def test_splits_follow_the_rules_of_small_sets(spark, sizes):
    labels = [("abcd"[k], n) for k, n in enumerate(sizes) if n] + ([(None, 9)] if None in sizes else [])
    rows = list(enumerate(label for label, n in labels for _ in range(n)))
    frame = spark.createDataFrame([(i, label, "z") for i, label in rows], "id long, label string, n string").repartition(3)
    got = prep.three_way_split(frame, "id", "label")
    assert got.columns == ["id", "label", "n", "part"] and {r["id"]: r["part"] for r in got.collect()} == plain_split(rows)
    assert prep.three_way_split(frame.limit(0), "id", "label").count() == 0


def test_rollup_reads_the_table_once_and_counts_right(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, 1.0, None), (3, 1.0, None), (4, 2.5, None)], "id long, x double, t string")
    got = validation.missing_rollup(rows).first()
    assert tuple(got) == (4, pytest.approx(100.0), 4)
    q = {r["column"]: r for r in profile.quality_numeric(rows, ["x", "id"]).collect()}
    assert (q["x"]["median"], q["x"]["distinct"], q["id"]["median"]) == (1.0, 2, 2.5)


def test_four_validators():
    good = {"dataset_type": "dna", "name": "x", "max_file_size": 5}
    assert validation.dataset_config(good) == ([], [])
    errors, warnings = validation.dataset_config({"dataset_type": "cats", "name": "", "description": "d" * 1001, "max_file_size": -1})
    assert len(errors) == 3 and len(warnings) == 1 and len(validation.dataset_config({"name": "n" * 256})[0]) == 2
    assert validation.model_config({"model_type": "regression", "algorithm": "svm", "test_size": 0.3, "cv_folds": 5, "target_column": "y"}) == []
    bad = {"model_type": "x", "algorithm": "random_forest", "hyperparameters": {"n_estimators": 0, "max_depth": "deep"}, "test_size": 1, "cv_folds": 1, "target_column": ""}
    assert len(validation.model_config(bad)) == 6 and validation.model_config({"algorithm": "y", "hyperparameters": []})[0] == "Missing required field: model_type"
    assert validation.upload_errors("a.FASTA", 10, ("fasta",)) == [] and len(validation.upload_errors(" ", 0, ("fasta",))) == 3 and len(validation.upload_errors("a.exe", 200 << 20, ("csv",), 100)) == 2


def test_json_bodies_against_a_schema(spark):
    texts = ['{"a": 1, "b": ["x"]}', '{"a": 1}', '{"b": []}', '{"a": "one"}', "[1]", "", None, '{"a": 1, "more": true}', '{"a": 1, "b": 3}']
    got = [r["fault"] for r in validation.json_errors(spark.createDataFrame(list(enumerate(texts)), "id long, body string"), "body", "a int not null, b array<string>").orderBy("id").collect()]
    assert [g is None for g in got] == [True, True, False, False, False, False, False, True, False]
    assert got[2] == "missing: a" and got[3].startswith("of another kind") and got[4] == got[5] == got[6] == "no JSON object"


def test_insights_are_fed_by_the_analysis(spark):
    rows = spark.createDataFrame([("pathogen_detection", "pathogenicity", 6.0), ("pathogen_detection", "resistance", 4.0), ("motif_analysis", "promoter", 9.0), ("drug_targets", "druggable", 2.0), ("mutation_analysis", "snvs", 50.0), ("mutation_analysis", "oncogenic", 5.0)], "analysis string, metric string, value double")
    one = discovery.insights(discovery.insight_counts(rows)).first()
    assert (one["outbreak_potential"], one["therapeutic_potential"], one["clinical_applicability"], one["regulatory_potential"], one["pathogenic_potential"]) == ("HIGH", "MODERATE", "LOW", 2.7, 10.0)


def test_protein_statistics_are_those_of_each_protein(spark):
    rows = spark.createDataFrame([(0, "MKKLD"), (1, "acdef"), (2, "MX"), (3, ""), (4, None), (500, "MMM")], "seq_idx long, sequence string")
    got = validation.protein_statistics(rows).first()
    each = rows.where("seq_idx < 2").select(P.molecular_weight(F.upper("sequence")).alias("m"), P.isoelectric_point(F.upper("sequence")).alias("p")).toPandas()
    assert got["mass_mean"] == pytest.approx(each["m"].mean()) and got["point_std"] == pytest.approx(each["p"].std(ddof=0)) and (got["point_min"], got["point_max"]) == (each["p"].min(), each["p"].max())
    none = validation.metadata(rows.limit(0), "protein", "x", 0).first()
    assert none["total_sequences"] == 0 and none["file_extension"] == "" and none["min_length"] is None


def test_stored_models_and_scores_come_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, float(i % 2), [float(i % 2) + rng.random(), rng.random()]) for i in range(60)], "id long, label double, embedding array<double>").withColumnRenamed("id", "vec_id")
    model = M.pipeline(M.classifier("decision_tree")).fit(data := M.embedded(rows))
    again = PipelineModel.load(sinks.save_model(model, str(tmp_path / "model")))
    assert [r["prediction"] for r in again.transform(data).orderBy("id").collect()] == [r["prediction"] for r in model.transform(data).orderBy("id").collect()]
    told = training.evaluate(model.transform(data).select("label", "prediction"))
    back = spark.read.json(sinks.save_metrics(told, str(tmp_path / "scores"))).first()
    assert back["accuracy"] == told.first()["accuracy"] == 1.0
    numbers = spark.createDataFrame([(float(i), float(i) + 0.5) for i in range(50)], "label double, prediction double")
    assert training.evaluate(numbers).columns == metrics.regression_scores(numbers).columns


def test_the_whole_feature_vector_equals_a_walk(spark):
    """All k-mer features beside the named ones, over sequences of several kinds."""
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (0, 2, 5, 40, 300, 300)] + ["acgtnnACGT", "AC-GT" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq_idx long, sequence string")
    words = features.vocabulary(rows, (3, 4, 5, 6), 100)
    got = {r["seq_idx"]: r["features"] for r in features.feature_table(rows, words).collect()}
    names = features.feature_names(words)
    assert len(names) == 419 and all(len(v) == 419 for v in got.values())
    every = {k: Counter(w for t in texts for i in range(len(t) - k + 1) if set(w := t.upper()[i : i + k]) <= set("ACGT")) for k in words}
    for k, chosen in words.items():
        assert chosen == sorted(every[k], key=lambda w: (-every[k][w], w))[:100]
        for i, t in enumerate(texts):
            own = Counter(w for j in range(len(t) - k + 1) if set(w := t.upper()[j : j + k]) <= set("ACGT"))
            total = max(1, sum(own.values()))
            want = [own[w] / total for w in chosen] + [0.0] * (100 - len(chosen))
            at = next(n for n, name in enumerate(names) if name.startswith(f"kmer_{k}_"))
            assert np.allclose(got[i][at : at + 100], want)
