"""Out-of-bag votes against stored draws, kernel features against the kernel, neighbours against all pairs, a network on held-out rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from helixframe.ml import explain, kernels, sequence_models, training
from helixframe.ml import models as M
from helixframe.ml.bagged import POISSON, BaggedForest, drawn

rng = np.random.default_rng(8)
X = rng.standard_normal((400, 3))
#: Inside and outside of a sphere, and a third class: no line parts them.
Y = (np.linalg.norm(X, axis=1) > 1.5).astype(int) + (X[:, 2] > 1.2)


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame([(i, float(k), x.tolist()) for i, (k, x) in enumerate(zip(Y, X))], "id long, label double, x array<double>")
    return frame.select("id", "label", array_to_vector("x").alias("raw")).repartition(4).cache()


def votes(tree, x):
    node = 0
    while tree.feature[node] >= 0:
        node = int(tree.left[node] if x[tree.feature[node]] <= tree.threshold[node] else tree.right[node])
    return tree.value[node]


@pytest.mark.parametrize("group", [1, 4])
def test_out_of_bag_answers_equal_a_recount_of_the_draws(rows, group):
    forest = BaggedForest(trees=6, group=group, depth=4, features="raw").fit(rows)
    draws = len(forest.models)
    assert draws == -(-6 // group) and sum(m.getNumTrees for m in forest.models) == 6
    weights = {r["id"]: r["w"] for r in rows.select("id", F.array(*[drawn("id", d) for d in range(draws)]).alias("w")).collect()}
    trees = [explain.ensemble(m).trees for m in forest.models]
    want = {}
    for i, w in weights.items():
        told = [votes(t, X[i]) for d in range(draws) if w[d] == 0 for t in trees[d]]
        if told:
            want[i] = np.sum(told, 0)
    got = {r["id"]: r for r in forest.unseen(rows).collect()}
    assert set(got) == set(want)
    for i, v in want.items():
        assert np.allclose(got[i]["probability"], v / v.sum()) and v[int(got[i]["prediction"])] >= v.max() - 1e-9
    score = forest.out_of_bag_score(rows).first()
    assert score["oob_score"] == pytest.approx(np.mean([got[i]["prediction"] == Y[i] for i in want])) and score["asked"] == len(want) and score["rows"] == 400
    assert {r["prediction"] for r in forest.predict(rows).collect()} == {0.0, 1.0, 2.0} and forest.importances().sum() == pytest.approx(1)


def test_draws_are_poisson(spark):
    counts = dict(spark.range(200_000).select(drawn("id", 3).alias("w")).groupBy("w").count().collect())
    for k in range(5):
        assert counts[k] / 200_000 == pytest.approx(POISSON[k] - (POISSON[k - 1] if k else 0), abs=0.004)


def test_a_missing_class_in_a_draw_keeps_its_place(spark):
    few = spark.createDataFrame([(i, float(i == 7) * 2 + float(i % 2) * (i != 7), [float(i)]) for i in range(8)], "id long, label double, x array<double>").select("id", "label", array_to_vector("x").alias("raw"))
    forest = BaggedForest(trees=6, group=1, depth=2, features="raw").fit(few)
    assert all(len(r["probability"]) == 3 and sum(r["probability"]) == pytest.approx(1) for r in forest.predict(few).collect())


def test_cosines_give_the_kernel(rows, tmp_path):
    made = kernels.RandomFourier(inputCol="raw", outputCol="kernel", components=4000, gamma=0.4)
    some = rows.where("id < 40").orderBy("id")
    z = np.array([r["k"] for r in made.transform(some).select(vector_to_array("kernel").alias("k")).collect()])
    want = np.exp(-0.4 * ((X[:40, None] - X[None, :40]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.08
    made.write().save(str(tmp_path / "cosines"))
    again = kernels.RandomFourier.load(str(tmp_path / "cosines")).transform(some).select(vector_to_array("kernel").alias("k")).collect()
    assert np.array_equal(z, np.array([r["k"] for r in again])) and made.transform(some.limit(0)).count() == 0


@pytest.mark.parametrize("regression", [False, True])
def test_neighbours_equal_all_pairs(rows, regression):
    made = kernels.NearestNeighbours(k=5, regression=regression, featuresCol="raw").fit(rows.where("id < 300"))
    got = {r["id"]: r for r in made.transform(rows.where("id >= 200")).collect()}
    for i in range(200, 400):
        near = np.argsort(np.linalg.norm(X[:300] - X[i], axis=1), kind="stable")[:5]
        share = np.bincount(Y[near], minlength=3) / 5
        assert got[i]["prediction"] == pytest.approx(Y[near].mean() if regression else share.argmax())
        assert regression or np.allclose(got[i]["probability"].toArray(), share)
    assert len(got) == 200


@pytest.mark.parametrize("name", ["knn", "svm_rbf", "mlp"])
def test_models_bend_where_a_line_cannot(rows, name):
    """Two classes and three, on rows held out; a line gets no further than the commonest class."""
    two = rows.withColumn("label", (F.col("label") > 0).cast("double"))
    assert training.train(two, name)[1].first()["accuracy"] > 0.85
    if name != "svm_rbf":
        assert training.train(rows, name, 3)[1].first()["accuracy"] > 0.75
    kind = type(M.classifier(name)).__name__
    assert kind == {"knn": "NearestNeighbours", "svm_rbf": "Pipeline", "mlp": "Network"}[name]


def test_unknown_names_raise_and_sizes_are_the_stated_ones():
    for make in (M.classifier, M.regressor):
        with pytest.raises(ValueError, match="unknown model"):
            make("perceptron of delphi")
    sizes = {n: (sequence_models.model(n).trees, sequence_models.model(n).depth) for n in ("gene_classifier", "pathogen_detector", "drug_target_predictor", "biomarker_discoverer")}
    assert sizes == {"gene_classifier": (100, 20), "pathogen_detector": (200, 15), "drug_target_predictor": (150, 8), "biomarker_discoverer": (500, 20)}


def test_biomarkers_part_a_marked_class(spark):
    from helixframe.catalog.model_queries import labelled

    scores, best = sequence_models.discover_biomarkers(labelled(spark, "/root/testdata/sf0.001"), top=10, trees=20, depth=6, group=10)
    told = {r["part"]: r["accuracy"] for r in scores.collect()}
    assert set(told) == {"train", "out_of_bag", "validation"} and min(told.values()) > 0.9
    assert any("GCGC" in r["feature"] or r["feature"] in ("gc_content", "cpg_score", "CG_freq") for r in best.collect())


def test_a_kernel_machine_has_few_tasks_for_few_rows(spark):
    """a task a pass for up to 16,384 rows, as many as before for many; the classes' machines are fitted at the same time."""
    parts = lambda n: kernels.Gathered(rows=n).transform(spark.range(100).repartition(6)).rdd.getNumPartitions()
    assert [parts(n) for n in (1, 1 << 14, (1 << 14) + 1, 1 << 30)] == [1, 1, 2, 6]
    stages = M.classifier("svm_rbf", 1600, 10).getStages()
    assert [type(s).__name__ for s in stages] == ["RandomFourier", "Gathered", "OneVsRest"] and stages[2].getParallelism() > 1
