"""Explanations of tree models against Spark's raw predictions and against Shapley values by enumeration."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import classification as K
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from helixframe.catalog import everything
from helixframe.ml import explain

SF = "/root/testdata/sf0.001"


def expectation(tree, x, known, node=0):
    """The tree's output with the features of ``known`` given, by a walk."""
    f = int(tree.feature[node])
    if f < 0:
        return tree.value[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        yes = x[f] in tree.categories[node] if node in tree.categories else x[f] <= tree.threshold[node]
        return expectation(tree, x, known, left if yes else right)
    a, b = tree.cover[left], tree.cover[right]
    return (a * expectation(tree, x, known, left) + b * expectation(tree, x, known, right)) / (a + b)


def shapley(ensemble, x):
    n = len(x)
    value = {s: sum(w * expectation(t, x, s) for t, w in zip(ensemble.trees, ensemble.weights)) for k in range(n + 1) for s in map(frozenset, combinations(range(n), k))}
    return np.array([
        sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (value[s | {i}] - value[s]) for s in value if i not in s) for i in range(n)
    ]).T


@pytest.fixture(scope="module")
def rows(spark):
    """Eight features, of which two have few values and count as categories, and labels of three classes."""
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((400, 8)), 2)
    x[:, 6], x[:, 7] = rng.integers(0, 5, 400), rng.integers(0, 3, 400)
    y = (x[:, 0] + (x[:, 6] == 2) * 2 > 0).astype(int) + (x[:, 7] == 1)
    frame = spark.createDataFrame([(i, int(y[i]), float(y[i] + x[i, 1]), *map(float, x[i])) for i in range(400)], "id long, label int, value double, " + ", ".join(f"x{k} double" for k in range(8)))
    frame = VectorAssembler(inputCols=[f"x{k}" for k in range(8)], outputCol="v").transform(frame)
    return VectorIndexer(inputCol="v", outputCol="features", maxCategories=6).fit(frame).transform(frame).cache()


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "regression_tree", "regression_forest", "boosted_regression"])
def test_parts_add_up_and_equal_enumeration(rows, kind):
    two = rows.withColumn("label", (F.col("label") > 0).cast("int"))
    model, raw = {
        "tree": (lambda: K.DecisionTreeClassifier(maxDepth=6).fit(rows), "probability"),
        "forest": (lambda: K.RandomForestClassifier(numTrees=7, maxDepth=7, seed=2).fit(rows), "rawPrediction"),
        "boosted": (lambda: K.GBTClassifier(maxIter=6, maxDepth=4, seed=2).fit(two), "rawPrediction"),
        "regression_tree": (lambda: R.DecisionTreeRegressor(labelCol="value", maxDepth=6).fit(rows), None),
        "regression_forest": (lambda: R.RandomForestRegressor(labelCol="value", numTrees=5, maxDepth=5, seed=2).fit(rows), None),
        "boosted_regression": (lambda: R.GBTRegressor(labelCol="value", maxIter=5, maxDepth=3, seed=2).fit(rows), None),
    }[kind]
    model = model()
    want = F.array("prediction") if raw is None else F.slice(vector_to_array(raw), 2, 1) if kind == "boosted" else vector_to_array(raw)
    told = {r["id"]: r["want"] for r in model.transform(rows).select("id", want.alias("want")).collect()}
    got = {r["id"]: r for r in explain.tree_contributions(model, rows).collect()}
    assert set(got) == set(told)
    for i, r in got.items():
        assert np.allclose(np.array(r["base"]) + np.array(r["contributions"]).sum(1), told[i], atol=1e-9)
    known = explain.ensemble(model)
    x = {r["id"]: np.array(r["features"]) for r in rows.where("id < 12").select("id", vector_to_array("features").alias("features")).collect()}
    for i, v in x.items():
        assert np.allclose(np.array(got[i]["contributions"]), shapley(known, v), atol=1e-9)
    assert any(t.categories for t in known.trees)


def test_a_leaf_that_no_training_row_reaches(spark):
    """Parts add up where a share is 0, also below a node without rows."""
    tree = explain.Tree(np.array([0, 1, -1, -1, -1]), np.array([0.0, 0.0, 0, 0, 0]), {}, np.array([1, 2, -1, -1, -1]), np.array([4, 3, -1, -1, -1]), np.array([9.0, 0, 0, 0, 9]), np.array([[0.0], [0], [1], [2], [5]]))
    known = explain.Ensemble([tree], [2.0])
    x = np.array([[-1.0, -1.0], [-1.0, 1.0], [1.0, 0.0]])
    assert np.allclose(known.base(), [10.0]) and np.allclose(known.base() + known.contributions(x).sum(2), [[2.0], [4.0], [10.0]])


def test_null_features_and_empty_tables(spark, rows):
    model = K.DecisionTreeClassifier(maxDepth=2).fit(rows)
    some = rows.where("id < 3").withColumn("features", F.when(F.col("id") != 1, F.col("features")))
    got = {r["id"]: r["contributions"] for r in explain.tree_contributions(model, some).collect()}
    assert got[1] is None and got[0] is not None and explain.tree_contributions(model, rows.limit(0)).count() == 0


def test_summary_is_the_mean_of_absolute_parts(spark):
    got = [(r["feature"], r["mean_size"]) for r in everything.QUERIES["tree_shap_summary"](spark, SF).orderBy("rank").collect()]
    assert len(got) == 10 and [v for _, v in got] == sorted((v for _, v in got), reverse=True)
    few = spark.createDataFrame([(1, [[1.0, -2.0], [0.0, 4.0]]), (2, [[-3.0, 0.0], [0.0, 2.0]])], "id long, contributions array<array<double>>")
    assert [(r["feature"], r["mean_size"], r["rank"]) for r in explain.mean_sizes(few, ["a", "b"]).orderBy("rank").collect()] == [("b", 2.0, 1), ("a", 1.0, 2)]


def test_ways_through_a_leaf_are_worked_out_once_for_many_rows(monkeypatch):
    """A leaf's values are looked up: however many rows there are, no more columns are worked out than its features can pass or fail."""
    tree = explain.Tree(np.array([0, 1, -1, -1, -1]), np.array([0.0, 0.5, 0, 0, 0]), {}, np.array([1, 2, -1, -1, -1]), np.array([4, 3, -1, -1, -1]), np.array([9.0, 6, 4, 2, 3]), np.array([[0.0], [0], [1], [2], [5]]))
    asked, plain = [], explain.leaf_values
    monkeypatch.setattr(explain, "leaf_values", lambda share, passed: asked.append(passed.shape[1]) or plain(share, passed))
    x = np.random.default_rng(5).standard_normal((3000, 2))
    got = explain.Ensemble([tree], [2.0]).contributions(x)
    assert max(asked) <= 4
    few = np.concatenate([explain.Ensemble([tree], [2.0]).contributions(x[i : i + 1]) for i in range(50)])
    assert np.allclose(got[:50], few) and np.allclose(got[:5], [shapley(explain.Ensemble([tree], [2.0]), v) for v in x[:5]])


def test_leaves_in_several_runs_and_blocks_add_up(rows, monkeypatch):
    model = K.RandomForestClassifier(numTrees=3, maxDepth=7, seed=2).fit(rows)
    x = np.array([r["x"] for r in rows.select(vector_to_array("features").alias("x")).collect()])
    whole = explain.ensemble(model).contributions(x)
    monkeypatch.setattr(explain, "LEAF_FEATURES", 7)
    monkeypatch.setattr(explain, "BLOCK", 33)
    assert np.allclose(explain.ensemble(model).contributions(x), whole, atol=1e-12)


def test_summary_without_rows_of_parts(spark, rows):
    """Equal to the mean over the rows of parts, with copies of a row and rows without features."""
    model = K.RandomForestClassifier(numTrees=4, maxDepth=5, seed=2).fit(rows)
    some = rows.where("id < 60").unionByName(rows.where("id < 9")).withColumn("features", F.when(F.col("id") != 30, F.col("features")))
    names = [f"x{k}" for k in range(8)]
    want = {r["feature"]: (r["mean_size"], r["rank"]) for r in explain.mean_sizes(explain.tree_contributions(model, some), names).collect()}
    got = {r["feature"]: (r["mean_size"], r["rank"]) for r in explain.tree_mean_sizes(model, some, names).collect()}
    assert set(got) == set(want) and all(abs(got[n][0] - want[n][0]) < 1e-12 and got[n][1] == want[n][1] for n in got)
    assert explain.tree_mean_sizes(model, some.limit(0), names).count() == 0
