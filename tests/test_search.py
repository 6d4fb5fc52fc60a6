"""Searches against fitting fold by fold, races against a clock, neighbour information against all pairs."""

import time
from math import log

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from helixframe.ml import budget, search
from helixframe.ml import models as M
from helixframe.operators import information, prep

rng = np.random.default_rng(5)
X = rng.standard_normal((300, 4)) * [1, 2, 0.1, 5] + 3
Y = X @ [1.0, -2, 10, 0] + rng.standard_normal(300)
KIND = (X[:, 0] > 3).astype(int) + (X[:, 1] > 5)


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame([(i, float(y), int(k), x.tolist()) for i, (x, y, k) in enumerate(zip(X, Y, KIND))], "id long, label double, kind int, x array<double>")
    return frame.withColumn("raw", array_to_vector("x")).withColumn("k", (F.col("id") % 3).cast("int")).repartition(5)


def test_ridge_scores_equal_fold_by_fold_fits(rows):
    got = {(r["alpha"], r["fold"]): r for r in search.ridge_search(rows, [0.0, 2.0, 300.0], F.col("k")).collect()}
    means = {}
    for alpha in (0.0, 2.0, 300.0):
        scores = []
        for k in range(3):
            fit, held = np.arange(300) % 3 != k, np.arange(300) % 3 == k
            centre, level = X[fit].mean(0), Y[fit].mean()
            w = np.linalg.solve((X[fit] - centre).T @ (X[fit] - centre) + alpha * np.eye(4), (X[fit] - centre).T @ (Y[fit] - level))
            left = Y[held] - level - (X[held] - centre) @ w
            scores.append(1 - left @ left / ((Y[held] - Y[held].mean()) ** 2).sum())
            assert got[alpha, k]["score"] == pytest.approx(scores[-1], abs=1e-8)
        means[alpha] = np.mean(scores)
    order = sorted(means, key=lambda a: -means[a])
    assert all(r["mean"] == pytest.approx(means[a]) and order[r["rank"] - 1] == a for (a, _), r in got.items())
    with pytest.raises(ValueError):
        search.ridge_search(rows, [1.0], F.lit(0))


def test_naive_bayes_scores_equal_fold_by_fold_fits(rows):
    got = {(r["smoothing"], r["fold"]): r["score"] for r in search.naive_bayes_search(rows.withColumn("label", F.col("kind").cast("double")), [1e-9, 0.1], F.col("k")).collect()}
    for s in (1e-9, 0.1):
        for k in range(3):
            fit, held = np.arange(300) % 3 != k, np.arange(300) % 3 == k
            odds = []
            for c in range(3):
                z = X[fit & (KIND == c)]
                v = z.var(0) + s * X[fit].var(0).max()
                odds.append(log(len(z) / fit.sum()) - 0.5 * (np.log(2 * np.pi * v) + (X[held] - z.mean(0)) ** 2 / v).sum(1))
            assert got[s, k] == pytest.approx((np.argmax(odds, 0) == KIND[held]).mean())


def test_drawn_combinations_are_tried_and_the_best_is_kept(rows):
    values = {"maxDepth": [1, 3, 5], "minInstancesPerNode": [1, 5]}
    drawn = search.grid(values, 4)
    assert drawn == search.grid(values, 4) and len({str(x) for x in drawn}) == 4 and all(x in search.grid(values) for x in drawn) and len(search.grid(values)) == 6
    model, told = M.tuned(rows.withColumn("label", F.col("kind").cast("double")), M.classifier("decision_tree"), values, many=4)
    told = sorted(told.collect(), key=lambda r: r["rank"])
    assert len(told) == 4 and [r["accuracy"] for r in told] == sorted((r["accuracy"] for r in told), reverse=True)
    assert f'"maxDepth": {model.stages[-1].getMaxDepth()}' in told[0]["candidate"]


def test_a_candidate_that_never_ends_is_cancelled(spark, tmp_path):
    def forever():
        while True:
            spark.range(4, numPartitions=4).where(F.expr("reflect('java.lang.Thread', 'sleep', 100000L) is null")).count()

    def fails():
        raise KeyError("no column")

    store, began = str(tmp_path / "told"), time.monotonic()
    candidates = {"good": lambda: 0.5, "endless": forever, "fails": fails, "better": lambda: spark.range(100).count() / 100}
    told = {r["name"]: r for r in budget.race(spark, candidates, 6, 2, store).collect()}
    assert {n: r["status"] for n, r in told.items()} == {"good": "done", "endless": "cancelled", "fails": "failed", "better": "done"}
    assert (told["better"]["rank"], told["good"]["rank"], told["endless"]["rank"]) == (1, 2, None) and "no column" in told["fails"]["error"]
    assert 6 <= told["endless"]["seconds"] < 40 and time.monotonic() - began < 45
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    late = {r["name"]: r["status"] for r in budget.race(spark, {"endless": forever, "late": lambda: 1.0}, 3, 1, store).collect()}
    assert late == {"endless": "cancelled", "late": "not started"} and spark.read.parquet(store).count() == 6


def test_best_model_within_a_budget(rows):
    labelled = rows.select("id", F.col("kind").cast("double").alias("label"), "raw")
    model, told = budget.best_model(labelled, ["decision_tree", "naive_bayes"], 120, 3)
    best = max(told.collect(), key=lambda r: r["score"])
    assert best["rank"] == 1 and best["score"] > 0.8 and model.transform(labelled).count() == 300


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain_information(x, y, k):
    some = [i for i in range(len(x)) if sum(v == y[i] for v in y) > 1]
    near, size, m = [], [], []
    for i in some:
        gaps = sorted(abs(x[j] - x[i]) for j in some if j != i and y[j] == y[i])
        d = gaps[min(k, len(gaps)) - 1]
        near.append(min(k, len(gaps)))
        size.append(len(gaps) + 1)
        m.append(sum(abs(x[j] - x[i]) < d or x[j] == x[i] for j in some))
    mean = lambda v: np.mean([digamma(n) for n in v])
    return max(0.0, digamma(len(some)) + mean(near) - mean(size) - mean(m))


@pytest.mark.parametrize("width", [1 << 16, 9])
def test_neighbour_information_equals_all_pairs(spark, monkeypatch, width):
    """Continuous values, many ties, classes of one and of two rows, nulls; in one range and in many."""
    monkeypatch.setattr(information, "RANGE", width)
    n = 160
    y = ["a"] * 70 + ["b"] * 60 + ["c"] * 27 + ["d"] * 2 + ["e"]
    a = rng.standard_normal(n) + np.array([ord(v) for v in y])
    b = rng.integers(0, 6, n) / 8
    frame = spark.createDataFrame([(i, y[i], float(a[i]), float(b[i]), None, "z") for i in range(n)] + [(900, None, 1.0, 1.0, None, "z"), (901, "a", None, float("nan"), None, "z")], "id long, y string, a double, b double, none double, x string")
    got = {r["feature"]: r["information"] for r in information.mutual_information(frame.repartition(4), "id", ["a", "b", "none"], "y").collect()}
    assert set(got) == {"a", "b"} and got["a"] == pytest.approx(plain_information(a, y, 3), abs=1e-8) and got["b"] == pytest.approx(plain_information(b, y, 3), abs=1e-8)
    assert got["a"] > 0.1 and information.mutual_information(frame.limit(0), "id", ["a"], "y").count() == 0
    assert prep.select_best(frame, ["a", "b"], "y", 1, "neighbours", "id").columns == ["id", "y", "a", "none", "x"]
    with pytest.raises(ValueError):
        prep.select_best(frame, ["a"], "y", 1, "guess")
