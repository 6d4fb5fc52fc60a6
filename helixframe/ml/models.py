"""Model registry, ranking rules, training and explanation on Spark ML."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as K
from pyspark.ml import clustering as G
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.ml import kernels, search
from helixframe.storage import spread


#: Classes whose machines are fitted at the same time, as their many short jobs leave cores idle.
AT_ONCE = 4


def classifier(name: str, n: int = 1, classes: int = 2):
    """A classifier by name; another name raises an error. ``n``: rows, for penalties per row."""
    boosted = lambda **a: K.GBTClassifier(**a) if classes == 2 else K.OneVsRest(classifier=K.GBTClassifier(**a))
    machine = lambda **a: K.LinearSVC(**a) if classes == 2 else K.OneVsRest(classifier=K.LinearSVC(**a), featuresCol=a.get("featuresCol", "features"), parallelism=AT_ONCE)
    made = {
        "random_forest": lambda: K.RandomForestClassifier(numTrees=100, maxDepth=10, seed=42),
        "gradient_boosting": lambda: boosted(maxIter=20, stepSize=0.1, maxDepth=5, seed=42),
        "xgboost": lambda: boosted(maxIter=20, stepSize=0.1, maxDepth=6, seed=42),
        "logistic_regression": lambda: K.LogisticRegression(regParam=1 / max(1, n), elasticNetParam=0.0, standardization=False),
        "naive_bayes": lambda: K.NaiveBayes(modelType="gaussian"),
        "decision_tree": lambda: K.DecisionTreeClassifier(maxDepth=10, seed=42),
        "svm": lambda: machine(regParam=0.01),
        "svm_rbf": lambda: Pipeline(stages=[kernels.RandomFourier(), kernels.Gathered(rows=max(1, n)), machine(regParam=1 / max(1, n), standardization=False, featuresCol="kernel")]),
        "knn": lambda: kernels.NearestNeighbours(k=5),
        "mlp": lambda: kernels.Network(),
    }
    return _made(made, name)


def regressor(name: str, n: int = 1):
    made = {
        "random_forest": lambda: R.RandomForestRegressor(numTrees=100, maxDepth=10, seed=42),
        "gradient_boosting": lambda: R.GBTRegressor(maxIter=20, stepSize=0.1, maxDepth=5, seed=42),
        "linear": lambda: R.LinearRegression(regParam=0.0, solver="normal"),
        "ridge": lambda: R.LinearRegression(regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False),
        "lasso": lambda: R.LinearRegression(regParam=1.0, elasticNetParam=1.0, standardization=False),
        "decision_tree": lambda: R.DecisionTreeRegressor(maxDepth=10, seed=42),
        "knn": lambda: kernels.NearestNeighbours(k=5, regression=True),
    }
    return _made(made, name)


def _made(made: dict, name: str):
    if name not in made:
        raise ValueError(f"unknown model {name}; known are {', '.join(made)}")
    return made[name]()


def pipeline(estimator, columns: list[str] | None = None, scaled: bool = True) -> Pipeline:
    """Assembled (from ``columns``) or ready (column raw) features, scaled, then the estimator."""
    stages = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip")] if columns else []
    stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=scaled, withStd=scaled))
    return Pipeline(stages=[*stages, estimator])


def embedded(embeddings: DataFrame, label: str = "label") -> DataFrame:
    """id, label, raw, stored and dealt to all cores, as models are fitted on them."""
    return spread(embeddings.select(F.col("vec_id").alias("id"), F.col(label).cast("double").alias("label"), array_to_vector("embedding").alias("raw")), "id")


def tuned(train: DataFrame, estimator, grid: dict[str, list], folds: int = 3, many: int | None = None, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """The best pipeline by cross-validated accuracy over the grid, or over ``many`` combinations drawn from it, and all of them with
    their mean accuracy and rank, in the grid's order on ties."""
    tried = search.grid(grid, many, seed)
    maps = [{estimator.getParam(k): v for k, v in one.items()} for one in tried]
    found = CrossValidator(
        estimator=pipeline(estimator), estimatorParamMaps=maps, numFolds=folds, seed=seed, parallelism=2,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
    ).fit(train)
    order = sorted(range(len(tried)), key=lambda i: (-found.avgMetrics[i], i))
    rows = [(json.dumps(one, sort_keys=True), float(found.avgMetrics[i]), order.index(i) + 1) for i, one in enumerate(tried)]
    return found.bestModel, train.sparkSession.createDataFrame(rows, "candidate string, accuracy double, rank int")


def principal_components(rows: DataFrame, k: int) -> DataFrame:
    """id, pc array, mean-centred; each component's sign makes its largest loading positive."""
    centred = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False).fit(rows)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(out := centred.transform(rows))
    loads = model.pc.toArray()
    sign = [float(1 if c[abs(c).argmax()] >= 0 else -1) for c in loads.T]
    pcs = F.zip_with(vector_to_array("pc"), F.array(*map(F.lit, sign)), lambda x, s: x * s)
    return model.transform(out).select("id", pcs.alias("pc"))


def clusters(rows: DataFrame, k: int) -> DataFrame:
    return G.KMeans(k=k, seed=42, featuresCol="raw").fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def linear_contributions(model, rows: DataFrame, means: list[float]) -> DataFrame:
    """Exact additive contributions of a linear model: coefficient * (x - mean), as an array."""
    weights = [float(x) for x in model.coefficients]
    parts = F.zip_with(vector_to_array("raw"), F.array(*map(F.lit, means)), lambda x, m: x - m)
    return rows.select("id", F.zip_with(parts, F.array(*map(F.lit, weights)), lambda x, w: x * w).alias("contributions"))


# What each trait of the data adds to a model's score of 100.
RANKING = {
    "few_rows": {"logistic_regression": 20, "naive_bayes": 20, "knn": 20, "xgboost": -20, "neural_network": -20},
    "many_rows": {"xgboost": 20, "gradient_boosting": 20, "neural_network": 20, "knn": -30},
    "wide": {"random_forest": 15, "xgboost": 15, "gradient_boosting": 15, "logistic_regression": -10, "naive_bayes": -10},
    "many_classes": {"random_forest": 10, "xgboost": 10, "svm": -15},
    "biological": {"random_forest": 25, "xgboost": 25},
}


def ranked(datasets: DataFrame, models: list[str]) -> DataFrame:
    """name, model, score, rank of each model for each dataset (name, rows, features, classes, task), highest first, in the given order on ties."""
    c = F.col
    holds = {
        "few_rows": c("rows") < 1000, "many_rows": c("rows") > 10_000, "wide": c("features") > 100, "many_classes": c("classes") > 10,
        "biological": c("task").contains("protein") | c("task").contains("dna"),
    }
    score = lambda m: reduce(lambda a, b: a + b, [F.when(yes, RANKING[t].get(m, 0)).otherwise(0) for t, yes in holds.items()], F.lit(100))
    each = F.posexplode(F.array(*[F.struct(F.lit(m).alias("model"), score(m).alias("score")) for m in models])).alias("place", "x")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "place"))
    return datasets.select("name", each).select("name", "place", "x.*").withColumn("rank", rank).drop("place")
