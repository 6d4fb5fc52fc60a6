"""Training, comparing and explaining models on Spark ML: everything returned is a DataFrame or a fitted pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.ml import models as M
from helixframe.operators import metrics
from helixframe.storage import spread

# The algorithms on offer, with task, category and complexity.
ALGORITHMS = (
    ("random_forest_classifier", "classification", "ensemble", "medium"), ("logistic_regression", "classification", "linear", "low"),
    ("svm_classifier", "classification", "kernel", "high"), ("gradient_boosting_classifier", "classification", "ensemble", "high"),
    ("knn_classifier", "classification", "instance_based", "low"), ("naive_bayes", "classification", "probabilistic", "low"),
    ("decision_tree_classifier", "classification", "tree", "medium"), ("mlp_classifier", "classification", "neural_network", "high"),
    ("random_forest_regressor", "regression", "ensemble", "medium"), ("linear_regression", "regression", "linear", "low"),
    ("ridge_regression", "regression", "linear", "low"), ("lasso_regression", "regression", "linear", "low"),
    ("svm_regressor", "regression", "kernel", "high"), ("gradient_boosting_regressor", "regression", "ensemble", "high"),
    ("kmeans", "clustering", "centroid", "low"), ("dbscan", "clustering", "density", "medium"),
)

# What a search tries for each model, in Spark ML's names.
GRIDS = {
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4]},
    "xgboost": {"maxIter": [50, 100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.3], "subsamplingRate": [0.7, 0.8, 0.9]},
    "svm": {"regParam": [10.0, 1.0, 0.1, 0.01]},
    "logistic_regression": {"regParam": [100.0, 10.0, 1.0, 0.1, 0.01]},
}


def task_type(kind: Column, has_labels: Column, classes: Column) -> Column:
    """The task that a dataset's kind, labels and number of classes suggest."""
    named = F.when(kind.isin("protein", "dna", "rna"), F.concat(kind, F.lit("_classification")))
    return F.when(~has_labels, "clustering").otherwise(F.coalesce(named, F.when(classes > 1, "general_classification"), F.lit("general_regression")))


def suggestions(datasets: DataFrame, many: int = 5) -> DataFrame:
    """name, algorithm, score, rank: the best algorithms for each dataset (name, task, megabytes, features); the order of the table on ties."""
    spark = datasets.sparkSession
    table = spark.createDataFrame([(i, *a) for i, a in enumerate(ALGORITHMS)], "place int, algorithm string, task string, category string, complexity string")
    simple = F.col("complexity").isin("low", "medium").cast("int")
    lean = F.col("algorithm").isin("logistic_regression", "linear_regression").cast("int")
    size = F.when(F.col("megabytes") < 10, simple * 2).when(F.col("megabytes") > 100, lean * 2).otherwise(0)
    wide = ((F.col("features") > 1000) & F.col("category").isin("linear", "kernel")).cast("int")
    every = datasets.select("name", "task", "megabytes", "features").join(F.broadcast(table), "task").withColumn("score", size + wide + simple)
    rank = F.row_number().over(Window.partitionBy("name", "task").orderBy(F.desc("score"), "place"))
    return every.withColumn("rank", rank).where(F.col("rank") <= many).select("name", "task", "algorithm", "score", "rank")


def config(name: str, rows: int, classes: int = 2) -> dict:
    """A model's name and parameters, which lean on the number of rows and classes."""
    params = {
        "random_forest": {"numTrees": 100 if rows < 10_000 else 200, "maxDepth": 30 if rows > 1000 else 20},
        "xgboost": {"maxIter": 100, "maxDepth": 6 if rows > 1000 else 4, "stepSize": 0.1, "subsamplingRate": 0.8},
        "gradient_boosting": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5}, "svm": {"regParam": 1.0},
        "logistic_regression": {"maxIter": 1000}, "naive_bayes": {}, "knn": {"k": 5}, "decision_tree": {"maxDepth": 10}, "ridge": {"regParam": 1.0},
    }
    return {"model": name, "classes": classes, "params": params.get(name, params["random_forest"])}


def split(rows: DataFrame, key: str = "id", label: str = "label", test: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key, about ``test`` of each class: nothing is sorted or shuffled."""
    grain = 1 << 20
    at = F.pmod(F.xxhash64(F.col(label).cast("string"), F.col(key)), F.lit(grain)) < int(grain * test)
    return rows.where(~at), rows.where(at)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with prediction and, where the model gives any, probability as an array."""
    out = model.transform(rows)
    return out.withColumn("probability", vector_to_array("probability")) if "probability" in out.columns else out


def train(rows: DataFrame, name: str, classes: int = 2) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training part of (id, label, raw); the pipeline and its row of scores on the test part."""
    fit, held = split(rows)
    model = M.pipeline(M.classifier(name, n=fit.count(), classes=classes)).fit(fit)
    return model, metrics.weighted_scores(model.transform(held).select("label", "prediction"))


def train_regression(rows: DataFrame, name: str) -> tuple[PipelineModel, DataFrame]:
    fit, held = split(rows, label="id")
    model = M.pipeline(M.regressor(name, n=fit.count())).fit(fit)
    return model, metrics.regression_scores(model.transform(held).select("label", "prediction"))


def cross_validated(rows: DataFrame, name: str, classes: int = 2, folds: int = 5) -> DataFrame:
    """fold, accuracy over folds by a hash of the id."""
    fold = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(folds)).cast("int")
    out = None
    for k in range(folds):
        model = M.pipeline(M.classifier(name, n=rows.count(), classes=classes)).fit(rows.where(fold != k))
        one = metrics.weighted_scores(model.transform(rows.where(fold == k)).select("label", "prediction")).select(F.lit(k).alias("fold"), "accuracy")
        out = one if out is None else out.unionByName(one)
    return out


def compare(rows: DataFrame, names: list[str], classes: int = 2) -> DataFrame:
    """model and its scores on the test part, the best by accuracy marked, the first on ties."""
    out = None
    for place, name in enumerate(names):
        one = train(rows, name, classes)[1].select(F.lit(place).alias("place"), F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    best = out.agg(F.min_by("place", F.struct(-F.col("accuracy"), F.col("place"))).alias("top"))
    return out.crossJoin(F.broadcast(best)).select("model", "accuracy", "precision", "recall", "f1", (F.col("place") == F.col("top")).alias("best"))


def importances(spark: SparkSession, model: PipelineModel, names: list[str]) -> DataFrame:
    """feature, importance: of trees as they are, of linear models the mean size of their coefficients."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(last, "coefficients"):
        values = abs(last.coefficients.toArray())
    else:
        raise ValueError("the model tells no importance")
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")


def predict(model: PipelineModel, rows: DataFrame, needed: list[str]) -> DataFrame:
    """The rows with predictions; missing features raise an error."""
    lost = [c for c in needed if c not in rows.columns]
    if lost:
        raise ValueError(f"missing features: {', '.join(lost)}")
    return scored(model, rows)


def evaluate(predicted: DataFrame, kinds: int = 20) -> DataFrame:
    """Scores of (label, prediction): of a classification with up to ``kinds`` labels, else of a regression."""
    few = predicted.select("label").distinct().limit(kinds + 1).count() <= kinds
    return metrics.weighted_scores(predicted) if few else metrics.regression_scores(predicted)


def one_click(df: DataFrame, target: str, key: str) -> tuple[PipelineModel, DataFrame]:
    """Text columns encoded, a forest of 100 trees fitted on four fifths; the pipeline and its scores."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    texts = [c for c, k in df.dtypes if k == "string" and c not in (key, target)]
    numbers = [c for c, k in df.dtypes if k != "string" and c not in (key, target)]
    label = [StringIndexer(inputCol=target, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc")] if dict(df.dtypes)[target] == "string" else []
    rows = df if label else df.withColumn("label", F.col(target).cast("double"))
    stages = [*label, *[StringIndexer(inputCol=c, outputCol=f"__{c}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in texts]]
    stages += [VectorAssembler(inputCols=[*numbers, *[f"__{c}" for c in texts]], outputCol="features", handleInvalid="skip"), M.classifier("random_forest").setMaxBins(256)]
    fit, held = split(spread(rows, key), key, target)
    model = Pipeline(stages=stages).fit(fit)
    return model, metrics.weighted_scores(model.transform(held).select("label", "prediction"))


def confidence(predicted: DataFrame) -> DataFrame:
    """Mean, population deviation and extremes of the largest probability of each row."""
    p = F.array_max("probability")
    return predicted.agg(F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"))


def residuals(predicted: DataFrame) -> DataFrame:
    """Statistics of residuals and predictions, population deviation."""
    e = F.col("label") - F.col("prediction")
    of = lambda name, c: [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    return predicted.agg(*of("residual", e), *of("prediction", F.col("prediction")))


def consensus(predictions: DataFrame) -> DataFrame:
    """By model (columns model, prediction, probability): the most frequent prediction (the least on ties), its count,
    the mean of the largest probability, and whether predictions differ."""
    sure = F.array_max("probability")
    counts = predictions.groupBy("model", "prediction").agg(F.count("*").alias("n"), F.sum(sure).alias("sure"), F.count(sure).alias("known"))
    per = counts.groupBy("model").agg(
        F.min_by("prediction", F.struct(-F.col("n"), F.col("prediction"))).alias("most_common"), F.max("n").alias("votes"), F.count("*").alias("kinds"), F.try_divide(F.sum("sure"), F.sum("known")).alias("confidence")
    )
    pattern = F.when(F.col("kinds") > 1, "BIOLOGICALLY_DIVERSE").otherwise("HOMOGENEOUS_PATTERN")
    return per.select("model", "most_common", "votes", "confidence", pattern.alias("significance"))


def quality_label(accuracy: Column) -> Column:
    return F.when(accuracy > 0.9, "EXCELLENT").when(accuracy > 0.8, "GOOD").when(accuracy > 0.7, "FAIR").otherwise("POOR")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
