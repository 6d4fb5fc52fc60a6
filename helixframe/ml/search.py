"""Hyperparameter search: all candidates of closed-form models from one scan, a seeded part of the grid for the rest."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(values: dict[str, list], many: int | None = None, seed: int = 42) -> list[dict]:
    """Every combination, in the order of the values; or ``many`` of them, drawn without repeats."""
    every = [dict(zip(values, v)) for v in product(*values.values())]
    if many is None or many >= len(every):
        return every
    return [every[i] for i in sorted(np.random.default_rng(seed).choice(len(every), many, replace=False).tolist())]


def hashed_fold(key: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(folds)).cast("int")


def _moments(rows: DataFrame) -> dict[tuple, np.ndarray]:
    """For each (fold, class) the sums of (1, x) and of their squares.

    Every task sums its rows up; Spark adds the sums up entry by entry. The driver gets two rows a group, as wide as the features.
    """

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(["fold", "kind"]):
                x = np.c_[np.ones(len(part)), np.stack(part["x"].tolist())]
                held[key] = held.get(key, 0) + np.stack([x.sum(0), (x * x).sum(0)])
        for (fold, kind), sums in held.items():
            i, j = np.indices(sums.shape).reshape(2, -1)
            yield pd.DataFrame({"fold": fold, "kind": kind, "i": i, "j": j, "s": sums.ravel()})

    given = rows.select("fold", F.col("label").cast("double").alias("kind"), vector_to_array("raw").alias("x")).dropna()
    sums = given.mapInPandas(collect, "fold int, kind double, i int, j int, s double").groupBy("fold", "kind", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for key, part in sums.groupby(["fold", "kind"]):
        out[key] = np.zeros((part["i"].max() + 1, part["j"].max() + 1))
        out[key][part["i"], part["j"]] = part["s"]
    return out


def _whole_moments(rows: DataFrame) -> dict[int, list[list[Fraction]]]:
    """For each fold the sums of products of (1, x, y) with itself, free of rounding: every double is a whole number times a power of two."""

    def add(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, int]:
        low = min(e for _, e in parts)
        return sum(m * (1 << (e - low)) for m, e in parts), low

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x = np.c_[np.ones(len(part)), np.stack(part["x"].tolist()), part["label"].to_numpy(float)]
                x = x[np.isfinite(x).all(1)]
                if not len(x):
                    continue
                mantissa, power = np.frexp(x)
                low = int(power[x != 0].min())
                whole = (mantissa * 2.0**53).astype(np.int64).astype(object) * np.left_shift(np.ones(x.shape, object), np.where(x != 0, power - low, 0).astype(object))
                sums = (whole.T @ whole, 2 * (low - 53))
                held[fold] = add([held[fold], sums]) if fold in held else sums
        for fold, (sums, low) in held.items():
            yield pd.DataFrame({"fold": [fold], "low": [low], "sums": [[[str(v) for v in row] for row in sums]]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        sums, low = add([(np.array([[int(v) for v in row] for row in m], object), int(e)) for m, e in zip(group["sums"], group["low"])])
        return pd.DataFrame({"fold": group["fold"][:1], "low": [low], "sums": [[[str(v) for v in row] for row in sums]]})

    kind = "fold int, low int, sums array<array<string>>"
    given = rows.select("fold", F.col("label").cast("double").alias("label"), vector_to_array("raw").alias("x")).dropna()
    told = given.mapInPandas(collect, kind).groupBy("fold").applyInPandas(merge, kind).collect()
    return {r["fold"]: [[Fraction(int(v)) * Fraction(2) ** r["low"] for v in row] for row in r["sums"]] for r in told}


def ridge_search(rows: DataFrame, alphas: list[float], fold: Column) -> DataFrame:
    """alpha, fold, score (R2 of the held-out fold), mean, rank of rows (label, raw), from one scan.

    A candidate of a fold is solved from the moments of the other folds and scored by those of its own; the mean ranks, the
    lower alpha on ties. Sums, intercepts, scores and means are exact, as candidates often differ by less than doubles tell. A fold
    of one value has score 0; rows with nulls or values that are not finite are left out; fewer than two folds with rows raise an error.
    """
    found = {k: np.array(m, object) for k, m in sorted(_whole_moments(rows.withColumn("fold", fold)).items())}
    if len(found) < 2:
        raise ValueError("a search takes rows of two folds at least")
    total, scores = sum(found.values()), {}
    for alpha in alphas:
        for k, m in found.items():
            rest = total - m
            centred = (rest[1:, 1:] - np.outer(rest[0, 1:], rest[0, 1:]) / rest[0, 0]).astype(float)
            penalty = float(alpha) * np.eye(len(centred) - 1)
            weights = np.array([Fraction(w) for w in np.linalg.lstsq(centred[:-1, :-1] + penalty, centred[:-1, -1], rcond=None)[0].tolist()], object)
            v = np.array([weights @ rest[0, 1:-1] / rest[0, 0] - rest[0, -1] / rest[0, 0], *-weights, Fraction(1)], object)
            spread = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
            scores[alpha, k] = 1 - v @ m @ v / spread if spread > 0 else Fraction(0)
    mean = {a: sum(scores[a, k] for k in found) / len(found) for a in alphas}
    rank = {a: i + 1 for i, a in enumerate(sorted(mean, key=lambda a: (-mean[a], a)))}
    out = [(float(a), int(k), float(s), float(mean[a]), rank[a]) for (a, k), s in scores.items()]
    return rows.sparkSession.createDataFrame(out, "alpha double, fold int, score double, mean double, rank int")


def naive_bayes_search(rows: DataFrame, smoothings: list[float], fold: Column) -> DataFrame:
    """smoothing, fold, score (accuracy of the held-out fold), mean, rank of Gaussian naive Bayes on rows (label, raw).

    One scan gives the classes' moments by fold, and so the models of all folds and candidates; a second one scores them all.
    ``smoothing`` times the largest variance of a feature is added to variances. Ties of classes go to the lower label.
    """
    marked = rows.withColumn("fold", fold)
    found = _moments(marked)
    folds, kinds = (sorted({k[i] for k in found}) for i in (0, 1))
    if len(folds) < 2:
        raise ValueError("a search takes rows of two folds at least")
    models: dict = {}
    for k in folds:
        per = {c: sum(m for (f, kind), m in found.items() if f != k and kind == c) for c in kinds}
        per = {c: m for c, m in per.items() if not np.isscalar(m)}
        whole = sum(per.values())
        widest = (whole[1, 1:] / whole[1, 0] - (whole[0, 1:] / whole[1, 0]) ** 2).max()
        n = np.array([m[0, 0] for m in per.values()])
        mean = np.array([m[0, 1:] / m[0, 0] for m in per.values()])
        spread = np.array([m[1, 1:] / m[0, 0] for m in per.values()]) - mean**2
        models[k] = (np.array([*per]), np.log(n / n.sum()), mean, np.maximum(spread, 0), widest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, part in batch.groupby("fold"):
                labels, prior, mean, spread, widest = models[k]
                x = np.stack(part["x"].tolist())
                for s in smoothings:
                    v = spread + s * widest
                    odds = np.stack([prior[c] - 0.5 * (np.log(2 * np.pi * v[c]) + (x - mean[c]) ** 2 / v[c]).sum(1) for c in range(len(labels))], 1)
                    right = (labels[odds.argmax(1)] == part["label"].to_numpy()).sum()
                    yield pd.DataFrame({"smoothing": [s], "fold": [k], "right": [right], "n": [len(part)]})

    given = marked.select("fold", F.col("label").cast("double").alias("label"), vector_to_array("raw").alias("x")).dropna()
    told = given.mapInPandas(score, "smoothing double, fold int, right long, n long").groupBy("smoothing", "fold")
    return _ranked(told.agg((F.sum("right") / F.sum("n")).alias("score")), "smoothing")


def _ranked(scores: DataFrame, candidate: str) -> DataFrame:
    mean = scores.groupBy(candidate).agg(F.avg("score").alias("mean"))
    mean = mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), candidate)))
    return scores.join(F.broadcast(mean), candidate).select(candidate, "fold", "score", "mean", "rank")
