"""Additive explanations of Spark ML tree models: path-dependent Shapley values, exact, over Arrow batches.

A tree's expectation with some features known follows the row where a split's feature is known and else takes both sides by the
training rows that they hold. Shapley values of these expectations add up over leaves. On the way to a leaf each feature counts
once, by the share of training rows that its splits let through and by whether the row passes them. The values of a leaf then come
from the integral of a polynomial, the product of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.storage import new_path

#: Rows that are handed on at once, and nodes that a model may have, as every executor holds a copy.
ROWS, MOST_NODES = 512, 20_000_000
#: Most rows and numbers of contributions that are worked out at once.
MOST_ROWS, HELD = 8192, 1 << 23
#: Of them, rows and features of leaves whose values are held before they are added up.
BLOCK, LEAF_FEATURES = 1024, 4096


@dataclass
class Tree:
    """A tree as node arrays: the feature of a split (-1: a leaf), its threshold or the categories that go left, its children, the
    training rows that reach a node, and the output of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    categories: dict[int, np.ndarray]
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def goes_left(self, x: np.ndarray) -> np.ndarray:
        """Of each node and row whether the row would go left."""
        out = x[:, np.maximum(self.feature, 0)].T <= self.threshold[:, None]
        for node, kinds in self.categories.items():
            out[node] = np.isin(x[:, self.feature[node]], kinds)
        return out

    @cached_property
    def leaves(self) -> list[tuple[int, list[int], np.ndarray]]:
        """Each leaf with the features of the splits on the way and the shares that these let through."""
        out, stack = [], [(0, {})]
        while stack:
            node, shares = stack.pop()
            f = int(self.feature[node])
            if f < 0:
                out.append((node, [*shares], np.array([*shares.values()])))
                continue
            for child in (int(self.left[node]), int(self.right[node])):
                share = self.cover[child] / self.cover[node] if self.cover[node] else 0.0
                stack.append((child, shares | {f: shares.get(f, 1.0) * share}))
        return out

    @cached_property
    def groups(self) -> list[tuple[range, list[np.ndarray], list[tuple[int, int, np.ndarray]]]]:
        """Runs of leaves with up to about LEAF_FEATURES features: their places, where the values of each leaf's features stand if they are
        sorted by feature, and of each feature where its values begin and the nodes of its leaves."""
        out, sizes = [], np.array([len(features) for _, features, _ in self.leaves])
        run = (np.cumsum(sizes) - sizes) // LEAF_FEATURES
        for r in np.unique(run):
            leaves = np.flatnonzero(run == r)
            ways = np.array([f for i in leaves for f in self.leaves[i][1]], np.int64)
            order = np.argsort(ways, kind="stable")
            at = np.empty_like(order)
            at[order] = np.arange(len(order))
            nodes = np.repeat([self.leaves[i][0] for i in leaves], sizes[leaves])[order]
            kinds, first = np.unique(ways[order], return_index=True)
            parts = [(f, a, n) for f, a, n in zip(kinds.tolist(), first.tolist(), np.split(nodes, first[1:]))]
            out.append((range(leaves[0], leaves[-1] + 1), np.split(at, np.cumsum(sizes[leaves])[:-1]), parts))
        return out

    @cached_property
    def failing(self) -> np.dtype:
        """Of a number with a bit for each feature on the way to a leaf."""
        return np.min_scalar_type((1 << max(len(features) for _, features, _ in self.leaves)) - 1)

    def failed(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each leaf, in the order of ``leaves``, the features on its way that each row fails: bit i is the i-th one's."""
        left = self.goes_left(x)
        fails = {True: (~left).astype(self.failing), False: left.astype(self.failing)}
        stack = [(0, {}, np.zeros(len(x), self.failing))]
        while stack:
            node, known, failed = stack.pop()
            f = int(self.feature[node])
            if f < 0:
                yield failed
                continue
            known = known if f in known else known | {f: len(known)}
            bit = self.failing.type(known[f])
            for child, side in ((int(self.left[node]), True), (int(self.right[node]), False)):
                stack.append((child, known, failed | fails[side][node] << bit))


@dataclass
class Ensemble:
    """Trees with their weights, whose weighted sum is the model's raw output."""

    trees: list[Tree]
    weights: list[float]

    @property
    def outputs(self) -> int:
        return self.trees[0].value.shape[1]

    def base(self) -> np.ndarray:
        """The output of a row of which nothing is known."""
        total = np.zeros(self.outputs)
        for tree, weight in zip(self.trees, self.weights):
            for leaf, _, shares in tree.leaves:
                total += weight * np.prod(shares) * tree.value[leaf]
        return total

    def rows_at_once(self, features: int) -> int:
        """Rows whose contributions take about HELD numbers."""
        return max(1, min(MOST_ROWS, HELD // (self.outputs * features)))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, outputs, features) of a matrix of rows.

        What a leaf gives hangs only on the features on its way that a row fails. Where there are fewer ways to fail than rows, they are
        worked out once and looked up. A tree's leaves then add up by one product of matrices for each feature.
        """
        out = np.zeros((x.shape[1], len(x), self.outputs))
        for tree, weight in zip(self.trees, self.weights):
            tables = [leaf_values(shares, _passed(np.arange(1 << len(shares)), len(shares))) if len(shares) and 1 << len(shares) <= len(x) else None for _, _, shares in tree.leaves]
            for at in range(0, len(x), BLOCK):
                failed = tree.failed(x[at : at + BLOCK])
                some = out[:, at : at + BLOCK]
                for leaves, rows, parts in tree.groups:
                    held = np.empty((sum(map(len, rows)), some.shape[1]))
                    for place, mine in zip(leaves, rows):
                        ways, (_, _, shares), table = next(failed), tree.leaves[place], tables[place]
                        if len(shares):
                            held[mine] = leaf_values(shares, _passed(ways, len(shares))) if table is None else table.take(ways, axis=1)
                    for f, a, nodes in parts:
                        some[f] += held[a : a + len(nodes)].T @ (tree.value[nodes] * weight)
        return out.transpose(1, 2, 0)


def _passed(failed: np.ndarray, many: int) -> np.ndarray:
    """(many, rows): 0 where the bit of a feature is set, else 1."""
    return np.stack([1.0 - (failed >> failed.dtype.type(i) & failed.dtype.type(1)) for i in range(many)])


@cache
def _points(many: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(many)


def leaf_values(share: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """(features, rows): Shapley values of a leaf of output 1, from each feature's share and whether each row passes its splits.

    A feature's value is the integral over t from 0 to 1 of the product of the others' (1 - t) share + t passed, times its own passed -
    share. The product is a polynomial, so that half as many points as features give the integral exactly.
    """
    at, weight = _points((len(share) + 1) // 2)
    at, weight = ((at + 1) / 2)[:, None], (weight / 2)[:, None]
    factor = share[:, None, None] * (1 - at) + passed[:, None, :] * at
    after = np.ones_like(factor)
    for i in range(len(share) - 1, 0, -1):
        np.multiply(after[i], factor[i], out=after[i - 1])
    before, out = np.broadcast_to(weight, factor.shape[1:]), np.empty_like(passed)
    for i, own in enumerate(share):
        out[i] = (passed[i] - own) * (before * after[i]).sum(0)
        before = before * factor[i]
    return out


def ensemble(model) -> Ensemble:
    """The node arrays of a fitted decision tree, random forest or gradient-boosted trees, for classes or numbers.

    A forest or tree for classes has an output a class, its share of the leaf's training rows (a forest's sum over trees is Spark's raw
    prediction, a single tree's is Spark's probability); boosted trees have one output, the margin. Saving the model to the shared folder gives
    its nodes as a table, as many as the model has; over MOST_NODES raise an error.
    """
    spark = SparkSession.active()
    model.write().save(path := new_path(spark, "model"))
    nodes = spark.read.parquet(f"{path}/data")
    nodes = nodes.select("treeID", "nodeData.*") if "treeID" in nodes.columns else nodes.select(F.lit(0).alias("treeID"), "*")
    many = nodes.count()
    if many > MOST_NODES:
        raise ValueError(f"{many} nodes pass the {MOST_NODES} that each executor may hold")
    cols = [F.col(c) for c in ("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild")]
    table = nodes.select(
        *cols, F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("how"), F.col("split.numCategories").alias("kinds")
    ).orderBy("treeID", "id").toPandas()
    kind = type(model).__name__
    classes = "Classification" in kind and not kind.startswith("GBT")
    trees = []
    for _, t in table.groupby("treeID"):
        stats = np.array(t["impurityStats"].tolist())
        cover = stats.sum(1) if classes else stats[:, 0]
        value = stats / cover[:, None] if classes else t["prediction"].to_numpy()[:, None]
        feature, how, kinds = t["feature"].to_numpy(), t["how"].tolist(), t["kinds"].to_numpy()
        split = feature >= 0
        threshold = np.array([h[0] if s and k < 0 else 0.0 for h, s, k in zip(how, split, kinds)])
        categories = {i: np.array(how[i]) for i in np.flatnonzero(split & (kinds >= 0)).tolist()}
        trees.append(Tree(feature, threshold, categories, t["leftChild"].to_numpy(), t["rightChild"].to_numpy(), cover, value))
    weights = [float(w) for w in model.treeWeights] if kind.startswith("GBT") else [1.0] * len(trees)
    if kind == "RandomForestRegressionModel":
        weights = [1 / len(trees)] * len(trees)
    return Ensemble(trees, weights)


def tree_contributions(model, rows: DataFrame, features: str = "features", key: str = "id") -> DataFrame:
    """key, base, contributions of every row: for each output the expected value and an array of each feature's part.

    The base and the parts of an output add up to the model's raw prediction (of a random forest for classes the sum over its trees, of
    boosted trees the margin). Rows with null features give nulls; an empty table gives no rows.
    """
    held = rows.sparkSession.sparkContext.broadcast(known := ensemble(model))
    base = [float(b) for b in known.base()]

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, values in _explained(held.value, batches):
            good = part["x"].notna().to_numpy()
            place = np.cumsum(good) - 1
            for at in range(0, len(part), ROWS):
                some, yes = part[at : at + ROWS], good[at : at + ROWS]
                parts = [values[p].tolist() if g else None for p, g in zip(place[at : at + ROWS], yes)]
                yield pd.DataFrame({key: some[key], "base": [base if g else None for g in yes], "contributions": parts}, index=some.index)

    kind = rows.schema[key].dataType.simpleString()
    x = F.when(F.col(features).isNotNull(), vector_to_array(features)).alias("x")
    return rows.select(key, x).mapInPandas(explain, f"{key} {kind}, base array<double>, contributions array<array<double>>")


def _explained(known: Ensemble, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Pieces of the batches with the contributions of their rows whose x is not null."""
    for batch in batches:
        good = batch["x"].dropna()
        step = known.rows_at_once(len(good.iloc[0])) if len(good) else ROWS
        for at in range(0, len(batch), step):
            part = batch[at : at + step]
            x = part["x"].dropna().tolist()
            yield part, known.contributions(np.stack(x)) if x else np.zeros((0, known.outputs, 0))


def tree_mean_sizes(model, rows: DataFrame, names: list[str], features: str = "features", top: int | None = None) -> DataFrame:
    """What ``mean_sizes`` gives of ``tree_contributions``; the parts are added up where they are worked out, so that they are no rows,
    and rows with the same features are explained once."""
    held = rows.sparkSession.sparkContext.broadcast(ensemble(model))

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, values in _explained(held.value, batches):
            total = np.tensordot(part["n"].to_numpy(float), np.abs(values).sum(1), 1)
            yield pd.DataFrame({"i": np.arange(len(total)), "size": total, "many": part["n"].sum() * values.shape[1]})

    known = rows.where(F.col(features).isNotNull()).select(vector_to_array(features).alias("x"))
    # By number, so that a small table too keeps all cores busy.
    kinds = known.repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism), "x").groupBy("x").agg(F.count("*").alias("n"))
    each = kinds.mapInPandas(sizes, "i int, size double, many long").groupBy("i").agg((F.sum("size") / F.sum("many")).alias("mean_size"))
    return _ranked(each, names, top)


def mean_sizes(contributions: DataFrame, names: list[str], top: int | None = None) -> DataFrame:
    """feature, mean_size, rank: the mean over rows and outputs of each feature's absolute part, largest first, by place on ties."""
    outputs = F.posexplode(F.flatten(F.transform("contributions", lambda c: F.transform(c, lambda v, i: F.struct(i.alias("i"), F.abs(v).alias("v"))))))
    each = contributions.select(outputs).select("col.*").groupBy("i").agg(F.avg("v").alias("mean_size"))
    return _ranked(each, names, top)


def _ranked(each: DataFrame, names: list[str], top: int | None) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    rank = F.row_number().over(Window.orderBy(F.desc("mean_size"), "i"))
    out = each.select(label.alias("feature"), "mean_size", rank.alias("rank"))
    return out if top is None else out.where(F.col("rank") <= top)
