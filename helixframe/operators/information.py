"""Mutual information of continuous features and a class, by nearest neighbours, over sorted ranges."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import ordered
from helixframe.storage import stored

#: Sorted values of a range that one task looks at.
RANGE = 1 << 16


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1 on: six steps up, then the asymptotic series."""
    x = n + 6
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return reduce(lambda a, k: a - 1 / (n + k), range(6), series)


def nearest_in_class(values: DataFrame, k: int) -> DataFrame:
    """``values`` (feature, label, x, id) with d, the distance to the k-th nearest value of the same feature and label (the farthest of
    fewer; rows alone in their class are left out), near (how many), low and high: the ends of the open interval nearer than d.

    Rows are sorted by class and value in ranges, which carry k rows across their borders.
    """
    placed = ordered.running(values, ["feature", "label", "x", "id"])

    def look(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", ignore_index=True)
        own = (group["at"] // size == group["block"]).to_numpy()
        x = group["x"].to_numpy()
        kind = pd.factorize(pd.MultiIndex.from_frame(group[["feature", "label"]]))[0]
        gaps = np.full((2 * k, len(x)), np.inf)
        for j in range(1, min(k, len(x) - 1) + 1):
            same = kind[j:] == kind[:-j]
            gap = np.where(same, x[j:] - x[:-j], np.inf)
            gaps[j - 1, j:], gaps[k + j - 1, :-j] = gap, gap
        near = np.minimum(np.isfinite(gaps).sum(0), k)
        d = np.take_along_axis(np.sort(gaps, 0), np.maximum(near - 1, 0)[None, :], 0)[0]
        # An end that is a value of the class is taken as it is: x + d may miss it by a rounding.
        ends = []
        for side, sign in ((slice(0, k), -1), (slice(k, 2 * k), 1)):
            step = np.argmax(gaps[side] == d, 0) + 1
            other = np.clip(np.arange(len(x)) + sign * step, 0, len(x) - 1)
            with np.errstate(invalid="ignore"):
                ends.append(np.where((gaps[side] == d).any(0), x[other], x + sign * d))
        out = group[["feature", "label", "x", "id"]].assign(d=d, near=near, low=ends[0], high=ends[1])
        return out[own & (near > 0)]

    size = max(RANGE, k)
    kinds = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in ("feature", "label", "x", "id"))
    return ordered.blocks(placed, size, k, k).groupBy("block").applyInPandas(look, f"{kinds}, d double, near long, low double, high double")


def mutual_information(df: DataFrame, key: str, columns: list[str], label: str, k: int = 3) -> DataFrame:
    """feature, information in nats: how much each continuous column tells of the class, by the k nearest neighbours of its class.

    For each row the values of all classes nearer than its k-th neighbour of the same class are counted, by a sorted search over
    ranges; the counts' digammas give the estimate, at least 0. Null and NaN values and null labels are left out by feature; classes of one row
    are left out. Repeated values lie at distance 0, where the equal values are counted. The key must be unique. A feature without rows is missing.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")
    values = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), each).select("v.feature", "label", "v.x", "id")
    values = values.where("label is not null and x is not null and not isnan(x)")
    found = stored(nearest_in_class(values, k))
    zero = F.col("d") == 0

    def marks(v: str, order: Column, data: int, end: int) -> DataFrame:
        return found.select("feature", F.col(v).alias("v"), order.alias("order"), "id", F.lit(data).cast("long").alias("data"), F.lit(end).cast("long").alias("end"))

    # Values equal to an end lie outside the open interval; those equal to a repeated value lie inside.
    sides = [marks("x", F.lit(1), 1, 0), marks("low", F.when(zero, 0).otherwise(2), 0, -1), marks("high", F.when(zero, 2).otherwise(0), 0, 1)]
    both = reduce(lambda a, b: a.unionByName(b), sides)
    before = ordered.running(both, ["feature", "v", "order", "id", "end"], "data", "before")
    counts = before.where("end <> 0").groupBy("feature", "id").agg(F.sum(F.col("end") * F.col("before")).alias("m"))
    size = found.groupBy("feature", "label").agg(F.count("*").alias("size"))
    per = found.join(counts, ["feature", "id"]).join(size, ["feature", "label"])
    mean = lambda c: F.avg(digamma(F.col(c).cast("double")))
    told = per.groupBy("feature").agg((digamma(F.count("*").cast("double")) + mean("near") - mean("size") - mean("m")).alias("i"))
    return told.select("feature", F.greatest(F.col("i"), F.lit(0.0)).alias("information"))
