"""Tabular profiling: every statistic of all columns in one aggregation where that is possible."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def long_form(df: DataFrame, stats: dict[str, dict[str, Column]], key: str = "column") -> DataFrame:
    """One aggregation over all columns, given back as one row a column."""
    names = list(stats)
    kinds = list(next(iter(stats.values())))
    one = df.agg(*[stats[c][k].alias(f"{i}_{k}") for i, c in enumerate(names) for k in kinds])
    rows = F.array(*[F.struct(F.lit(c).alias(key), *[F.col(f"{i}_{k}").alias(k) for k in kinds]) for i, c in enumerate(names)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, n): how often each column has each value, nulls counted as well. Everything that follows
    from values and their counts is then taken from these rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    return df.select(cells).select("x.*").groupBy("column", "v").agg(F.count("*").alias("n"))


def quantiles(values: DataFrame, points: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """column and the exact interpolated quantiles q25, ... of ``counted`` rows.

    Ranks come from running sums in two steps: within ranges of values, and over the few ranges, so no
    task orders all values of a column.
    """
    known = values.where("v is not null")
    bounds = known.groupBy("column").agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 2000).alias("cuts"), F.sum("n").alias("total"))
    placed = known.join(F.broadcast(bounds), "column")
    placed = placed.select("column", "v", "n", "total", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    parts = placed.groupBy("column", "part").agg(F.sum("n").alias("m"))
    earlier = F.coalesce(F.sum("m").over(Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("column", "part", earlier.alias("earlier"))
    w = Window.partitionBy("column", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(F.broadcast(parts), ["column", "part"]).withColumn("upto", F.col("earlier") + F.sum("n").over(w))
    below = F.col("upto") - F.col("n")
    picks = []
    for q in points:
        at = (F.col("total") - 1) * q
        at_rank = lambda r: F.max(F.when((below <= r) & (r < F.col("upto")), F.col("v")))
        low, high = at_rank(F.floor(at)), at_rank(F.ceil(at))
        picks.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"q{round(q * 100)}"))
    return ranked.groupBy("column").agg(*picks)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts, moments, extremes and quartiles of numeric columns, from one count of values a column."""
    values = counted(df, columns)
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    n, total = F.coalesce(F.sum(known), F.lit(0)), F.sum(F.col("v") * F.col("n"))
    one = values.groupBy("column").agg(
        n.alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("distinct"),
        (total / F.nullif(n, F.lit(0))).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
    )
    far = values.join(F.broadcast(one.select("column", "mean")), "column").groupBy("column").agg(F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), F.lit(2.0))).alias("ss"))
    out = one.join(far, "column").join(quantiles(values), "column", "left")
    std = F.sqrt(F.col("ss") / F.nullif(F.greatest(F.col("n") - 1, F.lit(0)), F.lit(0)))
    return out.select("column", "n", "missing", "distinct", "mean", std.alias("std"), "min", "max", "q25", "q50", "q75")


def distribution_shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population skewness, excess kurtosis and a label; columns of at most ten values are left out."""
    out = long_form(df, {c: {"n": F.count(c), "skew": F.skewness(c), "kurt": F.kurtosis(c)} for c in columns}).where("n > 10")
    label = (
        F.when(F.col("skew") > 1, "Right-skewed").when(F.col("skew") < -1, "Left-skewed")
        .when(F.col("kurt") > 3, "Heavy-tailed").when(F.col("kurt") < -3, "Light-tailed").otherwise("Normal")
    )
    return out.withColumn("shape", label)


def iqr_bounds(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    values = counted(df, columns)
    n = values.where("v is not null").groupBy("column").agg(F.sum("n").alias("n"))
    out = n.join(quantiles(values, (0.25, 0.75)), "column").withColumnsRenamed({"q25": "q1", "q75": "q3"})
    gap = (F.col("q3") - F.col("q1")) * factor
    return out.select("column", "n", (F.col("q1") - gap).alias("low"), (F.col("q3") + gap).alias("high"))


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values lie strictly outside the quartiles' fences, and their percentage."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    joined = cells.select("x.*").join(F.broadcast(iqr_bounds(df, columns)), "column").where("n > 10")
    out = F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high")))
    return joined.groupBy("column").agg(out.alias("outliers"), (out * 100.0 / F.count("v")).alias("percentage"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (a, b, r) of the unordered pairs, pairwise complete, in one aggregation."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def feature_relationships(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column its strongest positive and negative partner and the mean strength."""
    c = correlations(df, columns)
    both = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return both.groupBy("a").agg(
        F.max_by("b", F.struct("r", "b")).alias("strongest_positive"), F.min_by("b", F.struct("r", "b")).alias("strongest_negative"),
        F.avg(F.abs("r")).alias("mean_strength"),
    )


def quality_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, deviation, distinct values and values over three deviations from the mean."""
    values = counted(df, columns)
    stats = long_form(df, {c: {"mean": F.avg(c), "std": F.stddev_samp(c)} for c in columns})
    stats = stats.join(values.groupBy("column").agg(F.count("v").alias("distinct")), "column").join(quantiles(values, (0.5,)).withColumnRenamed("q50", "median"), "column", "left")
    stats = stats.select("column", "mean", "median", "std", "distinct")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    far = cells.select("x.*").join(F.broadcast(stats), "column").groupBy("column")
    return stats.join(far.agg(F.count_if(F.abs(F.col("v") - F.col("mean")) > 3 * F.col("std")).alias("outliers")), "column")


def quality_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("x"))
    counts = cells.select("x.*").where("v is not null").groupBy("column", "v").count()
    return counts.groupBy("column").agg(
        F.count("*").alias("distinct"), F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("mode"),
        F.max("count").alias("mode_count"), F.min_by("v", F.struct("count", "v")).alias("rarest"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; nulls are equal."""
    per = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return per.agg(F.sum("__n").alias("total"), F.sum(F.col("__n") - 1).alias("duplicates"))


def quality_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """0 to 100 from the shares of missing cells, repeated rows and far values."""
    missing = reduce(lambda a, b: a + b, [F.sum(F.col(c).isNull().cast("bigint")) for c in df.columns])
    cells = df.agg((missing * 100.0 / (F.count("*") * len(df.columns))).alias("missing"), F.count("*").alias("rows"))
    far = quality_numeric(df, columns).agg(F.sum("outliers").alias("far"))
    one = cells.crossJoin(duplicate_rows(df)).crossJoin(far)
    off = (
        F.least(F.col("missing") * 2, F.lit(40.0)) + F.least(F.col("duplicates") * 300.0 / F.col("rows"), F.lit(30.0))
        + F.least(F.col("far") * 100.0 / F.col("rows"), F.lit(20.0))
    )
    return one.select(F.round(F.greatest(F.lit(100.0) - off, F.lit(0.0)), 2).alias("score"), "rows", "duplicates", "far")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins from the least to the largest value, the last one closed."""
    span = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null").crossJoin(F.broadcast(span))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.when(width == 0, 1.0).otherwise(width)), F.lit(bins - 1)))
    return v.groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def outlier_samples(df: DataFrame, column: str, key: str, first: int = 10) -> DataFrame:
    """The first values outside the quartiles' fences, by key; the number is the report's feature."""
    fences = iqr_bounds(df, [column]).select("low", "high")
    far = df.crossJoin(F.broadcast(fences)).where((F.col(column) < F.col("low")) | (F.col(column) > F.col("high")))
    return far.orderBy(key).limit(first).select(key, column)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def length_profile(df: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return df.agg(F.count("*").alias("rows"), F.min(n).alias("min"), F.max(n).alias("max"), F.round(F.avg(n), 6).alias("mean"))
