"""Metadata-style queries: visibility, filters, dynamic sort, paging, status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, sort_by: str, order: str = "desc", skip: int = 0, limit: int = 100, default: str | None = None, tie: str | None = None) -> DataFrame:
    """One page, at most 1000 rows; an unknown column sorts by ``default``; ascending only for 'asc'."""
    c = F.col(sort_by if sort_by in df.columns else default)
    keys = [c.asc() if order == "asc" else c.desc(), *([F.col(tie)] if tie else [])]
    return df.orderBy(*keys).offset(skip).limit(min(limit, 1000))


def visible(df: DataFrame, mine: Column, public: Column, **equal: object) -> DataFrame:
    out = df.where(mine | public)
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def status_counts(df: DataFrame, status: str, groups: dict[str, list[str]]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(status).isin(values)).alias(name) for name, values in groups.items()])


def job_stats(df: DataFrame, user: str, status: str, duration: str) -> DataFrame:
    """By user: rows, rows done, and sum and mean of the positive durations."""
    known = F.when(F.col(duration) > 0, F.col(duration))
    return df.groupBy(user).agg(
        F.count("*").alias("jobs"), F.count_if(F.col(status) == "F").alias("done"), F.sum(known).alias("total"), F.avg(known).alias("mean")
    )


def best_by(df: DataFrame, group: str, metric: str, key: str) -> DataFrame:
    """The row with the largest metric in each group, the smallest key on ties."""
    return df.groupBy(group).agg(F.min_by(key, F.struct(-F.col(metric), F.col(key))).alias("best"), F.max(metric).alias("metric"))


def lookup(df: DataFrame, key: str, value: object, mine: Column, public: Column) -> DataFrame:
    """The row of a key if it may be seen, else none."""
    return df.where(F.col(key) == value).where(mine | public).limit(1)


def preview(df: DataFrame, order: str, rows: int = 10) -> DataFrame:
    """The first rows by ``order`` with 0 for missing numbers."""
    return df.orderBy(order).limit(rows).na.fill(0)


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows of which a column holds the term, whatever its case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(term.lower()))
    return df.where(hit)


def class_of(df: DataFrame, key: str) -> DataFrame:
    """``class``: the first run of letters and underscores in the key, unknown without one."""
    found = F.regexp_extract(F.col(key), "([a-zA-Z_]+)", 1)
    return df.withColumn("class", F.when(found == "", "unknown").otherwise(found))


def fastest(df: DataFrame, key: str, seconds: str) -> DataFrame:
    return df.agg(F.min_by(key, F.struct(seconds, key)).alias("fastest"), F.min(seconds).alias("least"))


def top_importances(df: DataFrame, many: int = 15, prefix: str = "") -> DataFrame:
    """The most important features, by name on ties; only those of a prefix if there is one."""
    return df.where(F.col("feature").startswith(prefix)).orderBy(F.desc("importance"), "feature").limit(many)


def page_total(df: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """How many rows there are in all and on the page."""
    lim = min(limit, 1000)
    return df.agg(F.count("*").alias("total")).select(
        "total", F.lit(skip).alias("skip"), F.lit(lim).alias("lim"), F.least(F.greatest(F.col("total") - skip, F.lit(0)), F.lit(lim)).alias("returned")
    )


def job_kinds(df: DataFrame, user: str, *fields: str) -> DataFrame:
    """Long form: by user and field, how many rows have each value."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    return df.select(user, cells).groupBy(user, "x.field", "x.value").agg(F.count("*").alias("n"))
