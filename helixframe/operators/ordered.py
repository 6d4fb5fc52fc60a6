"""Positions and running sums over a whole order, by ranges: no task holds more than its range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.storage import stored


def running(df: DataFrame, order: list[str], value: str | None = None, name: str = "at") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all earlier rows in ``order`` (without a value: the number of them).

    The order must be total. Rows go to sorted ranges, which are stored, so that their numbers stay; sums within a range follow
    those of the ranges before it, of which there is one row a range. Null values count as 0; an empty table stays empty.
    """
    worth = F.lit(1).cast("long") if value is None else F.coalesce(F.col(value), F.lit(0))
    rows = df.withColumn("__worth", worth).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("__range", F.spark_partition_id()), "ranges")
    zero = F.lit(0).cast(rows.schema["__worth"].dataType)
    sums = rows.groupBy("__range").agg(F.sum("__worth").alias("__sum"))
    ahead = F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), zero)
    sums = sums.select("__range", ahead.alias("__ahead"))
    within = F.sum("__worth").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("__within", F.coalesce(within, zero)).join(sums, "__range")
    return out.select(*df.columns, (F.col("__ahead") + F.col("__within")).alias(name))


def blocks(df: DataFrame, size: int, before: int = 0, after: int = 0, at: str = "at") -> DataFrame:
    """``df`` with ``block``: rows of ``size`` places each, and copies of the last ``before`` rows of the block before and the first
    ``after`` of the next, at most one block away."""
    if before > size or after > size:
        raise ValueError("borders are at most one block wide")
    own, place = F.floor(F.col(at) / size).cast("long"), F.col(at) % size
    to = F.array_compact(F.array(own, F.when((place < after) & (own > 0), own - 1), F.when(place >= size - before, own + 1)))
    return df.withColumn("block", F.explode(to))
