"""Stateless sequence operators on a stream of files: the batch functions run unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_operator(spark: SparkSession, path: str, schema: StructType, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A streaming DataFrame: new Parquet files under ``path`` through a row-wise operator."""
    return operator(spark.readStream.schema(schema).parquet(path))
