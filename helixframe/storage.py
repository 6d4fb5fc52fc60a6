"""Tables that an operator writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A session of one machine that names none gets a new temporary one; a cluster must name it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lost executors do not replay what came before."""
    df.write.parquet(path := new_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` stored in as many partitions as there are cores, dealt by a hash of the key and sorted by it.

    A fit reads its rows many times, with one task a partition: a small table of one file would keep one core busy, and what the
    rows come from would be worked out each time.
    """
    many = max(2, df.sparkSession.sparkContext.defaultParallelism)
    return stored(df.repartition(many, F.xxhash64(key)).sortWithinPartitions(key))
