"""Registered SQL functions against the same functions on columns."""

import pytest
from pyspark.sql import functions as F

from helixframe import sql

TEXTS = ["ATGAAATAACCGTGA", "", "a", "acgun-RYX*", "ATG" + "GCC" * 40 + "TAA", "MKWVTFISLLFLFSSAYSRGVFRR", ">id it's 5\\' tumor", None, "GCGCGCGCATATAT" * 5, "BLACTAMTTSSKINASEATP"]


@pytest.fixture(scope="module")
def rows(spark):
    sql.register(spark, "bio_")
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id long, s string")
    frame.createOrReplaceTempView("texts")
    return frame


@pytest.mark.parametrize("name", sorted(sql.FUNCTIONS))
def test_function_equals_its_column(spark, rows, name):
    # Each side sees the same rows: those that a column of this function can take.
    want = {r["id"]: r["v"] for r in rows.select("id", sql.FUNCTIONS[name](F.col("s")).alias("v")).collect()}
    got = spark.sql(f"select id, bio_{name}(s) as v from texts")
    assert {r["id"]: r["v"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and got.schema["v"].dataType == rows.select(sql.FUNCTIONS[name](F.col("s")).alias("v")).schema["v"].dataType
