from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_lookup_equals_plain_join(spark, how):
    # Key 0 holds a third of the rows.
    big = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40 + 1).cast("int").alias("k"),
        (F.col("id") % 2).cast("int").alias("j"),
    )
    small = spark.createDataFrame([(k, k % 2, f"v{k}") for k in range(0, 30, 2)], "k int, j int, v string")
    expected = sorted(map(tuple, big.join(small, ["k", "j"], how).collect()), key=str)
    found = skew.salted_lookup(big, small, ["k", "j"], how, "id", rows_per_split=10)
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert skew.split_plan(big, ["k"], 10).where("k = 0").first()["__parts"] == 30


def test_broadcast_is_size_checked(spark):
    small = spark.range(5).withColumn("t", F.lit("abc"))
    hinted = skew.broadcast_if_small(small, 10, 100)
    assert "strategy=broadcast" in hinted._jdf.queryExecution().analyzed().toString()
    assert skew.broadcast_if_small(small, 4, 100) is small
    assert skew.broadcast_if_small(small, 10, 14) is small
    nested = small.withColumn("a", F.array("t"))
    assert skew.broadcast_if_small(nested, 10, 100) is nested


def test_null_keys_and_many_split_keys(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 600).alias("k"))
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 600, 7)], "k long, v string")
    for how in ("left", "left_anti", "inner"):
        expected = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
        found = skew.salted_lookup(big, small, ["k"], how, "id", rows_per_split=1)
        assert sorted(map(tuple, found.collect()), key=str) == expected
