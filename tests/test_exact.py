"""Sums that keep every digit, and names that clash with the operators' own."""

import itertools
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import collect
from pyspark.sql import functions as F

from polderlake.functions.scalars import exact_sum, fresh
from polderlake.operators import dedupe, incremental, paging
from polderlake.operators.rollup import Measure, rollup


def total(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return df.repartition(3).agg(exact_sum(df, "v").alias("s")).first()["s"]


@pytest.mark.parametrize("values", [
    [0.1] * 10, [1e-20, 3e-20], [9e11] * 50, [9e23] * 200, [1e12, 0.01, -1e12], [5e-9, 7e-10, 2e-11],
    [123456.789, 0.000123, 99999999999.99, 100000000000.01], [1e17, 1.0, 2.0], [-0.5, 0.25, -1e15],
    [0.0, -0.0], [1e11, 0.1, 0.2], [2.0 ** 60, 3.0, 0.125]])
def test_sums_are_those_of_decimals_in_any_order(spark, values):
    want = float(sum(Decimal(repr(v)) for v in values))
    assert {total(spark, v) for v in (values, values[::-1])} == {want}


def test_sums_of_what_is_no_decimal(spark):
    assert total(spark, [float("inf"), 1.0]) == float("inf")
    assert total(spark, [float("nan"), 1.0]) != total(spark, [float("nan"), 1.0])
    assert total(spark, [None, None]) is None and total(spark, [None, 2.0]) == 2.0
    assert total(spark, [1e300, 1e299]) == 1.1e300


def test_merged_parts_equal_one_sum(spark):
    df = spark.range(1_000).select((F.col("id") % 7).alias("k"), F.expr(
        "element_at(array(1e-15D, 0.1D, 12345.67D, 1e13D, 3e21D), cast(id % 5 as int) + 1)").alias("v"))
    want = float(sum(Decimal(repr(v)) for v in itertools.islice(
        itertools.cycle([1e-15, 0.1, 12345.67, 1e13, 3e21]), 1_000)))
    assert rollup(df.withColumn("one", F.lit(1)), ["one"], [Measure("s", "sum", "v")]).first()["s"] == want


def test_keys_are_compared_by_value(spark):
    at = lambda us: datetime(2024, 1, 1, 0, 0, 0, us)
    base = spark.createDataFrame([(at(123456), 0.0, 1), (at(500000), 1.0, 2), (None, None, 3)],
                                 "t timestamp_ntz, d double, v int")
    delta = spark.createDataFrame([(at(123999), 0.0, 9), (None, None, 8)], "t timestamp_ntz, d double, v int")
    for side in ("unique", "salted"):
        got = incremental.upsert(base, delta, ["t", "d"], side=side)
        assert sorted(r["v"] for r in got.collect()) == [1, 2, 8, 9]
    zero = spark.createDataFrame([(at(123456), -0.0, 5)], "t timestamp_ntz, d double, v int")
    assert sorted(r["v"] for r in incremental.upsert(base, zero, ["t", "d"]).collect()) == [2, 3, 5]
    wider = spark.createDataFrame([(1, 2), (2, 3)], "k int, v int")
    longer = spark.createDataFrame([(1, 7), (5_000_000_000, 8)], "k long, v int")
    assert collect(incremental.upsert(wider, longer, ["k"])) == [(1, 7), (2, 3), (5_000_000_000, 8)]


def test_columns_named_like_the_operators_own_stay(spark):
    names = ["_rank", "_row", "_from", "_id", "_range", "_place", "_before", "_n", "_key", "_old", "_new"]
    df = spark.createDataFrame([(k, v, *range(len(names))) for k, v in [(1, 1), (1, 2), (2, 1)]],
                               ", ".join(f"{c} int" for c in ["k", "v", *names]))
    latest = dedupe.dedupe_latest(df, ["k"], "v")
    assert latest.columns == df.columns and latest.count() == 2
    assert collect(incremental.upsert(df, latest, ["k"]).select("k", "v", *names)) == collect(latest)
    assert {r["change"] for r in incremental.detect_changes(df, latest, ["k"], ["v", *names]).collect()} == {"same"}
    pages = paging.assign_pages(df, "k", page_size=2)
    assert set(df.columns) <= set(pages.columns) and pages.where("_id = 3 AND _rank = 0").count() == 3
    assert fresh("_A", df.withColumnRenamed("k", "_a")) == "__A"
