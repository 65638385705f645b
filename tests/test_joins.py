import pytest
from conftest import collect
from pyspark.sql import functions as F

from polderlake.operators import joins, regions, rollup


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a sixth under null, many of them full copies."""
    ids = spark.range(0, 6_000, 1, 8)
    key = (F.when(F.col("id") % 3 == 0, F.lit(7))
           .when(F.col("id") % 6 == 1, F.lit(None).cast("int"))
           .otherwise((F.col("id") % 500).cast("int")))
    return ids.select(key.alias("k"), (F.col("id") % 5).alias("v"))


@pytest.fixture(scope="module")
def dimension(spark):
    return spark.range(0, 300).select(F.col("id").cast("int").alias("k"),
                                      F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(skewed, dimension, how):
    plain = skewed.join(dimension, ["k"], how)
    for side, limit in (("salted", 0), ("measured", 0), ("measured", 1 << 20)):
        got = joins.skew_safe_join(skewed, dimension, ["k"], how, side, limit)
        assert collect(got.select(plain.columns)) == collect(plain)


def test_hot_keys_and_their_spread(skewed, dimension):
    hot = joins.hot_keys(skewed, ["k"], partitions=48)
    assert {r["k"]: r["_pieces"] for r in hot} == {7: 17, None: 8}
    left, right = joins.salt_sides(skewed, dimension, ["k"], hot)
    per_salt = left.where("k = 7").groupBy("_salt").count().collect()
    assert len(per_salt) > 8 and max(r["count"] for r in per_salt) < 2_000 / 3
    assert right.where("k = 7").count() == 17 and right.where("k = 8").count() == 1
    assert left.count() == skewed.count()


def test_hot_keys_on_a_sample_and_none_at_all(spark, skewed, dimension):
    hot = joins.hot_keys(skewed, ["k"], partitions=24, sample_rows=3_000)
    assert {r["k"] for r in hot} == {7, None}
    even = spark.range(1_000).withColumn("k", (F.col("id") % 500).cast("int"))
    assert joins.hot_keys(even, ["k"], 100) == []
    out = joins.skew_safe_join(even, dimension, ["k"], "left", "salted")
    assert collect(out) == collect(even.join(dimension, ["k"], "left"))
    assert "_salt" not in out._jdf.queryExecution().executedPlan().toString()
    assert joins.hot_keys(even.limit(0), ["k"]) == []


def test_copies_of_one_row_spread(spark):
    copies = spark.range(0, 4_000, 1, 32).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    hot = joins.hot_keys(copies, ["k"], partitions=8)
    left, _ = joins.salt_sides(copies, copies.limit(1).select("k"), ["k"], hot)
    assert left.select("_salt").distinct().count() > 4


def test_salts_are_the_same_when_a_task_runs_again(skewed, dimension):
    hot = joins.hot_keys(skewed, ["k"], partitions=64)
    left, _ = joins.salt_sides(skewed.withColumn("p", F.spark_partition_id()), dimension, ["k"], hot)
    assert collect(left) == collect(left)


def test_several_key_columns(spark):
    left = spark.range(0, 3_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("x")).otherwise(F.col("id").cast("string")).alias("a"),
        (F.col("id") % 2).alias("b"), F.col("id").alias("v"))
    right = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 2.0), ("7", 1, 3.0)], "a string, b bigint, w double")
    out = joins.skew_safe_join(left, right, ["a", "b"], "left", "salted")
    assert collect(out) == collect(left.join(right, ["a", "b"], "left"))


def test_size_check_counts_text_and_nested_values(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2, 3])] * 10, "t string, a array<int>")
    assert joins.fits_broadcast(df, 20_000)
    assert not joins.fits_broadcast(df, 10_000)
    assert not joins.fits_broadcast(df, 100)
    assert joins.fits_broadcast(df.limit(0), 1)


def test_enrich_does_not_fan_out(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, 10, "2024-01-01"), (1, 20, "2024-01-02")],
                                  "k int, v int, ingestion_date string")
    out = joins.enrich(left, right, ["k"], ["v"], latest_by="ingestion_date")
    assert collect(out) == [(1, "a", 20), (2, "b", None)]


def test_lookup_default_and_wide_join(spark):
    fact = spark.createDataFrame([(1,), (9,)], "k int")
    dim = spark.createDataFrame([(1, "one")], "k int, title string")
    other = spark.createDataFrame([(9, 0.5)], "k int, score double")
    assert collect(joins.lookup(fact, dim, ["k"], ["title"], "UNKNOWN")) == [(1, "one"), (9, "UNKNOWN")]
    wide = joins.wide_join(fact, [(dim, ["title"]), (other, ["score"])], ["k"])
    assert collect(wide) == [(1, "one", None), (9, None, 0.5)]


def test_orphans_count_null_keys_as_orphans(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    for limit in (0, 1 << 20):
        assert collect(joins.orphans(child, parent, ["k"], limit)) == [(2,), (None,)]
        assert collect(joins.restrict_to(child, parent, ["k"], limit)) == [(1,)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_regions_equal_brute_force(spark, limit):
    boxes = [("a", 0.0, 0.0, 2.0, 2.0), ("b", 1.5, 1.5, 4.0, 3.0), ("c", -3.0, -1.0, -0.5, 5.0)]
    points = [(i, -4 + (i * 7 % 90) / 10, -2 + (i * 13 % 80) / 10) for i in range(300)]
    points += [(1000 + i, 0.5, 0.5) for i in range(150)]
    p = spark.createDataFrame(points, "id int, x double, y double")
    b = spark.createDataFrame(boxes, "region_id string, x_min double, y_min double, x_max double, y_max double")
    out = regions.assign_region(p, b, "x", "y", cell=1.0, max_bytes=limit).select("id", "region_id")
    want = []
    for i, x, y in points:
        hits = [n for n, x0, y0, x1, y1 in boxes if x0 <= x < x1 and y0 <= y < y1]
        want += [(i, h) for h in hits or [None]]
    assert collect(out) == sorted(want, key=repr)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_rollup_through_a_dimension(skewed, dimension, limit):
    measures = [rollup.Measure("n", "count", "v"), rollup.Measure("total", "sum", "v"),
                rollup.Measure("mean", "avg", "v"), rollup.Measure("lo", "min", "v"),
                rollup.Measure("hi", "max", "v")]
    want = rollup.rollup(skewed.join(dimension, "k"), ["name", "v"], measures)
    got = rollup.rollup_through(skewed, dimension, ["k"], ["name"], ["v"], measures, limit)
    assert collect(got.select(want.columns)) == collect(want)


def test_unknown_join_kinds_are_refused(skewed, dimension):
    with pytest.raises(ValueError):
        joins.skew_safe_join(skewed, dimension, ["k"], "full_outer")
    with pytest.raises(ValueError):
        joins.skew_safe_join(skewed, dimension, ["k"], side="guess")
