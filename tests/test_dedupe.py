from conftest import collect
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polderlake.catalog import STATISTICS
from polderlake.operators import dedupe, incremental, joins, paging
from polderlake.sources import landing

ROWS = st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 3)),
                          st.integers(0, 3)), max_size=12)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, ts int, v int")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=ROWS)
def test_latest_is_the_greatest_and_idempotent(spark, rows):
    df = frame(spark, rows)
    once = dedupe.dedupe_latest(df, ["k"], "ts")
    best = {}
    for k, ts, v in rows:
        rank = (ts is not None, ts or 0, v)
        if k not in best or rank > best[k][0]:
            best[k] = (rank, (k, ts, v))
    assert collect(once) == sorted((b[1] for b in best.values()), key=repr)
    assert collect(dedupe.dedupe_latest(once, ["k"], "ts")) == collect(once)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=ROWS)
def test_upsert_of_nothing_changes_nothing(spark, rows):
    base = dedupe.dedupe_latest(frame(spark, rows), ["k"], "ts")
    nothing = base.where(F.lit(False))
    assert collect(incremental.upsert(base, nothing, ["k"])) == collect(base)
    assert collect(incremental.upsert(nothing, base, ["k"])) == collect(base)


def test_order_of_rows_does_not_matter(spark):
    rows = [(1, 5, 1), (1, 5, 2), (1, 5, 2), (2, None, 1), (2, 1, 0)]
    for order in (rows, rows[::-1]):
        df = frame(spark, order).repartition(3)
        assert collect(dedupe.dedupe_latest(df, ["k"], "ts")) == [(1, 5, 2), (2, 1, 0)]


def test_null_keys_form_one_group(spark):
    df = frame(spark, [(None, 1, 1), (None, 2, 2)])
    assert collect(dedupe.dedupe_latest(df, ["k"], "ts")) == [(None, 2, 2)]


def test_hot_key_shuffles_one_row_per_task(spark):
    df = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("ts"))
    out = dedupe.dedupe_latest(df, ["k"], "ts")
    assert out.where("k = -1").first()["ts"] == 29_997
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_grain_comes_from_the_catalogue(spark):
    spec = STATISTICS[2]
    df = spark.createDataFrame(
        [("GM1", "A", "2020JJ00", "flat", 1), ("GM1", "A", "2020JJ00", "flat", 2),
         ("GM1", "A", "2020JJ00", "house", 3)], spec.schema)
    out = dedupe.dedupe_by_grain(df, spec, "AantalWoningen_1")
    assert sorted(r.AantalWoningen_1 for r in out.collect()) == [2, 3]


def test_exact_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "id int, t string")
    assert collect(dedupe.drop_exact_duplicates(df, ["t"], "id")) == [(1, "x"), (2, "y")]
    assert dedupe.drop_exact_duplicates(df.select("t")).count() == 2
    assert dedupe.drop_exact_duplicates(df, ["t"]).count() == 2


def test_snapshot_over_loads(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-01"), (1, "b", "2024-01-02"), (2, "c", "2024-01-01")],
                               "k int, v string, ingestion_date string")
    assert collect(dedupe.latest_snapshot(df, ["k"])) == [
        (1, "b", "2024-01-02"), (2, "c", "2024-01-01")]


def test_changes_are_labelled(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, None), (5, "e")], "k int, v string")
    assert collect(incremental.detect_changes(old, new, ["k"], ["v"])) == [
        (1, "same"), (2, "same"), (3, "changed"), (4, "missing"), (5, "new")]


def test_upsert_takes_the_latest_of_the_delta_and_new_columns(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, ts int, v string")
    delta = spark.createDataFrame([(1, 2, "x", 9), (1, 3, "y", 9)], "k int, ts int, v string, w int")
    assert collect(incremental.upsert(base, delta, ["k"], latest_by="ts")) == [
        (1, 3, "y", 9), (2, 1, "b", None)]


def test_rows_with_maps(spark):
    df = spark.sql("SELECT id % 2 AS k, id AS ts, map('a', id) AS m FROM range(6)")
    latest = dedupe.dedupe_latest(df.drop("ts").withColumn("ts", F.lit(1)), ["k"], "ts")
    assert {r.k: r.m["a"] for r in latest.collect()} == {0: 4, 1: 5}
    right = spark.createDataFrame([(0, "zero")], "k bigint, name string")
    out = joins.skew_safe_join(df, right, ["k"], "left", "salted")
    assert out.where("name = 'zero'").count() == 3 and out.count() == 6
    assert paging.assign_pages(df, "k", 2).select("row_idx").distinct().count() == 6
    assert landing.bundle(df, 2).select(F.explode("rows")).count() == 6
