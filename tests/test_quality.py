from datetime import datetime

import pytest
from conftest import collect
from pyspark.sql import functions as F

from polderlake.catalog import schema_of
from polderlake.operators import monitor, quality
from polderlake.operators.rollup import coarser_facts, minute_facts


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "a", 5.0), (2, None, -1.0), (3, "c", None), (3, "d", 500.0)],
        "id int, name string, v double")


def test_schema_report(people):
    contract = schema_of(id="long", name="string", gone="string")
    rows = {(r["check"], r["column"]): r["passed"]
            for r in quality.schema_report(people, "people", contract).collect()}
    assert rows == {("wrong_type", "id"): False, ("schema", "name"): True,
                    ("missing_column", "gone"): False, ("extra_column", "v"): False}
    typed = quality.type_report(people, "people", schema_of(id="long", name="integer"))
    assert {r["column"]: r["n_bad"] for r in typed.collect()} == {"id": 0, "name": 3}


def test_null_and_range_reports(people):
    nulls = quality.null_report(people, "people", ["id", "name", "v"]).collect()
    assert {r["column"]: (r["n_bad"], r["passed"]) for r in nulls} == {
        "id": (0, True), "name": (1, False), "v": (1, False)}
    ranges = quality.range_report(people, "people", [
        quality.RangeRule("v", low=0), quality.RangeRule("v", high=100), quality.RangeRule("id", 1, 3)])
    assert {r["column"]: r["n_bad"] for r in ranges.collect()} == {"v": 2, "id": 0}
    with pytest.raises(ValueError):
        quality.RangeRule("v").bad()


def test_reports_on_no_rows(people):
    none = people.where(F.lit(False))
    assert all(r["passed"] for r in quality.null_report(none, "p", ["id"]).collect())
    assert quality.grain_report(none, "p", ["id"]).first()["n_bad"] == 0
    assert quality.availability(none, "p").first() == ("p", False)
    assert quality.availability(people, "p").first() == ("p", True)


def test_grain(people):
    assert collect(quality.duplicate_grains(people, ["id"])) == [(3, 2)]
    assert not quality.grain_report(people, "p", ["id"]).first()["passed"]


def test_quarantine_splits_all_rows(people, tmp_path):
    rules = {"negative": F.col("v") < 0, "no_name": F.col("name").isNull(), "big": F.col("v") > 100}
    good, bad = quality.quarantine(people, rules)
    assert good.count() + bad.count() == people.count() and good.columns == people.columns
    assert {r.id: r.reasons for r in bad.collect()} == {2: ["negative", "no_name"], 3: ["big"]}
    quality.write_quarantine(people, rules, f"{tmp_path}/q")
    written = people.sparkSession.read.parquet(f"{tmp_path}/q").groupBy("dq_status").count()
    assert collect(written) == [("bad", 2), ("good", 2)]


def test_gate(spark):
    runs = spark.createDataFrame(
        [("s", "ok", "d", "A", 5, "success", "2"), ("s", "ok", "d", "B", 5, "success", "2"),
         ("s", "ok", "d", "A", 5, "success", "1"), ("s", "ok", "d", "B", None, "failed", "1"),
         ("s", "empty", "d", "A", 0, "success", "1"), ("s", "half", "d", "A", 9, "success", "1"),
         ("s", "half", "d", "B", None, "failed", "1")],
        "source string, dataset_name string, ingestion_date string, endpoint string, "
        "n_records bigint, status string, ingestion_datetime string")
    summary = quality.run_summary(runs)
    gates = {r.dataset_name: (r.n_endpoints, r.total_records, r.gate)
             for r in quality.run_gate(summary).collect()}
    assert gates == {"ok": (2, 10, "pass"), "empty": (1, 0, "warn"), "half": (2, 9, "fail")}
    with pytest.raises(ValueError, match="half d is failed"):
        quality.enforce_gate(summary)
    quality.enforce_gate(summary.where("dataset_name <> 'half'"))


def test_freshness_and_latency(spark):
    df = spark.sql("""SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01 10:00:00'),
      ('a', timestamp_ntz'2024-01-01 11:30:00'), ('b', timestamp_ntz'2024-01-01 01:00:00') t(k, ts)""")
    fresh = monitor.freshness(df, ["k"], "ts", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"), 1)
    assert {r.k: (r.age_hours, r.is_fresh) for r in fresh.collect()} == {"a": (0, True), "b": (11, False)}
    days = spark.sql("SELECT 1 k, date'2024-01-01' s, date_add(date'2024-01-01', cast(id as int)) e FROM range(1, 101)")
    out = monitor.latency(days, ["k"], F.col("s"), F.col("e")).first()
    assert (out.n, out.avg_days, out.p95_days) == (100, 50.5, 95.05)


def test_reconcile_and_lineage(spark):
    counts = monitor.layer_counts("x", [("bronze", spark.range(10)), ("silver", spark.range(7)),
                                        ("gold", spark.range(2))])
    flow = monitor.layer_reconcile(counts)
    assert collect(flow) == [("x", "bronze", "silver", 10, 7, 3), ("x", "silver", "gold", 7, 2, 5)]
    names = spark.createDataFrame([("x", n, f"t_{n}") for n in ("bronze", "silver", "gold")],
                                  "dataset string, layer string, table_name string")
    assert collect(monitor.lineage_edges(flow, names)) == [
        ("x", "t_bronze", "t_silver", 10, 7), ("x", "t_silver", "t_gold", 7, 2)]


def test_minutes_add_up_to_hours(spark):
    rows = [(datetime(2024, 1, 1, 10, m % 60, m), "a" if m % 3 else "b",
             None if m % 7 == 0 else m / 100) for m in range(59)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, k string, v double")
    minutes = minute_facts(df, "ts", ["k"], "v")
    assert minutes.agg(F.sum("n")).first()[0] == 59
    hours = coarser_facts(minutes, ["k"])
    direct = minute_facts(df, "ts", ["k"], "v", "1 hour", "hour")
    assert collect(hours) == collect(direct)
