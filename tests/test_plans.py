import json
import os
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import collect

import __spark_entry__ as driver
from polderlake.catalog import STATISTICS, bronze_path, gold_path, load_catalog, schema_of, silver_path, DatasetSpec
from polderlake.plans import daily, gold, silver
from polderlake.sources import landing, readers, tables

RUN_TS = datetime(2024, 2, 1, 6)
SPECS = {s.name: s for s in load_catalog(STATISTICS).values()}


def land(spark, root, name, rows, date, pages=False):
    spec = SPECS[name]
    base = f"{bronze_path(root, spec)}/ingestion_date={date}"
    df = spark.createDataFrame(rows, spec.schema)
    if pages:
        landing.land_pages(df, f"{base}/typed_dataset", 2)
    else:
        landing.land_envelopes(df, f"{base}/typeddataset.json", 2)


def D(x):
    return Decimal(x)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Two loads; the second repeats and changes grains, and one date is loaded twice."""
    root = str(tmp_path_factory.mktemp("lake"))
    bronze = f"{root}/bronze"
    figures = [("GM1", "Aa", "Gemeente", "2020JJ00", 100, 40, D("20.5")),
               ("GM1 ", "Aa", "Gemeente", "2020JJ00", 100, 40, D("20.5")),
               ("GM2", "Bee", "Gemeente", "2020JJ00", 50, 20, None),
               (None, "?", "Gemeente", "2020JJ00", 1, 1, None)]
    later = [("GM1", "Aa", "Gemeente", "2020JJ00", 110, 41, D("21.5"))]
    worth = [("GM1", "Aa", "2020JJ00", D("250")), ("GM3", "Cee", "2020JJ00", D("300"))]
    stock = [("GM1", "Aa", "2020JJ00", "flat", 30), ("GM1", "Aa", "2020JJ00", "house", 10),
             ("GM2", "Bee", "2020JJ00", "flat", 20)]
    income = [("GM1", "Aa", "2020JJ00", D("50"), D("45")), ("GM9", "Nee", "2020JJ00", D("1"), D("1"))]
    for date, rows in (("2024-02-01", figures), ("2024-02-02", later)):
        land(spark, bronze, "neighbourhood_key_figures", rows, date)
        land(spark, bronze, "average_woz_value", worth, date)
        land(spark, bronze, "housing_stock", stock, date, pages=True)
        land(spark, bronze, "household_income", income, date)
        for _ in range(2):
            for name, spec in SPECS.items():
                silver.build_silver(spark, spec, bronze, f"{root}/silver", date, RUN_TS, f"{root}/runs",
                                    "pages" if name == "housing_stock" else "envelope")
    counts = gold.build_gold(spark, f"{root}/silver", f"{root}/gold", RUN_TS)
    return root, counts


def table(spark, lake, name, group="cbs"):
    return readers.read_parquet(spark, gold_path(f"{lake[0]}/gold", group, name))


def test_silver_is_typed_tagged_and_single(spark, lake):
    spec = SPECS["neighbourhood_key_figures"]
    df = readers.read_silver(spark, silver_path(f"{lake[0]}/silver", spec), spec.silver_schema)
    assert collect(df.select("RegioS", "Inwoners_5", "ingestion_date", "dataset_name")) == [
        ("GM1", 100, "2024-02-01", spec.name), ("GM1", 110, "2024-02-02", spec.name),
        ("GM2", 50, "2024-02-01", spec.name)]


def test_runs_are_recorded(spark, lake):
    runs = readers.read_silver(spark, f"{lake[0]}/runs", tables.RUN_SCHEMA)
    assert runs.count() == 16
    assert {r.n_records for r in runs.where(
        "dataset_name = 'neighbourhood_key_figures' AND ingestion_date = '2024-02-01'").collect()} == {2}


def test_neighbourhood_takes_the_latest_load(spark, lake):
    rows = {r.RegioS: r for r in table(spark, lake, gold.NEIGHBOURHOOD).collect()}
    assert rows["GM1"].avg_population == 110.0 and rows["GM1"].max_population == 110
    assert rows["GM1"].last_updated == "2024-02-02" and rows["GM2"].last_updated == "2024-02-01"
    assert rows["GM2"].avg_income_per_resident is None
    assert rows["GM1"].gold_table == gold.NEIGHBOURHOOD


def test_market_sums_are_not_inflated(spark, lake):
    rows = {(r.RegioS, r.TypeWoning_3): (r.total_dwellings, r.avg_property_value)
            for r in table(spark, lake, gold.MARKET).collect()}
    assert rows == {("GM1", "flat"): (30, 250.0), ("GM1", "house"): (10, 250.0), ("GM2", "flat"): (20, None)}


def test_socio_is_an_inner_join(spark, lake):
    rows = table(spark, lake, gold.SOCIO).collect()
    assert [(r.RegioS, r.avg_household_income, r.median_household_income, r.avg_income_per_resident)
            for r in rows] == [("GM1", 50.0, 45.0, 21.5)]


def test_dashboard_and_trends(spark, lake):
    rows = table(spark, lake, gold.DASHBOARD, "consolidated").collect()
    assert {(r.RegioS, r.Inwoners_5, r.GemiddeldeWOZWaarde_1) for r in rows} == {
        ("GM1", 110, D("250.00")), ("GM2", 50, None)}
    assert {r.RegioS for r in table(spark, lake, gold.TRENDS).collect()} == {"GM1", "GM3"}
    assert lake[1] == {gold.NEIGHBOURHOOD: 2, gold.TRENDS: 2, gold.MARKET: 3, gold.SOCIO: 1,
                       gold.DASHBOARD: 2}


def test_incremental_snapshots_equal_ranking_all_loads(spark, lake):
    root = lake[0]
    for spec in SPECS.values():
        silver.refresh_current(spark, spec, f"{root}/silver", "2024-02-01")
        path = silver.refresh_current(spark, spec, f"{root}/silver", "2024-02-02", "2024-02-01")
        want = gold.current(spark, f"{root}/silver", spec)
        assert collect(spark.read.parquet(path)) == collect(want.select(spec.silver_schema.fieldNames()))
    with pytest.raises(ValueError):
        silver.refresh_current(spark, spec, f"{root}/silver", "2024-02-02", "2024-02-02")
    counts = gold.build_gold(spark, f"{root}/silver", f"{root}/gold2", RUN_TS, as_of="2024-02-02")
    assert counts == lake[1]
    again = readers.read_parquet(spark, gold_path(f"{root}/gold2", "cbs", gold.MARKET))
    assert collect(again) == collect(table(spark, lake, gold.MARKET))


def test_business_names(spark):
    spec = SPECS["average_woz_value"]
    raw = spark.createDataFrame([("GM1", "Aa", "2020JJ00", D("1"))], spec.schema)
    out = silver.clean(raw, spec, "2024-02-01", RUN_TS, business_names=True)
    assert out.columns[:4] == ["region_code", "region_name", "period_code", "avg_woz_value_eur"]


def test_feed_and_its_failure(spark, tmp_path):
    spec = DatasetSpec("knmi", "daily", "silver_knmi_daily", schema_of(STN="integer", TG="integer"))
    root = str(tmp_path)
    df = spark.createDataFrame([(260, 51)], spec.schema)
    landing.land_commented_csv(df, f"{bronze_path(root, spec)}/ingestion_date=2024-02-01")
    read = lambda s, path: readers.read_commented_csv(s, path, spec.schema)
    n = silver.build_feed_silver(spark, spec, read, root, f"{root}/s", "2024-02-01", RUN_TS, f"{root}/r")
    assert n == 1

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        silver.build_feed_silver(spark, spec, read, root, f"{root}/s", "2024-02-03", RUN_TS, f"{root}/r")

    def broken(s, path):
        return read(s, path.replace("-02-02", "-02-01")).selectExpr("STN", "CAST(raise_error('bad feed') AS INT) AS TG")

    with pytest.raises(Exception, match="bad feed"):
        silver.build_feed_silver(spark, spec, broken, root, f"{root}/s", "2024-02-02", RUN_TS, f"{root}/r")
    statuses = [r.status for r in readers.read_silver(spark, f"{root}/r", tables.RUN_SCHEMA).collect()]
    assert sorted(statuses) == ["failed", "failed", "success"]


def test_titles_fill_missing_names(spark, tmp_path):
    spec = SPECS["average_woz_value"]
    root = str(tmp_path)
    land(spark, root, spec.name, [("GM1 ", None, "2020JJ00", D("1")), ("GM2", "Own", "2020JJ00", D("2")),
                                  ("GM3", None, "2020JJ00", D("3"))], "2024-02-01")
    base = f"{bronze_path(root, spec)}/ingestion_date=2024-02-01"
    with open(f"{base}/regions.json", "w", encoding="utf-8") as f:
        f.write(json.dumps([{"Key": "GM1   ", "Title": "Aa"}, {"Key": "GM2", "Title": "Bee"}], indent=2))
    n = silver.build_silver(spark, spec, root, f"{root}/s", "2024-02-01", RUN_TS,
                            titles={"regions.json": ("RegioS", "RegioNaam")})
    out = readers.read_silver(spark, silver_path(f"{root}/s", spec), spec.silver_schema)
    assert n == 3 and collect(out.select("RegioS", "RegioNaam")) == [
        ("GM1", "Aa"), ("GM2", "Own"), ("GM3", None)]


def test_daily_job(spark, tmp_path):
    root = str(tmp_path)
    land(spark, f"{root}/b", "neighbourhood_key_figures",
         [("GM1", "Aa", "Gemeente", "2020JJ00", 100, 40, D("20.5"))], "2024-02-01")
    land(spark, f"{root}/b", "average_woz_value", [("GM1", "Aa", "2020JJ00", D("250"))], "2024-02-01")
    land(spark, f"{root}/b", "housing_stock", [("GM1", "Aa", "2020JJ00", "flat", 3)], "2024-02-01")
    land(spark, f"{root}/b", "household_income", [("GM1", "Aa", "2020JJ00", D("5"), D("4"))], "2024-02-01")
    weather = f"{root}/b/knmi/knmi_bronze/weather_stations/ingestion_date=2024-02-01"
    os.makedirs(weather)
    with open(f"{weather}/raw_data.csv", "w", encoding="utf-8") as f:
        f.write("# STN,YYYYMMDD,TG\n\n  260,20240101,   51\n")
    args = ["--bronze", f"{root}/b", "--silver", f"{root}/s", "--gold", f"{root}/g",
            "--runs", f"{root}/r", "--date", "2024-02-01"]
    counts = daily.main([*args, "--skip", "addresses", "traffic_flow"])
    assert counts["weather_stations"] == 1 and counts[gold.DASHBOARD] == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        daily.main([*args, "--skip", "addresses"])
    runs = readers.read_silver(spark, f"{root}/r", tables.RUN_SCHEMA)
    assert collect(runs.where("status = 'failed'").select("dataset_name")) == [("traffic_flow",)]


def test_daily_job_keeps_snapshots(spark, tmp_path):
    root = str(tmp_path)
    args = ["--bronze", f"{root}/b", "--silver", f"{root}/s", "--gold", f"{root}/g", "--skip",
            "addresses", "weather_stations", "traffic_flow", "--date"]
    for date, value in (("2024-02-01", "250"), ("2024-02-02", "260"), ("2024-02-01", "240")):
        land(spark, f"{root}/b", "neighbourhood_key_figures",
             [("GM1", "Aa", "Gemeente", "2020JJ00", 100, 40, D("20.5"))], date)
        land(spark, f"{root}/b", "average_woz_value",
             [("GM1", "Aa", "2020JJ00", D(value)), (f"GM{date[-1]}x", "B", "2020JJ00", D(value))], date)
        land(spark, f"{root}/b", "housing_stock", [("GM1", "Aa", "2020JJ00", "flat", 3)], date)
        land(spark, f"{root}/b", "household_income", [("GM1", "Aa", "2020JJ00", D("5"), D("4"))], date)
        daily.main([*args, date])
    trends = readers.read_parquet(spark, gold_path(f"{root}/g", "cbs", gold.TRENDS))
    assert collect(trends.select("RegioS", "avg_property_value")) == [
        ("GM1", 260.0), ("GM1x", 240.0), ("GM2x", 260.0)]


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "PythonMapInArrow", "SortAggregate")
# Text keys of distinct rows are hashed, and the string extremes of summaries are few.
SHAPES = ["dedupe_latest_2key", "dedupe_latest_3key", "drop_exact_duplicates", "latest_snapshot",
          "incremental_upsert", "detect_new_and_changed", "dimension_lookup", "salted_enrich",
          "assign_region_grid", "gold_region_period_stats", "gold_value_trends", "gold_market_analysis",
          "gold_socio_indicators", "gold_regional_dashboard", "regional_feature_mart",
          "climate_features_by_region", "minute_facts", "hourly_facts_from_minute", "latency",
          "failure_rate", "dq_nulls", "dq_ranges", "dq_quarantine", "relative_date_window"]


@pytest.mark.parametrize("name", SHAPES)
def test_plan_shape(spark, sf_dir, name):
    plan = driver.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in FORBIDDEN if op in plan]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = driver.queries()["relative_date_window"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "props" not in plan
