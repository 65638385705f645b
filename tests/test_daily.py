"""The daily job: gold kept by deltas, titles, and counts of what was landed."""

import json
import os

from conftest import collect
from test_plans import RUN_TS, SPECS, D, land

from polderlake.catalog import bronze_path, gold_path
from polderlake.plans import daily, gold
from polderlake.sources import readers, tables

NAMES = {gold.NEIGHBOURHOOD: "cbs", gold.TRENDS: "cbs", gold.MARKET: "cbs", gold.SOCIO: "cbs",
         gold.DASHBOARD: "consolidated"}


def load(spark, root, date, scale):
    region = lambda i: (f"GM{i}", f"R{i % 3}" if i != 2 else None, )
    period = lambda i: f"20{20 + i % 2}JJ00"
    ids = [i for i in range(8) if (i + scale) % 4]
    b = f"{root}/b"
    land(spark, b, "neighbourhood_key_figures", [
        (*region(i), "Gemeente", period(i), 100 * scale + i, 40, D("20.5") * scale if i else None)
        for i in ids], date)
    land(spark, b, "average_woz_value", [(*region(i), period(i), D(200 + i * scale)) for i in ids], date)
    land(spark, b, "housing_stock", [(*region(i), period(i), k, 3 * i + scale) for i in ids
                                     for k in ("flat", "house")], date)
    land(spark, b, "household_income", [(*region(i), period(i), D(i * scale), D(4)) for i in ids], date)
    base = f"{bronze_path(b, SPECS['average_woz_value'])}/ingestion_date={date}"
    os.makedirs(base, exist_ok=True)
    with open(f"{base}/regions.json", "w", encoding="utf-8") as f:
        f.write(json.dumps([{"Key": "GM2 ", "Title": "Two"}]))


def test_gold_kept_by_deltas_equals_gold_from_all_rows(spark, tmp_path):
    root = str(tmp_path)
    for date, scale in (("2024-02-01", 1), ("2024-02-02", 3), ("2024-02-03", 2)):
        load(spark, root, date, scale)
        daily.main(["--bronze", f"{root}/b", "--silver", f"{root}/s", "--gold", f"{root}/g", "--runs",
                    f"{root}/r", "--skip", "addresses", "weather_stations", "traffic_flow", "--date", date])
    assert os.path.isdir(f"{root}/g/state/housing_stock/as_of=2024-02-02")
    gold.build_gold(spark, f"{root}/s", f"{root}/anew", RUN_TS)
    for name, group in NAMES.items():
        kept, anew = (readers.read_parquet(spark, gold_path(f"{root}/{g}", group, name)) for g in ("g", "anew"))
        drop = [c for c in kept.columns if "timestamp" in c]
        assert kept.columns == anew.columns and kept.count() > 0
        assert collect(kept.drop(*drop)) == collect(anew.drop(*drop)), name
    worth = readers.read_parquet(spark, gold_path(f"{root}/g", "cbs", gold.TRENDS))
    assert {r["RegioNaam"] for r in worth.where("RegioS = 'GM2'").collect()} == {"Two"}
    runs = readers.read_silver(spark, f"{root}/r", tables.RUN_SCHEMA).where("ingestion_date = '2024-02-01'")
    of = {(r["dataset_name"], r["endpoint"]): r["n_records"] for r in runs.collect()}
    assert of["housing_stock", "typeddataset"] == of["housing_stock", "silver"] == 12
    assert of["average_woz_value", "regions"] == 1
