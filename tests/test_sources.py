import json
import os
from datetime import datetime

import pytest
from conftest import collect
from pyspark.sql import functions as F

from polderlake.catalog import schema_of
from polderlake.operators import quality
from polderlake.operators.incremental import reprocess
from polderlake.session import scratch_path, scratch_root
from polderlake.sources import landing, readers, tables

ROW = schema_of(RegioS="string", Inwoners_5="long")
RUN_TS = datetime(2024, 2, 1, 6)


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    return str(folder)


def test_pretty_printed_envelope(spark, tmp_path):
    doc = {"odata.metadata": "x", "value": [{"RegioS": "GM1", "Inwoners_5": 5}, {"RegioS": "GM2"}]}
    path = put(tmp_path / "e", "typeddataset.json", json.dumps(doc, indent=2))
    for schema in (ROW, None):
        out = readers.read_envelope(spark, path, schema).select("RegioS", "Inwoners_5")
        assert collect(out) == [("GM1", 5), ("GM2", None)]


def test_envelope_without_the_array(spark, tmp_path):
    path = put(tmp_path / "n", "a.json", json.dumps({"RegioS": "GM1"}, indent=2))
    assert collect(readers.read_envelope(spark, path)) == [("GM1",)]


def test_damaged_documents_fail_or_are_listed(spark, tmp_path):
    good = json.dumps({"value": [{"RegioS": "a"}]})
    put(tmp_path / "d", "1.json", good)
    put(tmp_path / "d", "2.json", '{"value": [{"RegioS": "b"}, {"Reg')
    put(tmp_path / "d", "3.json", '{"error": "busy"}')
    path = put(tmp_path / "d", "4.json", "")
    with pytest.raises(Exception, match="without 'value'"):
        readers.read_envelope(spark, path, ROW).collect()
    rows = readers.read_envelope(spark, path, ROW, skip_damaged=True)
    assert [r.RegioS for r in rows.collect()] == ["a"]
    found = readers.damaged_documents(spark, path, ROW).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in found) == [
        ("2.json", "not JSON"), ("3.json", "no value"), ("4.json", "empty")]
    assert sorted(r.text == "" for r in readers.read_payloads(spark, path).collect()) == [
        False, False, False, True]


def test_cut_off_page_fails(spark, tmp_path):
    put(tmp_path / "c", "part-00000.json", '[{"RegioS": "a"}]')
    path = put(tmp_path / "c", "part-00001.json", '[{"RegioS": "b"}, {"Reg')
    with pytest.raises(Exception, match="not JSON"):
        readers.read_pages(spark, path, ROW).collect()
    assert [r.RegioS for r in readers.read_pages(spark, path, ROW, skip_damaged=True).collect()] == ["a"]


def test_commented_csv_keeps_nulls_and_commas(spark, tmp_path):
    rows = [(1, None, 3, "x"), (2, 5, None, "a,b"), (3, 4, 5, 'say "hi" \\'), (4, None, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d string")
    landing.land_commented_csv(df, str(tmp_path / "csv"))
    assert collect(readers.read_commented_csv(spark, str(tmp_path / "csv"), df.schema)) == sorted(rows, key=repr)


def test_page_parts(spark, tmp_path):
    put(tmp_path / "p", "part-00000.json", json.dumps([{"RegioS": "a"}, {"RegioS": "b"}]))
    path = put(tmp_path / "p", "part-00001.json", json.dumps([{"RegioS": "c"}]))
    assert collect(readers.read_pages(spark, path, ROW).select("RegioS")) == [("a",), ("b",), ("c",)]


def test_commented_csv(spark, tmp_path):
    path = put(tmp_path / "w", "raw_data.csv",
               "# source: x\n#\n# STN,YYYYMMDD,   TG\n\n  260,20240101,   51\n  260,20240102,     \n")
    out = readers.read_commented_csv(spark, path, "STN int, YYYYMMDD string, TG int")
    assert collect(out) == [(260, "20240101", 51), (260, "20240102", None)]


def test_headered_csv_inferred(spark, tmp_path):
    path = put(tmp_path / "c", "a.csv", "id,name\n1,x\n2,y\n")
    assert collect(readers.read_csv(spark, path)) == [(1, "x"), (2, "y")]


def test_geojson_needs_features(spark, tmp_path):
    good = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "f1", "geometry": {"type": "Point", "coordinates": [4.5, 52.0]},
         "properties": {"status": "in use"}}]}
    path = put(tmp_path / "g", "data.json", json.dumps(good, indent=2))
    assert collect(readers.read_geojson(spark, path, "status string")) == [
        ("f1", "Point", [4.5, 52.0], "in use")]
    empty = put(tmp_path / "g0", "data.json", json.dumps({"features": []}))
    assert readers.read_geojson(spark, empty, "status string").count() == 0
    bad = put(tmp_path / "g1", "data.json", json.dumps({"type": "FeatureCollection"}))
    with pytest.raises(Exception, match="features"):
        readers.read_geojson(spark, bad, "status string").collect()


def test_xml_rows(spark, tmp_path):
    path = put(tmp_path / "x", "t.xml", "<feed><site><id>1</id><speed>80.5</speed></site>"
                                        "<site><id>2</id></site></feed>")
    assert collect(readers.read_xml(spark, path, "site", "id int, speed double")) == [
        (1, 80.5), (2, None)]


def test_payload_fields(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("broken",)], "props string")
    assert [r.k for r in readers.parse_json(df, "props", "k bigint").collect()] == [1, None]


def test_payload_files(spark, tmp_path):
    put(tmp_path / "raw", "a.csv", "# x\n1\n2\n")
    path = put(tmp_path / "raw", "b.csv", " \n")
    out = quality.profile_payload(readers.read_payloads(spark, path), "text")
    assert {(r.path.rsplit("/", 1)[1], r.data_lines, r.raw_bytes, r.is_empty)
            for r in out.collect()} == {("a.csv", 2, 8, False), ("b.csv", 0, 2, True)}


def test_landed_documents_are_bounded(spark, tmp_path):
    df = spark.range(0, 95, 1, 2).select(F.col("id").alias("Inwoners_5"), F.lit("x").alias("RegioS"))
    landing.land_envelopes(df, f"{tmp_path}/l", rows_per_file=10)
    files = [f for f in os.listdir(tmp_path / "l") if f.endswith(".txt")]
    assert len(files) == 10
    sizes = [len(json.load(open(tmp_path / "l" / f))["value"]) for f in files]
    assert sum(sizes) == 95 and max(sizes) == 10
    back = readers.read_envelope(spark, f"{tmp_path}/l", ROW)
    assert back.agg(F.sum("Inwoners_5")).first()[0] == sum(range(95))


def test_partition_read_keeps_the_string(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, ingestion_date string")
    tables.load_partitions(df, f"{tmp_path}/t")
    out = readers.read_partition(spark, f"{tmp_path}/t", "2024-01-02")
    assert collect(out) == [(2, "2024-01-02")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingestion_date" in plan
    typed = readers.read_partition(spark, f"{tmp_path}/t", "2024-01-01",
                                   schema="v int, ingestion_date string")
    assert collect(typed) == [(1, "2024-01-01")]


def test_loading_a_date_again_replaces_only_it(spark, tmp_path):
    path = f"{tmp_path}/r"
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, ingestion_date string")
    tables.load_partitions(df, path)
    reprocess(spark.createDataFrame([(9,)], "v int"), path, "2024-01-02")
    reprocess(spark.createDataFrame([(9,)], "v int"), path, "2024-01-02")
    out = readers.read_silver(spark, path, df.schema)
    assert collect(out) == [(1, "2024-01-01"), (9, "2024-01-02")]


def test_schema_evolution_and_conflicts(spark, tmp_path):
    path = f"{tmp_path}/s"
    tables.append_evolving(spark.createDataFrame([(1, "a")], "k int, a string"), path)
    tables.append_evolving(spark.createDataFrame([(2, 0.5)], "k int, b double"), path)
    out = readers.read_silver(spark, path).select("k", "a", "b")
    assert collect(out) == [(1, "a", None), (2, None, 0.5)]
    odd = spark.createDataFrame([("3", "c"), ("x", "d")], "k string, a string")
    with pytest.raises(ValueError, match="k: string for int"):
        tables.append_evolving(odd, path)
    assert readers.read_silver(spark, path).count() == 2
    tables.append_evolving(odd, path, cast=True)
    assert collect(readers.read_silver(spark, path, "k int, a string, b double")) == [
        (1, "a", None), (2, None, 0.5), (3, "c", None), (None, "d", None)]


def test_counts_are_observed_and_recorded(spark, tmp_path):
    df, seen = tables.observed(spark.range(25), "observed_rows")
    tables.write_gold(df, f"{tmp_path}/o")
    runs = f"{tmp_path}/runs"
    for status, error in (("success", None), ("failed", "timeout")):
        tables.write_run(tables.run_record(spark, "cbs", "x", "2024-02-01", "TypedDataSet",
                                           seen.get["n_records"], RUN_TS, status, error), runs)
    out = readers.read_silver(spark, runs, tables.RUN_SCHEMA)
    assert collect(out.select("ingestion_datetime", "n_records", "status", "error")) == [
        ("2024-02-01_06-00-00", 25, "failed", "timeout"), ("2024-02-01_06-00-00", 25, "success", None)]


def test_scratch_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or scratch_root(spark) == configured.rstrip("/")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
