import os

import pytest
from conftest import collect
from pyspark.sql import functions as F

from polderlake.sources import compaction
from polderlake.sources.tables import RUN_SCHEMA, run_record, write_run

SCHEMA = "k long, v string"


def append(spark, path, start, n, files):
    spark.range(start, start + n, 1, files).selectExpr("id AS k", "'v' || id % 3 AS v").write.mode("append").parquet(path)


def live(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs
            if f.endswith(".parquet") and "_packed" not in d]


@pytest.fixture()
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_bins_equal_running_sums_and_large_files_stay(spark):
    rows = [(f"p{i:03d}", (i * 37) % 120, "ab"[i % 2]) for i in range(300)]
    files = spark.createDataFrame(rows, "path string, length long, folder string")
    got = {r["path"]: r["bin"] for r in compaction.pack(files, 100).collect()}
    for folder in "ab":
        at = 0
        for p, size, f in rows:
            if f == folder:
                assert got[p] == (None if size >= 100 else f"0-{at // 100}")
                at += size if size < 100 else 0
    dealt = compaction.pack(files, 100, block_files=20).where("bin IS NOT NULL").groupBy("folder", "bin").agg(
        (F.sum("length") - F.max_by("length", "path")).alias("n"))
    assert dealt.where("n >= 100").count() == 0


def test_appends_go_on_beside_compactions(spark, tmp_path, schema):
    path = str(tmp_path / "t")
    append(spark, path, 0, 100, 9)
    first = compaction.compact(spark, path, schema)
    assert first["files"] == 9 and first["generation"] == 0 and first["bins"] < 9
    append(spark, path, 100, 50, 5)
    append(spark, path, 100, 10, 3)  # full copies stay
    want = collect(spark.range(150).selectExpr("id AS k", "'v' || id % 3 AS v").unionAll(
        spark.range(100, 110).selectExpr("id", "'v' || id % 3")))
    assert collect(compaction.read_packed(spark, path, schema)) == want
    assert compaction.compact(spark, path, schema)["generation"] == 1
    assert collect(compaction.read_packed(spark, path, schema)) == want
    assert collect(spark.read.parquet(path)) == want  # old readers still see their files
    assert compaction.expire(spark, path) == 17 and len(live(path)) == 0
    assert collect(compaction.read_packed(spark, path, schema)) == want
    assert compaction.expire(spark, path) == 0
    assert compaction.compact(spark, path, schema) == {"files": 0, "bins": 0, "generation": 1}


def test_a_compaction_that_was_not_committed_is_not_read(spark, tmp_path, schema):
    path = str(tmp_path / "t")
    append(spark, path, 0, 20, 4)
    append(spark, f"{path}/_packed/000000-crashed", 0, 20, 1)
    os.makedirs(f"{path}/_packed/lists/000000")  # no _SUCCESS
    assert compaction.generations(spark, path) == []
    assert compaction.read_packed(spark, path, schema).count() == 20


def test_unsettled_batches_and_large_files_are_left(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(0, 400, 1, 4).selectExpr("id AS k", "cast(id % 4 AS int) AS batch_id")
    df.write.partitionBy("batch_id").parquet(path)
    before = {f for f in live(path) if "batch_id=3" in f}
    report = compaction.compact_batches(spark, path, df.schema, last_batch=2)
    assert report["files"] == 12
    compaction.expire(spark, path)
    assert set(live(path)) == before
    # The last batch runs again and replaces its folder.
    (df.where("batch_id = 3 AND k < 8").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))
    assert collect(compaction.read_packed(spark, path, df.schema)) == collect(df.where("batch_id < 3 OR k < 8"))
    assert compaction.compact(spark, path, df.schema, ["batch_id"], target=1)["files"] == 0


def test_run_records(spark, tmp_path):
    from datetime import datetime
    path = str(tmp_path / "runs")
    for i in range(4):
        write_run(run_record(spark, "s", f"d{i}", "2024-02-01", "silver", i, datetime(2024, 2, 1)), path)
    want = collect(spark.read.schema(RUN_SCHEMA).parquet(path))
    assert compaction.compact(spark, path, RUN_SCHEMA)["files"] >= 4
    assert collect(compaction.read_packed(spark, path, RUN_SCHEMA)) == want
