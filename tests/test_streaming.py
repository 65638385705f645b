from datetime import datetime, timedelta

import pytest
from conftest import collect
from pyspark.sql import functions as F

from polderlake.operators.dedupe import dedupe_latest
from polderlake.operators.normalize import drop_invalid
from polderlake.operators.rollup import minute_facts
from polderlake.streaming import streams

SCHEMA = "id bigint, ts timestamp, k string, v double"
START = datetime(2024, 1, 1, 10)


def at(minute, second=0):
    return START + timedelta(minutes=minute, seconds=second)


def drop_file(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def feed(spark, folder):
    """One micro-batch per file, whatever waits."""
    return streams.open_stream(spark, "parquet", SCHEMA, {"maxFilesPerTrigger": "1"}, f"{folder}/*")


@pytest.fixture
def files(spark, tmp_path):
    folder = f"{tmp_path}/in"
    drop_file(spark, folder, [(1, at(0), "a", 1.0), (2, at(0, 30), "a", 2.0), (3, at(1), "b", 4.0)], "f1")
    drop_file(spark, folder, [(1, at(0), "a", 1.0), (4, at(1, 59), "b", None), (5, at(9), "a", 8.0)], "f2")
    drop_file(spark, folder, [(6, at(0, 45), "a", 16.0), (5, at(9), "a", 8.0), (7, at(20), "b", 32.0)], "f3")
    return folder


def batch(spark, files):
    return spark.read.schema(SCHEMA).parquet(f"{files}/*")


def test_minute_facts_equal_batch_when_nothing_is_late(spark, files, tmp_path):
    streams.stream_minute_facts(feed(spark, files), "ts", ["k"], "v", "1 hour", f"{tmp_path}/o",
                                f"{tmp_path}/c").awaitTermination()
    out = streams.read_updates(spark, f"{tmp_path}/o", ["minute", "k"])
    assert collect(out) == collect(minute_facts(batch(spark, files), "ts", ["k"], "v"))


def test_late_rows_and_open_windows_in_append_mode(spark, tmp_path):
    folder = f"{tmp_path}/in"
    drop_file(spark, folder, [(1, at(0), "a", 1.0), (2, at(30), "a", 2.0)], "f1")
    streams.append_minute_facts(feed(spark, folder), "ts", ["k"], "v", "5 minutes", f"{tmp_path}/o",
                                f"{tmp_path}/c").awaitTermination()
    drop_file(spark, folder, [(3, at(0, 10), "a", 99.0), (4, at(26), "a", 4.0)], "f2")
    streams.append_minute_facts(feed(spark, folder), "ts", ["k"], "v", "5 minutes", f"{tmp_path}/o",
                                f"{tmp_path}/c").awaitTermination()
    drop_file(spark, folder, [(5, at(60), "a", 8.0)], "f3")
    streams.append_minute_facts(feed(spark, folder), "ts", ["k"], "v", "5 minutes", f"{tmp_path}/o",
                                f"{tmp_path}/c").awaitTermination()
    out = {r.minute: r.total for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    # The row of 10:00:10 came after the watermark (10:25) and is gone; 11:00 is still open.
    assert out == {at(0): 1.0, at(26): 4.0, at(30): 2.0}


@pytest.mark.parametrize("salts", [None, 4])
def test_dedupe_across_batches(spark, files, tmp_path, salts):
    streams.stream_dedupe(feed(spark, files), ["id"], "ts", "1 hour", f"{tmp_path}/o",
                          f"{tmp_path}/c", salts).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/o")
    assert collect(out) == collect(batch(spark, files).distinct())


def test_dedupe_of_one_key_delivered_very_often(spark, tmp_path):
    often = F.when(F.col("id") % 3 == 0, F.col("id") + 10).otherwise(F.lit(1))
    rows = spark.range(900).select(often.alias("id"), F.lit(at(0)).alias("ts"), F.lit("a").alias("k"),
                                   F.lit(1.0).alias("v"))
    rows.repartition(8).write.parquet(f"{tmp_path}/in/f1")
    stream = streams.open_stream(spark, "parquet", SCHEMA, path=f"{tmp_path}/in/*")
    streams.stream_dedupe(stream, ["id"], "ts", "1 hour", f"{tmp_path}/o", f"{tmp_path}/c",
                          salts=4).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/o")
    assert out.count() == 301 and out.where("id = 1").count() == 1


def test_upsert_keeps_the_latest_whatever_arrives_last(spark, files, tmp_path):
    streams.stream_upsert_latest(feed(spark, files), ["k"], ["ts"], f"{tmp_path}/o",
                                 f"{tmp_path}/c").awaitTermination()
    out = streams.read_latest(spark, f"{tmp_path}/o", ["k"], ["ts"])
    assert collect(out) == collect(dedupe_latest(batch(spark, files), ["k"], "ts"))


def test_snapshot_and_later_batches(spark, files, tmp_path):
    streams.stream_upsert_latest(feed(spark, files), ["id"], ["ts"], f"{tmp_path}/o",
                                 f"{tmp_path}/c").awaitTermination()
    streams.write_snapshot(spark, f"{tmp_path}/o", ["id"], ["ts"], f"{tmp_path}/snap", 1)
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 5
    whole = streams.read_latest(spark, f"{tmp_path}/o", ["id"], ["ts"])
    quick = streams.read_latest(spark, f"{tmp_path}/o", ["id"], ["ts"], f"{tmp_path}/snap", 1)
    assert collect(quick) == collect(whole) and whole.count() == 7


def test_a_repeated_batch_changes_nothing(spark, files, tmp_path):
    df = batch(spark, files)
    streams._batch_folder(df, f"{tmp_path}/o", 0)
    streams._batch_folder(df, f"{tmp_path}/o", 0)
    assert streams.read_batches(spark, f"{tmp_path}/o").count() == df.count()


def test_layers_hold_raw_and_clean_rows(spark, files, tmp_path):
    def clean(df):
        return drop_invalid(df, ["v"], {"big": F.col("v") > 10})

    streams.stream_layers(feed(spark, files), clean, f"{tmp_path}/b", f"{tmp_path}/s",
                          f"{tmp_path}/c").awaitTermination()
    raw = streams.read_batches(spark, f"{tmp_path}/b").drop("batch_id")
    silver = streams.read_batches(spark, f"{tmp_path}/s").drop("batch_id")
    assert collect(raw) == collect(batch(spark, files))
    assert collect(silver) == collect(clean(batch(spark, files)))


def test_stream_to_silver_resumes_from_its_checkpoint(spark, files, tmp_path):
    for _ in range(2):
        streams.stream_to_silver(feed(spark, files), lambda df: df, f"{tmp_path}/s",
                                 f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s").count() == batch(spark, files).count()


def test_bus_messages(spark):
    df = spark.createDataFrame([(bytearray(b'{"id": 1, "v": 2.5}'), START)], "value binary, timestamp timestamp")
    assert collect(streams.decode_bus(df, "id bigint, v double")) == [(1, 2.5, START)]
