"""Streams: bronze to silver, minute facts, deduplication, latest-per-key upserts.

Sinks written through ``foreachBatch`` put each micro-batch in its own
``batch_id=N`` folder, replaced as a whole when the batch is repeated after a
failure. Reading takes the newest entry per key over all batches, so no data
file is ever rewritten in place. A sink folder belongs to one checkpoint: a
stream that starts anew numbers its batches from zero and needs a new folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from polderlake.functions.scalars import comparable
from polderlake.operators.dedupe import dedupe_latest
from polderlake.operators.rollup import minute_facts

Transform = Callable[[DataFrame], DataFrame]


def open_stream(spark: SparkSession, source: str, schema: StructType | str | None = None,
                options: Mapping[str, str] | None = None, path: str | None = None) -> DataFrame:
    """A stream from files (``parquet``, ``json``, ...) or from a bus (``kafka``)."""
    reader = spark.readStream.format(source).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def decode_bus(df: DataFrame, schema: StructType | str) -> DataFrame:
    """Fields of the JSON message value, with the bus timestamp as arrival time."""
    row = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return (df.select(F.from_json(F.col("value").cast("string"), row).alias("_m"), "timestamp")
            .select("_m.*", F.col("timestamp").alias("arrived_at")))


def _batch_folder(batch: DataFrame, path: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _run(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_layers(stream: DataFrame, to_silver: Transform, bronze: str | None, silver: str,
                  checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Land the raw rows and the same rows cleaned by the batch functions in ``to_silver``."""
    def both(batch: DataFrame, batch_id: int) -> None:
        if bronze is None:
            _batch_folder(to_silver(batch), silver, batch_id)
            return
        held = batch.persist()
        try:
            _batch_folder(held, bronze, batch_id)
            _batch_folder(to_silver(held), silver, batch_id)
        finally:
            held.unpersist()

    return _run(stream.writeStream.foreachBatch(both), checkpoint, available_now)


def stream_to_silver(stream: DataFrame, to_silver: Transform, silver: str, checkpoint: str,
                     available_now: bool = True) -> StreamingQuery:
    """Cleaned rows appended by the file sink, which commits each batch exactly once."""
    return _run(to_silver(stream).writeStream.format("parquet").option("path", silver)
                .outputMode("append"), checkpoint, available_now)


def deduplicated(stream: DataFrame, keys: Sequence[str], ts: str, delay: str,
                 salts: int | None = 0) -> DataFrame:
    """First arrival per key within the watermark.

    Copies are first dropped per (key, salt) and then per key: the copies of
    one key spread over as many state partitions as there are salts, by
    default as many as shuffle partitions, and the last step sees at most that
    many of them. The price is a second, equally large state; pass ``None``
    where no key is repeated much. Which of the copies that arrive in one batch
    stays is arbitrary when they differ in other columns.
    """
    marked = stream.withWatermark(ts, delay)
    if salts == 0:
        salts = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if salts:
        salt = F.pmod(F.xxhash64(*comparable(stream), F.spark_partition_id()), F.lit(salts))
        marked = (marked.withColumn("_salt", salt)
                  .dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt"))
    return marked.dropDuplicatesWithinWatermark(list(keys))


def stream_dedupe(stream: DataFrame, keys: Sequence[str], ts: str, delay: str, out: str,
                  checkpoint: str, salts: int | None = 0,
                  available_now: bool = True) -> StreamingQuery:
    deduped = deduplicated(stream, keys, ts, delay, salts)
    return _run(deduped.writeStream.format("parquet").option("path", out).outputMode("append"),
                checkpoint, available_now)


def stream_minute_facts(stream: DataFrame, ts: str, keys: Sequence[str], value: str, delay: str,
                        out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Minute facts in update mode: every batch writes the windows it touched.

    Rows older than the watermark are dropped, as in append mode, but a window
    is visible before the watermark has passed it. The few rows per state
    partition are rebalanced, so a batch does not leave as many small files.
    """
    facts = minute_facts(stream.withWatermark(ts, delay), ts, keys, value)
    return _run(facts.writeStream.outputMode("update")
                .foreachBatch(lambda batch, n: _batch_folder(batch.hint("rebalance"), out, n)),
                checkpoint, available_now)


def append_minute_facts(stream: DataFrame, ts: str, keys: Sequence[str], value: str, delay: str,
                        out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Minute facts in append mode: a window is written once, after the watermark passed it."""
    facts = minute_facts(stream.withWatermark(ts, delay), ts, keys, value)
    return _run(facts.writeStream.format("parquet").option("path", out).outputMode("append"),
                checkpoint, available_now)


def stream_upsert_latest(stream: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str,
                         checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Latest row per key of every batch; ``read_latest`` resolves keys over the batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _batch_folder(dedupe_latest(batch, keys, order_by), out, batch_id)

    return _run(stream.writeStream.foreachBatch(write), checkpoint, available_now)


def read_batches(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("basePath", path).parquet(path)


def read_updates(spark: SparkSession, path: str, keys: Sequence[str],
                 snapshot: str | None = None, snapshot_batch: int | None = None) -> DataFrame:
    """Newest version of each key of an update-mode sink: the one of the last batch.

    With a snapshot only the batches after ``snapshot_batch`` are read next to it.
    """
    rows = read_batches(spark, path)
    if snapshot is not None:
        rows = spark.read.parquet(snapshot).unionByName(rows.where(F.col("batch_id") > snapshot_batch))
    return dedupe_latest(rows, keys, "batch_id").drop("batch_id")


def write_update_snapshot(spark: SparkSession, path: str, keys: Sequence[str], out: str,
                          last_batch: int, snapshot: str | None = None,
                          snapshot_batch: int | None = None) -> None:
    """Resolve the updates up to ``last_batch`` once, from an earlier snapshot where there is one.

    The batch of each row is kept, so later updates still win over it.
    """
    rows = read_batches(spark, path).where(F.col("batch_id") <= last_batch)
    if snapshot is not None:
        rows = spark.read.parquet(snapshot).unionByName(rows.where(F.col("batch_id") > snapshot_batch))
    dedupe_latest(rows, keys, "batch_id").write.mode("overwrite").parquet(out)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], order_by: Sequence[str],
                snapshot: str | None = None, snapshot_batch: int | None = None) -> DataFrame:
    """Latest row per key of an upsert sink, by the rows' own order, not by arrival.

    With a snapshot only the batches after ``snapshot_batch`` are read next to it.
    """
    rows = read_batches(spark, path)
    if snapshot is not None:
        newer = rows.where(F.col("batch_id") > snapshot_batch).drop("batch_id")
        return dedupe_latest(spark.read.parquet(snapshot).unionByName(newer), keys, order_by)
    return dedupe_latest(rows.drop("batch_id"), keys, order_by)


def write_snapshot(spark: SparkSession, path: str, keys: Sequence[str], order_by: Sequence[str],
                   out: str, last_batch: int) -> None:
    """Resolve the batches up to ``last_batch`` once, so that readers need not do it again.

    Written beside the batches, which stay as they are: readers move to the
    snapshot when it is complete, and the folders it covers can then be expired.
    """
    covered = read_batches(spark, path).where(F.col("batch_id") <= last_batch).drop("batch_id")
    dedupe_latest(covered, keys, order_by).write.mode("overwrite").parquet(out)
