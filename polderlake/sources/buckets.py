"""A table in key-hash buckets whose updates rewrite only the buckets they touch.

``data/<generation>/bucket=<b>`` holds the rows, ``pointers/<generation>`` one row per bucket
that has rows, naming the generation its files are in. Files are never changed: an update writes
the touched buckets into a generation of its own, then a new list of pointers. The list counts
once Spark has put its ``_SUCCESS`` there, so readers see the table before or after an update
and never in between, and an update that failed leaves nothing that is read. There is one writer
at a time; a second one that races it fails when it commits the same generation.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from polderlake.functions.scalars import fresh
from polderlake.operators.dedupe import dedupe_latest
from polderlake.operators.incremental import union_batches, upsert
from polderlake.session import scratch_path

POINTERS = "bucket int, generation string, n_records long, keys string, buckets int, schema string"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def generations(spark: SparkSession, path: str) -> list[int]:
    """Committed generations, oldest first."""
    out = []
    for name in _names(spark, f"{path}/pointers"):
        mark, fs = _folder(spark, f"{path}/pointers/{name}/_SUCCESS")
        if fs.exists(mark):
            out.append(int(name))
    return sorted(out)


def pointers(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The buckets of a generation, by default of the last committed one."""
    known = generations(spark, path)
    if not known:
        raise FileNotFoundError(f"no bucketed table at {path}")
    at = known[-1] if generation is None else generation
    return spark.read.schema(POINTERS).parquet(f"{path}/pointers/{at:010d}")


def bucket_of(df: DataFrame, keys: Sequence[str], schema: StructType, buckets: int) -> Column:
    """Bucket by the key as the table types it; null is a value, -0.0 is 0.0."""
    parts: list[Column] = []
    for k in keys:
        kind = schema[k].dataType
        c = F.col(k).cast(kind)
        if kind.typeName() in ("double", "float"):
            c = c + F.lit(0.0).cast(kind)
        parts += [c, c.isNull()]
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, keys: Sequence[str], buckets: int, label: str) -> None:
    mark = "bucket"
    if mark in df.columns:
        raise ValueError("a bucketed table cannot hold a column named bucket")
    placed = df.withColumn(mark, bucket_of(df, keys, df.schema, buckets))
    (placed.hint("rebalance", mark).write.partitionBy(mark).parquet(f"{path}/data/{label}"))


def _commit(spark: SparkSession, path: str, generation: int, kept: DataFrame | None, label: str,
            keys: Sequence[str], buckets: int, schema: StructType) -> None:
    """Pointers of the buckets that stay and of those just written; one row per bucket."""
    with_bucket = StructType([*schema.fields, StructField("bucket", IntegerType())])
    written = spark.read.schema(with_bucket).parquet(f"{path}/data/{label}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_records"))
    rows = written.withColumn("generation", F.lit(label))
    if kept is not None:
        rows = rows.unionByName(kept.select("bucket", "n_records", "generation"))
    rows = rows.withColumns({"keys": F.lit(json.dumps(list(keys))), "buckets": F.lit(buckets),
                             "schema": F.lit(schema.json())})
    empty = spark.range(1).select(F.lit(-1).alias("bucket"), F.lit("").alias("generation"),
                                  F.lit(0).cast("long").alias("n_records"),
                                  F.lit(json.dumps(list(keys))).alias("keys"),
                                  F.lit(buckets).alias("buckets"), F.lit(schema.json()).alias("schema"))
    # The row of no bucket keeps the schema of a table without rows.
    (rows.unionByName(empty).coalesce(1).write.mode("errorifexists")
     .parquet(f"{path}/pointers/{generation:010d}"))


def create_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write a table; ``buckets`` is chosen once, so that a bucket holds some 100 MB to 1 GB."""
    spark = df.sparkSession
    if generations(spark, path):
        raise FileExistsError(f"there is a table already: {path}")
    label = f"{0:010d}-{uuid.uuid4().hex[:12]}"
    _write(df, path, keys, buckets, label)
    _commit(spark, path, 0, None, label, keys, buckets, df.schema)


def _settings(live: DataFrame) -> tuple[list[str], int, StructType]:
    row = live.where("bucket = -1").first()
    return json.loads(row["keys"]), row["buckets"], StructType.fromJson(json.loads(row["schema"]))


def _rows(spark: SparkSession, path: str, chosen: Sequence, schema: StructType) -> DataFrame:
    """Rows of the chosen buckets; at most one folder per bucket is listed."""
    folders = [f"{path}/data/{r['generation']}/bucket={r['bucket']}" for r in chosen]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read_bucketed(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The whole table; a column that older files lack is null there."""
    live = pointers(spark, path, generation)
    return _rows(spark, path, live.where("bucket >= 0").collect(), _settings(live)[2])


def read_keys(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is in ``wanted``: only the buckets of those keys are read."""
    live = pointers(spark, path)
    keys, buckets, schema = _settings(live)
    asked = wanted.select(*keys).distinct().select(F.struct(*[
        F.col(k).cast(schema[k].dataType).alias(k) for k in keys]).alias("_asked"),
        bucket_of(wanted, keys, schema, buckets).alias("bucket"))
    touched = asked.select("bucket").distinct()
    rows = _rows(spark, path, live.join(touched, "bucket", "left_semi").collect(), schema)
    mark = fresh("_asked", rows)
    return rows.withColumn(mark, F.struct(*keys)).join(
        asked.select(F.col("_asked").alias(mark)), mark, "left_semi").drop(mark)


def upsert_bucketed(spark: SparkSession, path: str, delta: DataFrame,
                    latest_by: str | Sequence[str] | None = None) -> dict[str, int]:
    """``upsert`` into the table: reads and writes the buckets that hold a key of the delta.

    Returns ``buckets``, ``touched`` and ``generation``. New columns join the schema. An empty
    delta changes nothing. A delta repeated after success gives the same rows again.
    """
    done = generations(spark, path)
    live = pointers(spark, path)
    keys, buckets, schema = _settings(live)
    latest = dedupe_latest(delta, keys, latest_by if latest_by is not None else [
        c for c in delta.columns if c not in keys])
    staged = scratch_path(spark, "bucket-delta")
    latest.write.parquet(staged)
    latest = spark.read.schema(delta.schema).parquet(staged)
    touched = latest.select(bucket_of(latest, keys, schema, buckets).alias("bucket")).distinct()
    numbers = {r["bucket"] for r in touched.collect()}  # at most one row per bucket
    if not numbers:
        return {"buckets": buckets, "touched": 0, "generation": done[-1]}
    held = [r for r in live.where("bucket >= 0").collect() if r["bucket"] in numbers]
    base = _rows(spark, path, held, schema)
    typed = latest.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in schema.fields
                                if f.name in latest.columns})
    rows = upsert(base, typed, keys)
    whole = union_batches(spark.createDataFrame([], schema), typed.limit(0)).schema
    generation = done[-1] + 1
    label = f"{generation:010d}-{uuid.uuid4().hex[:12]}"
    _write(rows.select(*whole.fieldNames()), path, keys, buckets, label)
    stays = live.where("bucket >= 0").where(~F.col("bucket").isin(sorted(numbers)))
    _commit(spark, path, generation, stays, label, keys, buckets, whole)
    return {"buckets": buckets, "touched": len(numbers), "generation": generation}


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove pointer lists but the last ``keep`` and the bucket folders that none of those name.

    Readers of older generations, and a writer that has not committed, must be done.
    """
    known = generations(spark, path)
    live = {(r["generation"], r["bucket"]) for g in known[-keep:]
            for r in pointers(spark, path, g).where("bucket >= 0").collect()}
    gone = []
    for label in _names(spark, f"{path}/data"):
        for name in _names(spark, f"{path}/data/{label}"):
            if name.startswith("bucket=") and (label, int(name[7:])) not in live:
                gone.append(f"{path}/data/{label}/{name}")
    gone += [f"{path}/pointers/{g:010d}" for g in known[:-keep]]
    for name in gone:
        folder, fs = _folder(spark, name)
        fs.delete(folder, True)
    return gone
