"""Joins that neither fan out nor fall over a hot key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DataType, IntegerType, MapType, StringType,
                               StructField, StructType)

from polderlake.functions.scalars import comparable
from polderlake.operators.dedupe import dedupe_latest

# A side is broadcast only when its rows were measured to take no more than this.
BROADCAST_BYTES = 64 << 20
# A key is hot when it holds the rows of more than this many mean shuffle partitions.
HOT = 2
# Rows looked at to find hot keys, at least; or a hundred per shuffle partition.
SAMPLE_ROWS = 1_000_000
NESTED = (ArrayType, MapType, StructType)


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, as counted and measured by distributed aggregates, fit the bound.

    A slot of 16 bytes per value is counted, plus the length of strings and
    nested values. The row count alone, which a Parquet table answers from its
    footers, already rules out a large table.
    """
    slots = 16 * len(df.columns)
    n = df.count()
    if n * slots > max_bytes:
        return False
    lengths = [_length(f.name, f.dataType) for f in df.schema.fields
               if isinstance(f.dataType, (StringType, BinaryType, *NESTED))]
    if not lengths:
        return True
    total = F.sum(reduce(lambda a, b: a + b, lengths).cast("bigint"))
    return n * slots + (df.agg(total.alias("n")).first()["n"] or 0) <= max_bytes


def _length(name: str, kind: DataType) -> Column:
    value = F.col(f"`{name}`")
    text = F.to_json(F.struct(value)) if isinstance(kind, NESTED) else value
    return F.coalesce(F.octet_length(text), F.lit(0))


def hot_keys(df: DataFrame, on: Sequence[str], partitions: int | None = None,
             sample_rows: int = SAMPLE_ROWS) -> list[Row]:
    """Keys with more rows than ``HOT`` mean shuffle partitions, and ``_pieces`` to cut each into.

    ``_pieces`` brings a piece down to a mean partition. By counting there are
    fewer hot keys than partitions, and fewer than twice as many pieces.
    A large frame is judged by a sample; the answer only decides which keys
    are salted, and a join gives the same rows whatever is found here.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*on)
    fraction = max(sample_rows, 100 * partitions) / max(keys.count(), 1)
    if fraction < 1:
        keys = keys.sample(fraction, seed=7)
    counts = keys.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    load = F.col("_n") * partitions / total
    return counts.where(load > HOT).select(*on, F.ceil(load).cast("int").alias("_pieces")).collect()


def salt_sides(left: DataFrame, right: DataFrame, on: Sequence[str],
               hot: Sequence[Row]) -> tuple[DataFrame, DataFrame]:
    """Add ``_salt`` to both sides so that the left rows of hot keys spread over tasks.

    Left rows of a hot key get one of its pieces' numbers, the right rows of
    that key are repeated once per piece; all other rows get 0. The spread
    hashes the row and its partition: full copies spread too, and a task that
    is run again gives every row the same salt as before.
    """
    fields = [StructField(f"_h{i}", left.schema[k].dataType) for i, k in enumerate(on)]
    schema = StructType([*fields, StructField("_pieces", IntegerType())])
    known = F.broadcast(left.sparkSession.createDataFrame(list(hot), schema))

    def marked(df: DataFrame) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(f.name)) for k, f in zip(on, fields)]
        return df.join(known, reduce(lambda a, b: a & b, same), "left").drop(
            *[f.name for f in fields])

    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    spread = F.xxhash64(*comparable(left), F.spark_partition_id())
    salted_left = (marked(left.withColumn("_spread", spread))
                   .withColumn("_salt", F.pmod(F.col("_spread"), pieces).cast("int"))
                   .drop("_pieces", "_spread"))
    salted_right = (marked(right)
                    .withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
                    .drop("_pieces"))
    return salted_left, salted_right


def skew_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                   side: str = "measured", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Equi-join planned by what is known about the right side.

    ``measured``: the right side is a table; it is broadcast when measured to
    fit, else the left rows of hot keys are salted.
    ``unique``: both sides hold few rows per key, as aggregates do. No key can
    be hot, so measuring would only run the right side's plan twice; adaptive
    execution still broadcasts it when its shuffle turns out small.
    ``salted``: the right side is known to be large.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type not supported here: {how}")
    if side not in ("measured", "unique", "salted"):
        raise ValueError(f"unknown kind of right side: {side}")
    on = list(on)
    if side == "unique":
        return left.join(right, on, how)
    if side == "measured" and fits_broadcast(right, max_bytes):
        return left.join(F.broadcast(right), on, how)
    if how in ("left_semi", "left_anti"):
        right = right.distinct()
    hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    salted_left, salted_right = salt_sides(left, right, on, hot)
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def enrich(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str],
           how: str = "left", latest_by: str | Sequence[str] | None = None,
           side: str = "measured", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``columns`` of the matching right row; the right side has one row per key.

    ``latest_by`` first reduces the right side to its latest row per key. Leave
    it out only for a right side known to be unique, such as an aggregate.
    """
    on = list(on)
    if latest_by is not None:
        right = dedupe_latest(right, on, latest_by)
    return skew_safe_join(left, right.select(*on, *columns), on, how, side, max_bytes)


def wide_join(base: DataFrame, sides: Sequence[tuple[DataFrame, Sequence[str]]],
              on: Sequence[str], latest_by: str | Sequence[str] | None = None,
              side: str = "unique") -> DataFrame:
    """Chain of left enrichments on one key; the base has one row per key as well."""
    return reduce(lambda df, right: enrich(df, right[0], on, right[1], "left", latest_by, side),
                  sides, base)


def lookup(fact: DataFrame, dimension: DataFrame, on: Sequence[str], columns: Sequence[str],
           default: object | Mapping[str, object] = None, side: str = "measured") -> DataFrame:
    """Titles from a dimension; facts without a match get ``default``."""
    joined = enrich(fact, dimension, on, columns, side=side)
    if default is None:
        return joined
    values = default if isinstance(default, Mapping) else {c: default for c in columns}
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def restrict_to(fact: DataFrame, dimension: DataFrame, on: Sequence[str],
                max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Facts whose key exists in the dimension."""
    return skew_safe_join(fact, dimension.select(*on), on, "left_semi", max_bytes=max_bytes)


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[str],
            max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows whose key the parent lacks."""
    return skew_safe_join(child, parent.select(*on), on, "left_anti", max_bytes=max_bytes)

