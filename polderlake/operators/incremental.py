"""Incremental loads: upsert, change detection, unions of differing batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polderlake.functions.scalars import comparable, fresh
from polderlake.operators.dedupe import dedupe_latest
from polderlake.operators.joins import skew_safe_join
from polderlake.sources.tables import clear_partitions, load_partitions, observed


def union_batches(*batches: DataFrame) -> DataFrame:
    """Rows of all batches; a column a batch lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str],
           latest_by: str | Sequence[str] | None = None, side: str = "unique") -> DataFrame:
    """The latest delta row of each key, and the base rows whose key the delta does not hold.

    A delta with several versions of a key is reduced to the one of the
    greatest ``latest_by``; without it to the greatest by all columns. Keys are compared by
    value as grouping does: null equals null, 0.0 equals -0.0, timestamps count to the
    microsecond. Adaptive execution splits a key that holds much of the base; with
    ``side="salted"`` such keys are looked for and salted.
    """
    delta = dedupe_latest(delta, keys, latest_by if latest_by is not None else [
        c for c in delta.columns if c not in keys])
    common = union_batches(base.select(*keys).limit(0), delta.select(*keys).limit(0)).schema
    mark = fresh("_key", base, delta)
    # Structs are equal where their fields are, null fields too.
    key = F.struct(*[F.col(k).cast(common[k].dataType).alias(k) for k in keys]).alias(mark)
    kept = skew_safe_join(base.withColumn(mark, key), delta.select(key), [mark], "left_anti", side)
    return union_batches(delta, kept.drop(mark))


def detect_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str],
                   latest_by: str | Sequence[str] | None = None) -> DataFrame:
    """Each key labelled ``new``, ``changed``, ``same`` or ``missing`` (only in the old load).

    Both loads are reduced to one row per key: the latest by ``latest_by``, or
    the greatest by all compared columns. Null keys are equal to each other. Values are compared
    null-safely and in full, so no change can hide behind a hash collision.
    """
    was, now = fresh("_old", old, new), fresh("_new", old, new)

    def side(df: DataFrame, name: str) -> DataFrame:
        if latest_by is None:
            df = df.select(*dict.fromkeys([*keys, *columns]))  # nothing else decides
        single = dedupe_latest(df, keys, latest_by if latest_by is not None else list(columns))
        return single.select(*keys, F.struct(*comparable(df, columns)).alias(name))

    # One row per key and side: the lists hold at most one value, and null keys group.
    both = union_batches(side(old, was), side(new, now)).groupBy(*keys).agg(
        F.collect_list(was).alias(was), F.collect_list(now).alias(now))
    label = (F.when(F.size(was) == 0, "new")
             .when(F.size(now) == 0, "missing")
             .when(F.get(was, F.lit(0)).eqNullSafe(F.get(now, F.lit(0))), "same")
             .otherwise("changed"))
    return both.withColumn("change", label).select(*keys, "change")


def reprocess(df: DataFrame, path: str, ingestion_date: str) -> None:
    """Load one date again without touching the others; without rows the date is emptied."""
    dated, seen = observed(df.withColumn("ingestion_date", F.lit(ingestion_date)), "reprocessed")
    load_partitions(dated, path, rebalance=False)
    if not seen.get["n_records"]:
        clear_partitions(df.sparkSession, path, [ingestion_date])
