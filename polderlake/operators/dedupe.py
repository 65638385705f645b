"""Latest-wins deduplication with a fully determined survivor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polderlake.catalog import DatasetSpec
from polderlake.functions.scalars import comparable, fresh


def dedupe_latest(df: DataFrame, keys: Sequence[str], order_by: str | Sequence[str],
                  tie_break: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the greatest ``order_by``, ties decided by ``tie_break``.

    By default all remaining columns break ties, so equal candidates are
    equal rows and the result never depends on row order. Filtering the rank
    to one lets Spark keep a single candidate per key in every task before
    the shuffle: a key with a third of the rows sends one row per task.
    """
    if not keys:
        raise ValueError("latest row of no key: every row would be compared with every other")
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    rest = tie_break if tie_break is not None else [
        c for c in df.columns if c not in keys and c not in order]
    ranking = [c.desc_nulls_last() for c in comparable(df, [*order, *rest])]
    return _first_ranked(df, [F.col(k) for k in keys], ranking)


def _first_ranked(df: DataFrame, keys: Sequence[Column], ranking: Sequence[Column]) -> DataFrame:
    rank = fresh("_rank", df)
    window = Window.partitionBy(*keys).orderBy(*ranking)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) == 1).drop(rank)


def dedupe_by_grain(df: DataFrame, spec: DatasetSpec, order_by: str | Sequence[str],
                    business_names: bool = False) -> DataFrame:
    """``dedupe_latest`` on the grain declared in the catalogue."""
    keys = spec.grain if business_names else spec.source_grain
    return dedupe_latest(df, keys, order_by)


def drop_exact_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                          keep_first_by: str | None = None) -> DataFrame:
    """Distinct rows, or the first row by ``keep_first_by`` of each equal ``subset``.

    Long texts are compared behind a 64-bit hash: the sort settles on the
    hash and looks at the texts only where hashes agree, which keeps the
    comparison exact and cheap.
    """
    if subset is None:
        return df.distinct()
    if keep_first_by is None:
        return df.dropDuplicates(list(subset))
    keys = [F.xxhash64(*subset), *[F.col(c) for c in subset]]
    rest = [c for c in df.columns if c not in subset and c != keep_first_by]
    ranking = [c.asc_nulls_last() for c in comparable(df, [keep_first_by, *rest])]
    return _first_ranked(df, keys, ranking)


def latest_snapshot(df: DataFrame, keys: Sequence[str],
                    version: str = "ingestion_date") -> DataFrame:
    """The current row of every key over all loads of a table."""
    return dedupe_latest(df, keys, version)
