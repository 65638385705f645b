"""Bronze to silver shaping: flatten, tag, rename, type, drop invalid rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType


def flatten_envelope(df: DataFrame, column: str = "value") -> DataFrame:
    """One row per element of the envelope's array; a frame without it passes through."""
    if column not in df.columns:
        return df
    return df.select(F.explode(column).alias("_row")).select("_row.*")


def tag_lineage(df: DataFrame, source: str, dataset: str, ingestion_date: str,
                run_ts: datetime | Column) -> DataFrame:
    """Lineage columns. The clock is an argument, so a re-run gives the same rows."""
    stamp = run_ts if isinstance(run_ts, Column) else F.lit(run_ts)
    return df.withColumns({
        "ingestion_timestamp": stamp,
        "source": F.lit(source),
        "dataset_name": F.lit(dataset),
        "ingestion_date": F.lit(ingestion_date),
    })


def tag_gold(df: DataFrame, table: str, run_ts: datetime | None = None) -> DataFrame:
    tagged = df.withColumn("gold_table", F.lit(table))
    return tagged if run_ts is None else tagged.withColumn("created_timestamp", F.lit(run_ts))


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Business names from the catalogue map; two columns may not end up with one name."""
    renamed = [mapping.get(c, c) for c in df.columns]
    if len(set(renamed)) != len(renamed):
        raise ValueError("renaming would give two columns the same name")
    return df.withColumnsRenamed(dict(mapping))


def cast_columns(df: DataFrame, types: Mapping[str, str | DataType] | StructType) -> DataFrame:
    """Contract types; a value that does not parse becomes null, strings are trimmed."""
    if isinstance(types, StructType):
        types = {f.name: f.dataType for f in types.fields}
    out: dict[str, Column] = {}
    for name, kind in types.items():
        if name not in df.columns:
            continue
        value = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, StringType):
            value = F.trim(value)
        out[name] = value.try_cast(kind)
    return df.withColumns(out)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the contract's columns, typed; columns the batch lacks are null."""
    missing = {f.name: F.lit(None).cast(f.dataType)
               for f in schema.fields if f.name not in df.columns}
    return cast_columns(df.withColumns(missing), schema).select(schema.fieldNames())


def drop_invalid(df: DataFrame, required: Iterable[str] = (),
                 rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows whose required columns are set and for which no rule is violated.

    ``rules`` maps a name to the condition that makes a row bad; an undecided
    (null) condition does not.
    """
    kept = df.dropna(subset=list(required)) if required else df
    for bad in (rules or {}).values():
        kept = kept.where(~F.coalesce(bad, F.lit(False)))
    return kept
