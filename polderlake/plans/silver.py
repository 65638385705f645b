"""Bronze to silver for catalogue datasets and feeds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from polderlake.catalog import (FEEDS, STATISTICS, DatasetSpec, bronze_path, current_path,
                                silver_path)
from polderlake.operators.dedupe import dedupe_latest, latest_snapshot
from polderlake.operators.incremental import upsert
from polderlake.operators.joins import lookup
from polderlake.operators.normalize import conform, drop_invalid, rename_columns, tag_lineage
from polderlake.sources.readers import (comment_names, read_commented_csv, read_envelope,
                                        read_feature_maps, read_json_files, read_pages, read_parquet,
                                        read_partition, read_silver)
from polderlake.sources.tables import load_partitions, observed, run_record, write_gold, write_run


def clean(raw: DataFrame, spec: DatasetSpec, ingestion_date: str, run_ts: datetime,
          order_by: Sequence[str] = (), business_names: bool = False) -> DataFrame:
    """Typed, tagged, valid rows, one per grain.

    ``order_by`` says what makes a row the latest; without it all measures do,
    which is arbitrary but the same on every run.
    """
    typed = drop_invalid(conform(raw, spec.schema), required=spec.source_grain)
    rest = [c for c in typed.columns if c not in spec.source_grain]
    single = (dedupe_latest(typed, spec.source_grain, list(order_by) or rest)
              if spec.grain else typed)
    named = rename_columns(single, spec.columns) if business_names else single
    return tag_lineage(named, spec.source, spec.name, ingestion_date, run_ts)


def with_titles(df: DataFrame, titles: DataFrame, code: str, name: str) -> DataFrame:
    """Fill ``name`` from a dimension of ``Key`` and ``Title`` where the facts lack it."""
    clean_titles = titles.select(F.trim("Key").alias(code), F.col("Title").alias("_title"))
    single = dedupe_latest(clean_titles, [code], ["_title"])
    return (lookup(df, single, [code], ["_title"])
            .withColumn(name, F.coalesce(F.col(name), F.col("_title")))
            .select(df.columns))


def build_silver(spark: SparkSession, spec: DatasetSpec, bronze_root: str, silver_root: str,
                 ingestion_date: str, run_ts: datetime, runs: str | None = None,
                 layout: str = "envelope", business_names: bool = False,
                 order_by: Sequence[str] = (), titles: dict[str, tuple[str, str]] | None = None,
                 endpoints: bool = False) -> int:
    """Load one date of a statistics dataset; loading it again replaces that date.

    ``titles`` maps a dimension file of the same date to the code and name
    columns it explains, as in ``{"regions.json": ("RegioS", "RegioNaam")}``.
    With ``endpoints`` the run records also say how many rows came from each landed file.
    """
    if layout not in ("envelope", "pages"):
        raise ValueError(f"unknown bronze layout: {layout}")
    base = f"{bronze_path(bronze_root, spec)}/ingestion_date={ingestion_date}"

    def build() -> DataFrame:
        raw = (read_envelope(spark, f"{base}/typeddataset.json", spec.schema)
               if layout == "envelope" else read_pages(spark, f"{base}/typed_dataset", spec.schema))
        raw = conform(raw, spec.schema)
        if endpoints:
            raw, landed[FACTS] = observed(raw, f"bronze_{spec.name}")
        for file, (code, name) in (titles or {}).items():
            dimension = read_pages(spark, f"{base}/{file}", "Key string, Title string",
                                   multi_line=True)
            if endpoints:
                landed[file.removesuffix(".json")] = dimension
            raw = with_titles(raw, dimension, code, name)
        return clean(raw, spec, ingestion_date, run_ts, order_by, business_names)

    landed: dict[str, Observation | DataFrame] = {}
    n = load_counted(spark, build, spec, silver_root, ingestion_date, run_ts, runs)
    if runs is not None:
        for endpoint, rows in landed.items():
            count = rows.get["n_records"] if isinstance(rows, Observation) else rows.count()
            write_run(run_record(spark, spec.source, spec.name, ingestion_date, endpoint, count,
                                 run_ts, table_id=spec.table_id), runs)
    return n


#: The endpoint of the facts, as run records name it.
FACTS = "typeddataset"
#: Dimension files whose titles fill in what facts lack: code and name column.
TITLES = {"regions.json": ("RegioS", "RegioNaam")}


def landed_titles(spark: SparkSession, spec: DatasetSpec, bronze_root: str, ingestion_date: str,
                  titles: dict[str, tuple[str, str]] | None = None) -> dict[str, tuple[str, str]]:
    """Those of the titles whose file was landed that day and whose columns the dataset has."""
    found = {}
    for file, columns in (TITLES if titles is None else titles).items():
        path = spark._jvm.org.apache.hadoop.fs.Path(
            f"{bronze_path(bronze_root, spec)}/ingestion_date={ingestion_date}/{file}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if there and set(columns) <= set(spec.schema.fieldNames()):
            found[file] = columns
    return found


def refresh_current(spark: SparkSession, spec: DatasetSpec, silver_root: str, as_of: str,
                    previous: str | None = None) -> str:
    """Write the latest row per grain after the load of date ``as_of``; returns its path.

    With ``previous``, the date of the refresh before, only that snapshot and
    the rows of the new date are read: dates must then be refreshed in order.
    Without it all loads up to the date are ranked, as after reloading an old date.
    """
    if previous is not None and previous >= as_of:
        raise ValueError(f"snapshot of {previous} is not before {as_of}")
    table = silver_path(silver_root, spec)
    if previous is None:
        loads = read_silver(spark, table, spec.silver_schema)
        rows = latest_snapshot(loads.where(F.col("ingestion_date") <= as_of), spec.source_grain)
    else:
        base = read_silver(spark, current_path(silver_root, spec, previous), spec.silver_schema)
        delta = read_partition(spark, table, as_of, schema=spec.silver_schema)
        rows = upsert(base, delta, spec.source_grain)
    out = current_path(silver_root, spec, as_of)
    write_gold(rows.select(spec.silver_schema.fieldNames()), out)
    return out


def snapshot_dates(spark: SparkSession, spec: DatasetSpec, silver_root: str) -> list[str]:
    """The dates for which ``refresh_current`` left a snapshot, in order."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(current_path(silver_root, spec, "*"))
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName().partition("=")[2] for s in fs.globStatus(pattern) or [])


def refresh_all(spark: SparkSession, silver_root: str, ingestion_date: str
                ) -> tuple[str, dict[str, str | None]]:
    """Snapshots of the statistics after the load of a date; returns the date they stand for and,
    by dataset, the date of the snapshot each was made from.

    A new date is merged into the snapshot before it. When later dates were
    loaded already, the newest snapshot is ranked anew over all loads.
    """
    made_from: dict[str, str | None] = {}
    newest = max([ingestion_date, *[d for spec in STATISTICS
                                    for d in snapshot_dates(spark, spec, silver_root)]])
    for spec in STATISTICS:
        earlier = [d for d in snapshot_dates(spark, spec, silver_root) if d < ingestion_date]
        previous = earlier[-1] if earlier and newest == ingestion_date else None
        refresh_current(spark, spec, silver_root, newest, previous)
        made_from[spec.name] = previous
    return newest, made_from


def build_feed_silver(spark: SparkSession, spec: DatasetSpec,
                      read: Callable[[SparkSession, str], DataFrame], bronze_root: str,
                      silver_root: str, ingestion_date: str, run_ts: datetime,
                      runs: str | None = None) -> int:
    """Load one date of a geo, weather or traffic feed through its reader; errors are raised."""
    base = f"{bronze_path(bronze_root, spec)}/ingestion_date={ingestion_date}"

    def build() -> DataFrame:
        return tag_lineage(read(spark, base), spec.source, spec.name, ingestion_date, run_ts)

    return load_counted(spark, build, spec, silver_root, ingestion_date, run_ts, runs)


def load_counted(spark: SparkSession, build: Callable[[], DataFrame], spec: DatasetSpec, silver_root: str,
                 ingestion_date: str, run_ts: datetime, runs: str | None) -> int:
    """Build, write, count on the way and leave a run record, also for a failure."""
    def record(n: int, status: str, error: str | None = None) -> None:
        if runs is not None:
            write_run(run_record(spark, spec.source, spec.name, ingestion_date, "silver", n,
                                 run_ts, status, error, spec.table_id), runs)

    try:
        counted, seen = observed(build(), f"silver_{spec.name}")
        load_partitions(counted, silver_path(silver_root, spec), rebalance=False)
        n = seen.get["n_records"]
    except Exception as e:
        record(0, "failed", str(e))
        raise
    record(n, "success")
    return n


def _weather(spark: SparkSession, path: str) -> DataFrame:
    """Text columns, named by the comment line that lists them: types inferred from one date's
    values would clash with those of another."""
    rows = read_commented_csv(spark, f"{path}/*.csv", infer=False)
    names = comment_names(spark, f"{path}/*.csv")
    return rows.toDF(*names) if names and len(names) == len(rows.columns) else rows


def _features(spark: SparkSession, path: str) -> DataFrame:
    return read_feature_maps(spark, f"{path}/data.json")


def xml_rows(row_tag: str) -> Callable[[SparkSession, str], DataFrame]:
    """A reader of ``raw_data.xml`` whose rows are the elements of that tag, as text columns."""
    def read(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").option(
            "inferSchema", False).load(f"{path}/raw_data.xml")
    return read


def _traffic(spark: SparkSession, path: str) -> DataFrame:
    return read_json_files(spark, f"{path}/*.json")


LANDED_READERS = {"bag_pand": _features, "bag_verblijfsobject": _features,
                  "daily_weather_all_stations": _weather,
                  "current_traffic_sample": xml_rows("measurement")}
FEED_READERS = {"addresses": read_parquet, "weather_stations": _weather, "traffic_flow": _traffic}


def build_date(spark: SparkSession, bronze_root: str, silver_root: str, ingestion_date: str,
               run_ts: datetime, runs: str | None = None, layout: str = "envelope",
               readers: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None,
               feeds: Sequence[DatasetSpec] = FEEDS,
               titles: dict[str, tuple[str, str]] | None = None) -> dict[str, int]:
    """Load one date of all datasets: statistics, which must succeed, then the feeds.

    The feeds do not depend on each other: all are tried before the first
    failure is raised. ``readers`` replaces feed readers, for instance by ones
    with a schema; a feed mapped to None is left out. ``feeds`` are the
    catalogue's ``FEEDS``, its ``LANDED_FEEDS``, or both. ``titles`` are the dimension files used
    where they were landed, by default ``TITLES``.
    """
    counts = {spec.name: build_silver(
        spark, spec, bronze_root, silver_root, ingestion_date, run_ts, runs, layout,
        titles=landed_titles(spark, spec, bronze_root, ingestion_date, titles), endpoints=True)
        for spec in STATISTICS}
    failure: Exception | None = None
    for spec in feeds:
        read = {**FEED_READERS, **LANDED_READERS, **(readers or {})}[spec.name]
        if read is None:
            continue
        try:
            counts[spec.name] = build_feed_silver(spark, spec, read, bronze_root, silver_root,
                                                  ingestion_date, run_ts, runs)
        except Exception as e:
            failure = failure or e
    if failure is not None:
        raise failure
    return counts
