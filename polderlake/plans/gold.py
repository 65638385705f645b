"""Silver to gold: the five analytical tables of the statistics catalogue."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.catalog import (STATISTICS, DatasetSpec, current_path, gold_path, load_catalog,
                                silver_path)
from polderlake.functions.scalars import fresh
from polderlake.operators.dedupe import latest_snapshot
from polderlake.operators.deltas import apply_delta, gold_from_state, gold_state
from polderlake.operators.joins import skew_safe_join, wide_join
from polderlake.operators.normalize import tag_gold
from polderlake.operators.rollup import (Measure, Roll, market_analysis, region_period_stats, rollup,
                                         socio_indicators, value_trends)
from polderlake.session import scratch_path, side_by_side
from polderlake.sources.readers import read_partition, read_silver
from polderlake.sources.tables import existing_schema, observed, write_gold

# Gold table names.
NEIGHBOURHOOD = "gold_cbs_neighbourhood_analysis"
TRENDS = "gold_cbs_property_value_trends"
MARKET = "gold_cbs_housing_market_analysis"
SOCIO = "gold_cbs_socioeconomic_indicators"
DASHBOARD = "gold_regional_dashboard"

ON = ["RegioS", "Perioden"]
REGION_PERIOD = ["RegioS", "RegioNaam", "Perioden"]


def current(spark: SparkSession, silver_root: str, spec: DatasetSpec) -> DataFrame:
    """Latest row per grain of a silver table over all its loads.

    Each load holds one row per grain (``silver.clean``), so a single load is not ranked again.
    """
    df = read_silver(spark, silver_path(silver_root, spec), spec.silver_schema)
    return df if single_load(spark, silver_root, spec) else latest_snapshot(df, spec.source_grain)


def single_load(spark: SparkSession, silver_root: str, spec: DatasetSpec) -> bool:
    """Whether the silver table holds one date of a dataset that is loaded as one row per grain."""
    dates = spark._jvm.org.apache.hadoop.fs.Path(f"{silver_path(silver_root, spec)}/ingestion_date=*")
    fs = dates.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(spec.grain) and len(fs.globStatus(dates) or []) == 1


def gold_tables(read: Callable[[str], DataFrame], run_ts: datetime,
                roll: Callable[[str], Roll] = lambda name: rollup) -> dict[str, DataFrame]:
    """The gold DataFrames, given a reader of current silver tables by dataset name.

    ``roll`` says how a dataset is rolled up, by default anew from all its rows.
    """
    figures, worth = read("neighbourhood_key_figures"), read("average_woz_value")
    housing, income = read("housing_stock"), read("household_income")
    tables = {
        NEIGHBOURHOOD: region_period_stats(
            figures, REGION_PERIOD, "Inwoners_5", "AantalHuishoudens_10",
            "GemiddeldInkomenPerInwoner_25", roll("neighbourhood_key_figures")),
        TRENDS: value_trends(worth, REGION_PERIOD, "GemiddeldeWOZWaarde_1", roll("average_woz_value")),
        MARKET: market_analysis(
            housing, worth, [*REGION_PERIOD, "TypeWoning_3"], ON, "AantalWoningen_1",
            "GemiddeldeWOZWaarde_1", roll("housing_stock")),
        SOCIO: socio_indicators(
            income, figures, REGION_PERIOD, ON, "GemiddeldInkomenHuishouden_6",
            "MediaanInkomenHuishouden_7", "GemiddeldInkomenPerInwoner_25",
            median_name="median_household_income", roll=roll("household_income")),
    }
    out = {name: tag_gold(df, name) for name, df in tables.items()}
    # Income per resident is a column of the key figures; the income table does not carry it.
    base = figures.select(*REGION_PERIOD, "Inwoners_5", "AantalHuishoudens_10",
                          "GemiddeldInkomenPerInwoner_25")
    out[DASHBOARD] = tag_gold(
        wide_join(base, [(worth, ["GemiddeldeWOZWaarde_1"])], ON), DASHBOARD, run_ts)
    return out


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared scratch folder and read back.

    Several gold tables read each snapshot. Staging ranks the loads once
    instead of once per reader, and the readers scan only their columns.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_rollup(spark: SparkSession, spec: DatasetSpec, silver_root: str, state_root: str,
                as_of: str, previous: str | None) -> Roll:
    """A rollup of the snapshot ``as_of`` whose state is kept beside the gold tables.

    With the state and the snapshot of ``previous``, only that state and the rows that the load
    of ``as_of`` replaced and brought are rolled up; else all rows are, once.
    """
    path = lambda date: f"{state_root}/{spec.name}/as_of={date}"

    def roll(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
        if previous is not None and existing_schema(spark, path(previous)) is not None:
            added = read_partition(spark, silver_path(silver_root, spec), as_of,
                                   schema=spec.silver_schema)
            before = read_silver(spark, current_path(silver_root, spec, previous), spec.silver_schema)
            grain = fresh("_grain", before)
            key = F.struct(*spec.source_grain).alias(grain)
            removed = skew_safe_join(before.withColumn(grain, key), added.select(key), [grain],
                                     "left_semi").drop(grain)
            state = apply_delta(spark.read.parquet(path(previous)), added, removed, df, keys, measures)
        else:
            state = gold_state(df, keys, measures)
        write_gold(state, path(as_of))
        return gold_from_state(spark.read.parquet(path(as_of)), df, keys, measures)
    return roll


def build_gold(spark: SparkSession, silver_root: str, gold_root: str, run_ts: datetime,
               as_of: str | None = None, previous: Mapping[str, str | None] | None = None
               ) -> dict[str, int]:
    """Write all gold tables and return their row counts.

    With ``as_of`` the snapshots kept by ``refresh_current`` are read, and no
    history is ranked again. With ``previous`` as well, the date by dataset whose snapshot that
    of ``as_of`` was made from (or None), the rollups are kept by deltas. Snapshots do not depend
    on each other, nor do the tables: they are written side by side.
    """
    def snapshot(spec: DatasetSpec) -> DataFrame:
        if as_of is not None:
            return read_silver(spark, current_path(silver_root, spec, as_of), spec.silver_schema)
        rows = current(spark, silver_root, spec)
        if single_load(spark, silver_root, spec):
            return rows
        return staged(spark, rows, f"current-{spec.name}")

    specs = load_catalog(STATISTICS).values()
    snapshots = dict(zip([spec.name for spec in specs],
                         side_by_side(spark, [partial(snapshot, spec) for spec in specs])))
    if previous is None:
        tables = gold_tables(snapshots.__getitem__, run_ts)
    else:
        specs = {spec.name: spec for spec in load_catalog(STATISTICS).values()}
        tables = gold_tables(snapshots.__getitem__, run_ts, lambda name: kept_rollup(
            spark, specs[name], silver_root, f"{gold_root}/state", as_of, previous.get(name)))

    def write(name: str) -> int:
        counted, seen = observed(tables[name], name)
        group = "consolidated" if name == DASHBOARD else "cbs"
        write_gold(counted, gold_path(gold_root, group, name))
        return seen.get["n_records"]

    return dict(zip(tables, side_by_side(spark, [partial(write, name) for name in tables])))
