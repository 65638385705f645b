"""Gold aggregates: rollups by grain, market and income tables, time facts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from polderlake.catalog import DatasetSpec
from polderlake.functions.scalars import exact_sum, iso_date, sum_parts, sum_result
from polderlake.operators.joins import BROADCAST_BYTES, enrich, fits_broadcast


@dataclass(frozen=True)
class Measure:
    """One aggregate: ``name`` = ``fn(column)``.

    ``fn`` is avg, sum, min, max, count, or newest: the latest date as ISO
    text. ``newest`` aggregates dates, because a maximum of strings would make
    Spark sort the facts instead of hashing them.
    """

    name: str
    fn: str
    column: str

    def parts(self, df: DataFrame) -> dict[str, Column]:
        """The mergeable aggregates the measure is made of."""
        column = F.col(self.column)
        kind = df.schema[self.column].dataType
        if self.fn == "avg":
            return {**sum_parts(self.column, kind), "n": F.count(column)}
        if self.fn == "sum":
            return sum_parts(self.column, kind)
        if self.fn == "count":
            return {"n": F.count(column)}
        if self.fn in ("min", "max"):
            return {self.fn: getattr(F, self.fn)(column)}
        if self.fn == "newest":
            return {"max": F.max(column.cast("date"))}
        raise ValueError(f"unknown aggregate: {self.fn}")

    def result(self, part: Callable[[str], Column], df: DataFrame) -> Column:
        """The measure from its finished parts."""
        if self.fn in ("avg", "sum"):
            kind = df.schema[self.column].dataType
            sums = {p: part(p) for p in sum_parts(self.column, kind)}
            if self.fn == "avg":
                value = sum_result(sums) / part("n")
            else:
                value = sums["s"] if isinstance(kind, IntegralType) else sum_result(sums)
        elif self.fn == "newest":
            value = iso_date(part("max"))
        else:
            value = part("n" if self.fn == "count" else self.fn)
        return value.alias(self.name)


def rollup(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Aggregate by keys. All measures combine map-side, so hot keys shuffle as partial rows."""
    return df.groupBy(*keys).agg(*[
        m.result(m.parts(df).__getitem__, df) for m in measures])


MERGE = {**dict.fromkeys(("s", "h", "l", "t", "r"), F.sum), "n": F.sum, "min": F.min, "max": F.max}


def rollup_through(facts: DataFrame, dimension: DataFrame, on: Sequence[str],
                   columns: Sequence[str], keys: Sequence[str], measures: Sequence[Measure],
                   max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Aggregate facts by ``columns`` of a dimension and by fact ``keys``; facts must match.

    A dimension that is measured to fit is broadcast, and the facts are
    aggregated once. Otherwise the facts are first reduced to the join key
    and ``keys``, so no key is hot in the join, and the parts are merged after it.
    Measures are of fact columns; one of a dimension column is refused either way.
    """
    on = list(on)
    foreign = [m.column for m in measures if m.column not in facts.columns]
    if foreign:
        raise ValueError(f"measures of columns that are no facts: {', '.join(foreign)}")
    side = dimension.select(*on, *columns)
    if fits_broadcast(side, max_bytes):
        return rollup(facts.join(F.broadcast(side), on), [*columns, *keys], measures)
    partial = facts.groupBy(*on, *keys).agg(*[
        c.alias(f"_{m.name}_{part}") for m in measures for part, c in m.parts(facts).items()])
    merged = partial.join(side, on).groupBy(*columns, *keys)
    return merged.agg(*[
        m.result(lambda part, m=m: MERGE[part](f"_{m.name}_{part}"), facts) for m in measures])


def rollup_by_spec(df: DataFrame, spec: DatasetSpec,
                   functions: Sequence[str] = ("avg", "min", "max", "sum"),
                   business_names: bool = True) -> DataFrame:
    """Every measure of the contract by its grain, as ``<fn>_<measure>``."""
    named = (lambda c: c) if business_names else spec.source_name
    measures = [Measure(f"{fn}_{m}", fn, named(m)) for m in spec.measures for fn in functions]
    return rollup(df, [named(g) for g in spec.grain], measures)


def latest_load(column: str = "ingestion_date") -> Measure:
    return Measure("last_updated", "newest", column)


#: How a table is rolled up by keys: anew (``rollup``), or from a state kept by deltas.
Roll = Callable[[DataFrame, Sequence[str], Sequence[Measure]], DataFrame]


def region_period_stats(df: DataFrame, keys: Sequence[str], population: str, households: str,
                        income: str, roll: Roll = rollup) -> DataFrame:
    return roll(df, keys, [
        Measure("avg_population", "avg", population),
        Measure("max_population", "max", population),
        Measure("avg_households", "avg", households),
        Measure("avg_income_per_resident", "avg", income),
        latest_load(),
    ])


def value_trends(df: DataFrame, keys: Sequence[str], value: str, roll: Roll = rollup) -> DataFrame:
    return roll(df, keys, [
        Measure("avg_property_value", "avg", value),
        Measure("max_property_value", "max", value),
        Measure("min_property_value", "min", value),
        latest_load(),
    ])


def market_analysis(housing: DataFrame, values: DataFrame, keys: Sequence[str],
                    join_keys: Sequence[str], dwellings: str, value: str,
                    roll: Roll = rollup) -> DataFrame:
    """Dwellings by keys with the property value of their region and period.

    The housing rows are aggregated before the join: ``keys`` contain the join
    keys and ``values`` has one row per join key, so its value is constant
    within a group, and the join moves group rows instead of facts.
    """
    totals = roll(housing, keys, [
        Measure("avg_dwellings", "avg", dwellings),
        Measure("total_dwellings", "sum", dwellings),
        latest_load(),
    ])
    side = values.select(*join_keys, F.col(value).cast("double").alias("avg_property_value"))
    joined = enrich(totals, side, join_keys, ["avg_property_value"], "left",
                    side="unique")
    return joined.select(*keys, "avg_dwellings", "total_dwellings", "avg_property_value",
                         "last_updated")


def market_from_facts(facts: DataFrame, join_keys: Sequence[str], extra: Sequence[str],
                      dwellings: str, price: str) -> DataFrame:
    """``market_analysis`` where one table has both: the facts are read and shuffled once.

    Facts without dwellings count towards the mean price of their region and
    period only. The sums per key are few, and their totals per region and
    period are taken from them, not from the facts again.
    """
    day = F.when(F.col(dwellings).isNotNull(), F.col("ingestion_date").cast("date"))
    amounts = sum_parts(dwellings, facts.schema[dwellings].dataType)
    prices = sum_parts(price, facts.schema[price].dataType)
    sums = facts.groupBy(*join_keys, *extra).agg(
        F.count(dwellings).alias("_n"), F.max(day).alias("_day"), F.count(price).alias("_priced"),
        *[c.alias(f"_a{p}") for p, c in amounts.items()],
        *[c.alias(f"_p{p}") for p, c in prices.items()])
    place = Window.partitionBy(*join_keys)
    total = sum_result({p: F.sum(f"_p{p}").over(place) for p in prices})
    amount = sum_result({p: F.col(f"_a{p}") for p in amounts})
    return (sums.withColumn("avg_property_value", total / F.sum("_priced").over(place))
            .where(F.col("_n") > 0)
            .select(*join_keys, *extra, (amount / F.col("_n")).alias("avg_dwellings"),
                    amount.alias("total_dwellings"), "avg_property_value",
                    iso_date(F.col("_day")).alias("last_updated")))


def socio_indicators(income: DataFrame, residents: DataFrame, keys: Sequence[str],
                     join_keys: Sequence[str], avg_income: str, median_income: str,
                     per_resident: str, median_name: str = "avg_median_income",
                     roll: Roll = rollup) -> DataFrame:
    """Income by keys where the residents table knows the region and period.

    The mean of a column of medians is what is computed; it is not a median,
    and is named so unless ``median_name`` asks for another name.
    """
    totals = roll(income, keys, [
        Measure("avg_household_income", "avg", avg_income),
        Measure(median_name, "avg", median_income),
        latest_load(),
    ])
    side = residents.select(*join_keys,
                            F.col(per_resident).cast("double").alias("avg_income_per_resident"))
    joined = enrich(totals, side, join_keys, ["avg_income_per_resident"], "inner",
                    side="unique")
    return joined.select(*keys, "avg_household_income", median_name, "avg_income_per_resident",
                         "last_updated")


def minute_facts(df: DataFrame, ts: str, keys: Sequence[str], value: str,
                 width: str = "1 minute", name: str = "minute") -> DataFrame:
    """Count, total and mean per tumbling window and key, on a batch or a stream."""
    grouped = df.groupBy(F.window(ts, width).alias("_w"), *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("n_values"),
        exact_sum(df, value).alias("_total"))
    return grouped.select(
        F.col("_w.start").alias(name), *keys, "n", "n_values",
        F.col("_total").alias("total"), (F.col("_total") / F.col("n_values")).alias("avg_value"))


def coarser_facts(facts: DataFrame, keys: Sequence[str], width: str = "1 hour",
                  name: str = "hour", finer: str = "minute") -> DataFrame:
    """Facts of a longer window from those of a shorter one: sums of sums, sums of counts."""
    grouped = facts.groupBy(F.window(finer, width).alias("_w"), *keys).agg(
        F.sum("n").alias("n"),
        F.sum("n_values").alias("n_values"),
        exact_sum(facts, "total").alias("_total"))
    return grouped.select(
        F.col("_w.start").alias(name), *keys, "n", "n_values",
        F.col("_total").alias("total"), (F.col("_total") / F.col("n_values")).alias("avg_value"))


def region_features(facts: DataFrame, key_to_region: DataFrame, on: Sequence[str],
                    region: str, keys: Sequence[str], value: str,
                    max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Readings per region and ``keys``: count, bounds and mean."""
    return rollup_through(facts, key_to_region, on, [region], keys, [
        Measure("n", "count", on[0]),
        Measure("min_v", "min", value),
        Measure("max_v", "max", value),
        Measure("avg_v", "avg", value),
    ], max_bytes)
