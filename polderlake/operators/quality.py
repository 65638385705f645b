"""Quality checks. Reports share the columns check, dataset, column, n_bad, passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polderlake.functions.scalars import data_lines, is_blank, raw_bytes
from polderlake.operators.dedupe import dedupe_latest
from polderlake.operators.joins import orphans


@dataclass(frozen=True)
class RangeRule:
    """``low <= column <= high``; a bound left out does not apply, nulls pass."""

    column: str
    low: float | None = None
    high: float | None = None

    def bad(self) -> Column:
        value = F.col(self.column)
        tests = []
        if self.low is not None:
            tests.append(value < F.lit(self.low))
        if self.high is not None:
            tests.append(value > F.lit(self.high))
        if not tests:
            raise ValueError(f"range rule without bounds: {self.column}")
        return reduce(lambda a, b: a | b, tests)


def schema_report(df: DataFrame, dataset: str, contract: StructType) -> DataFrame:
    """Missing, extra and wrongly typed columns against the contract; no row is read."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in contract.fields}
    rows = []
    for name in [*want, *[n for n in have if n not in want]]:
        if name not in have:
            check = "missing_column"
        elif name not in want:
            check = "extra_column"
        elif have[name] != want[name]:
            check = "wrong_type"
        else:
            check = "schema"
        bad = int(check != "schema")
        rows.append((check, dataset, name, bad, not bad))
    return df.sparkSession.createDataFrame(
        rows, "check string, dataset string, column string, n_bad bigint, passed boolean")


def type_report(df: DataFrame, dataset: str, contract: StructType) -> DataFrame:
    """Values, per column, that are set but do not parse as the contract's type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    conditions = {
        f.name: F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        for f in contract.fields if f.name in have}
    return _bad_counts(df, "type", dataset, conditions)


def _bad_counts(df: DataFrame, check: str, dataset: str,
                conditions: Mapping[str, Column]) -> DataFrame:
    """Bad rows per condition, all counted in one pass and then turned into report rows."""
    counts = df.agg(*[F.count(F.when(bad, True)).alias(name) for name, bad in conditions.items()])
    return (counts.unpivot([], list(conditions), "column", "n_bad")
            .select(F.lit(check).alias("check"), F.lit(dataset).alias("dataset"), "column",
                    "n_bad", (F.col("n_bad") == 0).alias("passed")))


def null_report(df: DataFrame, dataset: str, columns: Sequence[str]) -> DataFrame:
    return _bad_counts(df, "nulls", dataset, {c: F.col(c).isNull() for c in columns})


def range_report(df: DataFrame, dataset: str, rules: Sequence[RangeRule]) -> DataFrame:
    conditions: dict[str, Column] = {}
    for rule in rules:
        bad = rule.bad()
        conditions[rule.column] = conditions[rule.column] | bad if rule.column in conditions else bad
    return _bad_counts(df, "range", dataset, conditions)


def duplicate_grains(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def grain_report(df: DataFrame, dataset: str, keys: Sequence[str]) -> DataFrame:
    counted = duplicate_grains(df, keys).agg(F.count(F.lit(1)).alias("n_bad"))
    return counted.select(F.lit("grain").alias("check"), F.lit(dataset).alias("dataset"),
                          F.lit(",".join(keys)).alias("column"), "n_bad",
                          (F.col("n_bad") == 0).alias("passed"))


def referential_report(child: DataFrame, parent: DataFrame, dataset: str,
                       on: Sequence[str]) -> DataFrame:
    counted = orphans(child, parent, on).agg(F.count(F.lit(1)).alias("n_bad"))
    return counted.select(F.lit("referential").alias("check"), F.lit(dataset).alias("dataset"),
                          F.lit(",".join(on)).alias("column"), "n_bad",
                          (F.col("n_bad") == 0).alias("passed"))


def flag_rows(df: DataFrame, rules: Mapping[str, Column], into: str = "reasons") -> DataFrame:
    """Add the names of all violated rules; ``rules`` maps a name to the bad condition."""
    flags = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return df.withColumn(into, F.array_compact(flags))


def quarantine(df: DataFrame, rules: Mapping[str, Column],
               into: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their reasons; together they are all rows."""
    flagged = flag_rows(df, rules, into)
    good = flagged.where(F.size(into) == 0).drop(into)
    return good, flagged.where(F.size(into) > 0)


def write_quarantine(df: DataFrame, rules: Mapping[str, Column], path: str) -> None:
    """Both sides of a quarantine in one pass: partitions ``dq_status=good`` and ``=bad``."""
    flagged = flag_rows(df, rules)
    status = F.when(F.size("reasons") == 0, "good").otherwise("bad")
    (flagged.withColumn("dq_status", status).write.mode("overwrite")
     .option("partitionOverwriteMode", "static")
     .partitionBy("dq_status").parquet(path))


def availability(df: DataFrame, dataset: str) -> DataFrame:
    """Whether the dataset holds any record; looks for one row only."""
    return df.limit(1).agg((F.count(F.lit(1)) > 0).alias("available")).select(
        F.lit(dataset).alias("dataset"), "available")


def run_summary(runs: DataFrame) -> DataFrame:
    """Total records, endpoint count and worst status of each date's load.

    Of an endpoint that ran more than once for a date the last run counts, as
    a run overwrites what an earlier one left.
    """
    runs = dedupe_latest(runs, ["source", "dataset_name", "ingestion_date", "endpoint"],
                         "ingestion_datetime")
    failed = F.max(F.when(F.col("status") != "success", F.col("status")))
    return runs.groupBy("source", "dataset_name", "ingestion_date").agg(
        F.count("endpoint").alias("n_endpoints"),
        F.coalesce(F.sum("n_records"), F.lit(0)).alias("total_records"),
        F.coalesce(failed, F.lit("success")).alias("status"))


def run_gate(summary: DataFrame) -> DataFrame:
    """``fail`` for a run without success, ``warn`` for one without records, else ``pass``."""
    gate = (F.when(F.col("status") != "success", "fail")
            .when(F.col("total_records") == 0, "warn")
            .otherwise("pass"))
    return summary.withColumn("gate", gate)


def enforce_gate(summary: DataFrame) -> None:
    """Raise when any run failed, naming the datasets and dates that did."""
    each = F.concat_ws(" ", "dataset_name", "ingestion_date", F.lit("is"), "status")
    bad = run_gate(summary).where(F.col("gate") == "fail").agg(
        F.array_join(F.array_sort(F.collect_set(each)), ", ").alias("names")).first()["names"]
    if bad:
        raise ValueError(f"ingestion failed: {bad}")


def profile_payload(df: DataFrame, text: str) -> DataFrame:
    """Add data lines, UTF-8 bytes and whether there is anything in each payload."""
    column = F.col(text)
    return df.withColumns({"data_lines": data_lines(column), "raw_bytes": raw_bytes(column),
                           "is_empty": is_blank(column)})


def require_payload(df: DataFrame, text: str) -> DataFrame:
    """Fail on an empty payload when the rows are read."""
    checked = F.when(is_blank(F.col(text)), F.raise_error(F.lit("empty payload"))).otherwise(
        F.col(text))
    return df.withColumn(text, checked)
