"""Layer tables: partition loads, evolving appends, gold overwrites, run records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polderlake.catalog import schema_of

# One row per run and endpoint.
RUN_SCHEMA = schema_of(
    source="string", dataset_name="string", table_id="string",
    ingestion_datetime="string", ingestion_date="string",
    endpoint="string", n_records="long", status="string", error="string")


def load_partitions(df: DataFrame, path: str, partition_by: str = "ingestion_date",
                    rebalance: bool = True) -> None:
    """Replace exactly the partitions present in ``df``; others stay as they are.

    A partition without rows is not present: name it to ``clear_partitions``. Running it twice leaves the same table. Rows are rebalanced by partition
    value, so a small partition gets few files and adaptive execution splits
    a partition value that holds much of the data over several tasks.
    """
    shaped = df.hint("rebalance", partition_by) if rebalance else df
    (shaped.write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_by)
     .parquet(path))


def clear_partitions(spark: SparkSession, path: str, values: Sequence[object],
                     partition_by: str = "ingestion_date") -> None:
    """Remove the folders of these partition values; none is there after a second run either."""
    conf = spark._jsc.hadoopConfiguration()
    for value in values:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition_by}={value}")
        folder.getFileSystem(conf).delete(folder, True)


def existing_schema(spark: SparkSession, path: str) -> StructType | None:
    try:
        return spark.read.option("mergeSchema", True).parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_evolving(df: DataFrame, path: str, contract: StructType | None = None,
                    cast: bool = False) -> None:
    """Append a batch that may lack columns or bring new ones.

    Parquet merges differing columns when read, but not differing types, so a
    batch whose type departs from the table (or from ``contract``, which
    spares the look at the table's footers) is refused, or cast on request.
    """
    target = contract if contract is not None else existing_schema(df.sparkSession, path)
    if target is not None:
        have = {f.name: f.dataType for f in df.schema.fields}
        clash = [f for f in target.fields if f.name in have and have[f.name] != f.dataType]
        if clash and not cast:
            detail = ", ".join(
                f"{f.name}: {have[f.name].simpleString()} for {f.dataType.simpleString()}"
                for f in clash)
            raise ValueError(f"batch does not fit the table: {detail}")
        df = df.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in clash})
    df.write.mode("append").parquet(path)


def write_gold(df: DataFrame, path: str) -> None:
    """Replace a gold table. Its inputs live elsewhere, so nothing reads ``path`` meanwhile."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass to a writer, without running the plan again.

    To be used right before the writer: a count taken ahead of a shuffle could
    include rows of a task that ran twice.
    """
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_records")), seen


def run_record(spark: SparkSession, source: str, dataset: str, ingestion_date: str,
               endpoint: str, n_records: int, run_ts: datetime, status: str = "success",
               error: str | None = None, table_id: str | None = None) -> DataFrame:
    """The manifest of one run and endpoint, as a row for the ``runs`` table."""
    row = (source, dataset, table_id, run_ts.strftime("%Y-%m-%d_%H-%M-%S"), ingestion_date,
           endpoint, n_records, status, error)
    return spark.range(0, 1, 1, 1).select(*[
        F.lit(value).cast(f.dataType).alias(f.name) for f, value in zip(RUN_SCHEMA.fields, row)])


# Appends to one folder at the same time would remove each other's temporary files.
_one_append = Lock()


def write_run(runs: DataFrame, path: str) -> None:
    """Append run records. A table, because Spark skips files named ``_summary.json``."""
    with _one_append:
        runs.select(RUN_SCHEMA.fieldNames()).coalesce(1).write.mode("append").parquet(path)
