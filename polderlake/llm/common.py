"""What several operators of this subpackage share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.session import scratch_path

#: White space as the exact-copy contract defines it.
BLANKS = r"[\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def staged(spark: SparkSession, df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends at a table every
    executor can reach, so a lost executor costs one task and not a recomputation."""
    path = scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))
