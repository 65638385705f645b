from functools import partial

import pytest
from pyspark.sql import functions as F

from polderlake.catalog import STATISTICS, load_catalog, silver_path
from polderlake.plans import gold as gold_plan
from polderlake.session import side_by_side
from polderlake.sources.tables import load_partitions


def test_a_single_load_is_not_ranked_again(spark, tmp_path):
    spec = next(s for s in load_catalog(STATISTICS).values() if s.grain)
    root = str(tmp_path)
    row = spark.range(3).select(*[
        F.lit(None).cast(f.dataType).alias(f.name) if f.name not in spec.source_grain
        else F.col("id").cast(f.dataType).alias(f.name) for f in spec.silver_schema.fields
        if f.name != "ingestion_date"])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    load_partitions(row.withColumn("ingestion_date", F.lit("2024-02-01")), silver_path(root, spec))
    once = gold_plan.current(spark, root, spec)
    assert once.count() == 3 and "Window" not in plan(once)
    load_partitions(row.withColumn("ingestion_date", F.lit("2024-02-02")), silver_path(root, spec))
    twice = gold_plan.current(spark, root, spec)
    assert "Window" in plan(twice) and twice.count() == 3
    assert {str(r["ingestion_date"]) for r in twice.collect()} == {"2024-02-02"}


def test_calls_side_by_side_keep_their_order_and_the_first_failure(spark):
    assert side_by_side(spark, [partial(spark.range(n).count) for n in (3, 1, 2)]) == [3, 1, 2]
    assert side_by_side(spark, []) == []
    done = []

    def fail(text):
        raise ValueError(text)

    with pytest.raises(ValueError, match="first"):
        side_by_side(spark, [partial(fail, "first"), partial(fail, "second"), lambda: done.append(1)])
    assert done == [1]
