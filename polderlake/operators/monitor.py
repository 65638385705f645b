"""Monitoring: freshness, latency, failures, reconciliation and lineage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polderlake.functions.scalars import fresh
from polderlake.session import scratch_path


def freshness(df: DataFrame, by: Sequence[str], ts: str, anchor: Column,
              max_age_hours: int) -> DataFrame:
    """Newest record per group, its whole hours before the anchor, and whether that is fresh."""
    newest = df.groupBy(*by).agg(F.max(ts).alias("last_seen"))
    age = F.timestamp_diff("HOUR", F.col("last_seen"), anchor)
    return newest.withColumn("age_hours", age).withColumn(
        "is_fresh", F.col("age_hours") <= max_age_hours)


def latency(df: DataFrame, by: Sequence[str], start: Column, end: Column,
            percentile: float = 0.95) -> DataFrame:
    """Count, mean and exact percentile of whole days from event to availability.

    Rows are first counted per group and delay, so a group with much of the
    data reaches the percentile as one row per distinct delay.
    """
    counts = (df.withColumn("_days", F.date_diff(end, start).cast("bigint"))
              .groupBy(*by, "_days").agg(F.count(F.lit(1)).alias("_n")))
    known = F.col("_days").isNotNull()
    name = f"p{round(percentile * 100)}_days"
    return counts.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col("_days") * F.col("_n")).cast("double")
         / F.sum(F.when(known, F.col("_n")))).alias("avg_days"),
        F.percentile("_days", F.lit(percentile), F.col("_n")).alias(name))


def failure_rate(df: DataFrame, day: Column, failed: Column) -> DataFrame:
    counted = df.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(failed, True)).alias("failures"))
    return counted.withColumn("rate", F.col("failures").cast("double") / F.col("n"))


def layer_counts(dataset: str, layers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows per layer, in order. Inside a job take the counts from ``observed`` instead."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(dataset).alias("dataset"), F.lit(i).alias("step"),
            F.lit(layer).alias("layer"), "n_rows")
        for i, (layer, df) in enumerate(layers)]
    return reduce(DataFrame.unionByName, counted)


def layer_reconcile(counts: DataFrame) -> DataFrame:
    """Rows in, kept and dropped from each layer to the next."""
    after = counts.select("dataset", (F.col("step") - 1).alias("step"),
                          F.col("layer").alias("to_layer"), F.col("n_rows").alias("n_kept"))
    return (counts.join(after, ["dataset", "step"])
            .select("dataset", F.col("layer").alias("from_layer"), "to_layer",
                    F.col("n_rows").alias("n_in"), "n_kept",
                    (F.col("n_rows") - F.col("n_kept")).alias("n_dropped")))


def lineage_edges(reconciled: DataFrame, tables: DataFrame) -> DataFrame:
    """Dataset to output-table edges with the counts that flowed over them.

    ``tables`` names the table of each (dataset, layer).
    """
    source = tables.select("dataset", F.col("layer").alias("from_layer"),
                           F.col("table_name").alias("from_table"))
    target = tables.select("dataset", F.col("layer").alias("to_layer"),
                           F.col("table_name").alias("to_table"))
    return (reconciled.join(source, ["dataset", "from_layer"])
            .join(target, ["dataset", "to_layer"])
            .select("dataset", "from_table", "to_table", "n_in", "n_kept"))


def reachable(edges: DataFrame, source: str = "from_table", target: str = "to_table") -> DataFrame:
    """``source, target, hops`` of every table that another one leads to, by the fewest edges.

    Rows where the target is fixed are what it depends on, those of a source what it feeds. Each
    round follows one more edge from the pairs found last; pairs are kept once, so many paths
    between two tables cost no more than one. Repeated edges count once, edges with a null end
    lead nowhere. A cycle is refused: a table cannot be made from itself.
    """
    spark = edges.sparkSession
    one = edges.select(F.col(source).alias("source"), F.col(target).alias("target")).where(
        "source IS NOT NULL AND target IS NOT NULL").distinct()

    def kept(df: DataFrame, hops: int) -> DataFrame:
        path = scratch_path(spark, f"lineage-{hops}")
        df.withColumn("hops", F.lit(hops)).write.parquet(path)
        return spark.read.parquet(path)

    found = last = kept(one, 1)
    steps = found.select(F.col("source").alias("target"), F.col("target").alias("further"))
    hops = 1
    while not last.isEmpty():
        circle = last.where("source = target").first()
        if circle is not None:
            raise ValueError(f"lineage runs in a circle through {circle['source']}")
        hops += 1
        new = last.join(steps, "target").select("source", F.col("further").alias("target")).distinct()
        last = kept(new.join(found, ["source", "target"], "left_anti"), hops)
        found = found.unionByName(last)
    return found


# Significant bits that a sketch keeps of a delay: a quantile is off by 1/256 of itself at most.
SKETCH_BITS = 8


def latency_sketch(df: DataFrame, by: Sequence[str], start: Column, end: Column,
                   bits: int = SKETCH_BITS) -> DataFrame:
    """``by``, ``bucket``, ``n``: delays in microseconds, counted by their leading bits.

    A sketch has some ``2**(bits + 5)`` rows per group at most however many delays it counts, and
    sketches are merged by adding their counts, so each run's is kept and any span of runs is
    asked later. Delays with a null end are not counted; negative ones have buckets of their own.
    """
    delay = fresh("_delay", df)
    micros = df.withColumn(delay, F.timestamp_diff("MICROSECOND", start, end)).where(F.col(delay).isNotNull())
    size = F.abs(delay)
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - bits)
    lower = F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)
    return (micros.withColumn("bucket", F.when(F.col(delay) < 0, -lower).otherwise(lower))
            .groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n")))


def merge_sketches(sketches: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """One sketch of several, by all or by fewer columns than they were made by."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sketches).groupBy(
        *by, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, by: Sequence[str], percentiles: Sequence[float],
                     bits: int = SKETCH_BITS) -> DataFrame:
    """Per group ``n`` and ``p<..>_seconds``: the delay of that rank, to the sketch's bits.

    The rank is the least that holds the share; the middle of its bucket stands for it.
    """
    whole = Window.partitionBy(*by)
    so_far = F.sum("n").over(whole.orderBy("bucket"))
    ranked = sketch.withColumns({"_upto": so_far, "_all": F.sum("n").over(whole)})
    size = F.abs("bucket")
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - bits)
    half = F.when(shift > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) / 2).otherwise(0.0)
    middle = (size + half) / 1e6
    value = F.when(F.col("bucket") < 0, -middle).otherwise(middle)
    return ranked.withColumn("_value", value).groupBy(*by).agg(F.max("_all").alias("n"), *[
        F.min_by("_value", F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(p)), F.col("bucket"))).alias(
            f"p{round(p * 100)}_seconds") for p in percentiles])
