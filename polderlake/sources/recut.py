"""Large single documents cut into lines, by many tasks.

A document such as ``{"value": [{...}, {...}]}`` is one record to a JSON reader, so one task
reads all of it. Here it is read as text that ends at closing braces, which Spark splits by
bytes, and every piece learns its place in the document:

1. Within a split, quotes and brackets are counted twice, as if the split began outside or
   inside a string.
2. The splits' totals, a row for each, say which of the two holds and how deep a split begins.
3. Rows end at the braces that return to the depth of the document; pieces are grouped by row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polderlake.session import scratch_path

PLACE = ["file", "block"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text up to each closing brace, with its file, split and order."""
    return (spark.read.option("lineSep", "}").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.col("_metadata.file_size").alias("size"))
            .withColumn("at", F.monotonically_increasing_id()))


def _outside(value: Column, in_string: int) -> Column:
    """What of a piece (without escapes) lies outside strings."""
    begun = F.concat(F.lit('"'), value) if in_string else value
    return F.regexp_replace(begun, '"[^"]*("|$)', "")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _relative(pieces: DataFrame) -> DataFrame:
    """Running counts within a split, for a split that begins outside (0) or inside (1) a string.

    ``deep`` is the depth after the piece and its brace, ``wide`` the open arrays before it.
    """
    before = Window.partitionBy(*PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*PLACE).orderBy("at")
    # An escaped character is no quote and no bracket; a brace cannot be escaped.
    bare = pieces.withColumn("bare", F.regexp_replace("value", r"(?s)\\.", ""))
    quoted = bare.withColumn("quotes", _count(F.col("bare"), '"'))
    # Whether quotes so far are odd; with the split's own beginning, whether a string is open.
    odd = quoted.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    for h in (0, 1):
        inside = (F.col("odd") + h) % 2 == 1
        text = F.when(inside, _outside(F.col("bare"), 1)).otherwise(_outside(F.col("bare"), 0))
        closes = ((F.col("odd") + F.col("quotes") + h) % 2 == 0).cast("int")
        odd = (odd.withColumn(f"text{h}", text).withColumn(f"closes{h}", closes)
               .withColumn(f"turn{h}", _count(F.col(f"text{h}"), "{") - F.col(f"closes{h}"))
               .withColumn(f"span{h}", _count(F.col(f"text{h}"), "[") - _count(F.col(f"text{h}"), "]")))
    return odd.select(*PLACE, "size", "at", "value", "quotes", *[
        c for h in (0, 1) for c in (f"closes{h}", F.sum(f"turn{h}").over(running).alias(f"deep{h}"),
                                    F.sum(f"span{h}").over(running).alias(f"wide{h}"),
                                    f"turn{h}", f"span{h}")])


def _before(totals: DataFrame, name: str) -> Column:
    window = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(window), F.lit(0))


def _splits(relative: DataFrame) -> DataFrame:
    """One row per split: how it begins, what it adds, and how its last piece looks."""
    totals = relative.groupBy(*PLACE).agg(
        F.sum("quotes").alias("quotes"), F.max("size").alias("size"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max_by(F.col("value").rlike(r"^\s*$"), "at").alias("blank"), *[
            F.sum(f"{c}{h}").alias(f"{c}{h}") for h in (0, 1) for c in ("turn", "span")])
    begun = totals.withColumn("h", _before(totals, "quotes") % 2)
    for c in ("turn", "span"):
        begun = begun.withColumn(c, F.when(F.col("h") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0")))
    return begun


def _check_whole(splits: DataFrame) -> None:
    """Refuse documents that break off. The last piece of a file has a brace behind it unless
    the pieces and their braces are longer than the file."""
    ends = splits.groupBy("file").agg(
        (F.sum("quotes") % 2).alias("odd"), F.sum("turn").alias("deep"),
        (F.sum("bytes") > F.max("size")).alias("open"), F.max_by("blank", "block").alias("blank"))
    broken = ends.where((F.col("odd") == 1) | F.col("open") & ~F.col("blank")
                        | (F.col("deep") + F.col("open").cast("int") != 0)).first()
    if broken is not None:
        raise ValueError(f"document breaks off: {broken['file']}")


def _absolute(relative: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds ``ends``: whether the piece's brace ends a row. Joins one row per split."""
    starts = splits.select(*PLACE, "h", _before(splits, "turn").alias("deep"),
                           _before(splits, "span").alias("wide"))
    placed = relative.join(F.broadcast(starts), PLACE)
    pick = lambda c: F.when(F.col("h") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    return placed.select(*PLACE, "at", "value", (
        (pick("closes") == 1) & (F.col("deep") + pick("deep") == 1)
        & (F.col("wide") + pick("wide") == 1)).alias("ends"))


def recut(spark: SparkSession, path: str, out: str, column: str = "value") -> int:
    """Write the objects of the array ``column`` of each document as JSON lines; their number.

    One document per file, pretty-printed or not. Each line holds one object as it was written,
    so later reads split. The array is the only one of the document with objects in it; a file
    without it, and one that breaks off anywhere, fail. An empty file holds no document.
    """
    staged = scratch_path(spark, "recut-pieces")
    _relative(_pieces(spark, path)).write.parquet(staged)
    relative = spark.read.parquet(staged)
    splits = _splits(relative)
    _check_whole(splits)
    placed = _absolute(relative, splits)
    ended = placed.groupBy(*PLACE).agg(F.sum(F.col("ends").cast("int")).alias("n"))
    starts = ended.select(*PLACE, _before(ended, "n").alias("earlier"))
    before = Window.partitionBy(*PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("row", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)))
    numbered = numbered.join(F.broadcast(starts), PLACE).withColumn("row", F.col("row") + F.col("earlier"))
    # A row's pieces, few, in order; the last one carries the end.
    pieces = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    rows = numbered.groupBy("file", "row").agg(
        F.array_join(F.transform(pieces, lambda p: F.concat(p["value"], F.lit("}"))), "").alias("text"),
        F.max("ends").alias("whole"))
    text = F.col("text")
    opening = f'(?s)^.*?"{re.escape(column)}"\\s*:\\s*\\[\\s*'
    first = F.col("row") == 0
    body = F.when(first, F.regexp_replace(text, opening, "")).otherwise(
        F.regexp_replace(text, r"^[\s,]+", ""))
    line = F.regexp_replace(body, r"[\r\n]+", " ")
    none = F.regexp_replace(text, opening, "") == text
    checked = F.when(first & none, F.raise_error(F.concat(F.lit(f"no array '{column}' in "), F.col("file")))
                     ).when(F.col("whole"), line)
    rows.select(checked.alias("value")).where(F.col("value").isNotNull()).write.text(out)
    return placed.where("ends").count()
