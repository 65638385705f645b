"""Exact deduplication with two-pass Bloom filtering.

Pass one fills a counting Bloom filter: each text hashes to one 64-bit block and to two bits in
it, and a cell that was hit by two rows or more marks its bits in the second filter, a plain
blocked Bloom filter. Pass two probes that filter. A row that misses it has no copy and passes
straight through, unshuffled; only rows that hit it are grouped by the SHA-256 of their text.
A false hit costs a row's shuffle and never changes the result.

The first filter is kept sparse, as (block, bits, count) rows, and combines before its shuffle;
no text and no id moves in it. The second has at most ``max_blocks`` blocks, a fixed size, so
it is broadcast; on corpora too large for it more rows hit it and take the grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm.common import (BLANKS, power_of_two, shuffle_partitions, staged,
                                   text_or_empty)

MAX_BLOCKS = 1 << 20  # 8 MB of filter words


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(column), BLANKS, " ")


def _cells(text: Column, blocks: int) -> list[Column]:
    """The block of a text and the mask of its two bits there."""
    h = F.xxhash64(text)
    one = F.lit(1).cast("long")
    first = F.call_function("shiftleft", one, F.shiftrightunsigned(h, 58).cast("int"))
    second = F.call_function(
        "shiftleft", one, F.shiftrightunsigned(h, 52).bitwiseAND(63).cast("int"))
    return [F.pmod(h, F.lit(blocks)).alias("block"), first.bitwiseOR(second).alias("mask")]


def repeat_filter(docs: DataFrame, rows: int, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of possibly repeated texts, ``(block, bits)``, and its number of blocks."""
    blocks = min(max_blocks, power_of_two(rows / 4))
    cells = docs.select(*_cells(normalised(), blocks)).groupBy("block", "mask").count()
    return (cells.where("count > 1").groupBy("block").agg(F.bit_or("mask").alias("bits")), blocks)


def exact_groups(spark: SparkSession, docs: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of blanks became one space; null counts as
    empty, so null and empty texts form one group. Of equal texts the row with the smallest
    ``doc_id`` stays; null ids come last, and of rows with the same id exactly one stays.
    Other columns of ``docs``, whatever their names, are not read. No rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    found, blocks = repeat_filter(docs, docs.count(), max_blocks)
    marks = staged(spark, found, "repeat-filter")
    text = normalised()
    rows = staged(spark, (
        docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), *_cells(text, blocks),
                    F.monotonically_increasing_id().alias("row"))
        .join(F.broadcast(marks), "block", "left")
        .select("doc_id", "text_sha256", "row",
                F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"),
                           F.lit(False)).alias("maybe"))), "hashed-rows")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    straight = rows.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")

    maybe = rows.where("maybe").drop("maybe")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = staged(spark, maybe.groupBy("text_sha256").agg(
        F.min(order).alias("keep"), F.count("*").alias("group_size")), "copy-groups")
    # A group is hot beyond the mean of a shuffle partition, so there are fewer hot groups
    # than partitions: their rows find them by broadcast and never meet in one task.
    mean = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).select(
        F.ceil(F.col("n") / shuffle_partitions(spark)).alias("n"))
    limit = mean.first()["n"]
    hot = F.broadcast(groups.where(F.col("group_size") > limit))
    cold = groups.where(F.col("group_size") <= limit)
    resolved = maybe.join(hot, "text_sha256").unionByName(
        maybe.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(cold, "text_sha256"))
    resolved = resolved.withColumns({"keep_id": F.col("keep.doc_id"),
                                     "kept": F.col("row") == F.col("keep.row")})
    return straight.unionByName(resolved.select(*out))


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is the first of its kind; ids must be unique and set."""
    kept = exact_groups(spark, docs).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")
