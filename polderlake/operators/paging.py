"""Pages of fixed rows or bytes over a total order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polderlake.catalog import PAGE_SIZE
from polderlake.functions.scalars import comparable, fresh, part_name
from polderlake.session import scratch_root


def _ranges(df: DataFrame, order_by: str | Sequence[str],
            partitions: int | None) -> tuple[DataFrame, str, str, str]:
    """Rows in order over ranges, and the names of three new columns: id, range and place in it."""
    scratch_root(df.sparkSession)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    row, origin, at, span, place = (
        fresh(n, df) for n in ("_row", "_from", "_id", "_range", "_place"))
    keyed = df.withColumns({row: F.xxhash64(*comparable(df)), origin: F.spark_partition_id()})
    ranking = [*[F.col(c).asc_nulls_last() for c in order], F.col(row).asc(), F.col(origin).asc()]
    ranged = (keyed.repartitionByRange(partitions, *ranking) if partitions
              else keyed.repartitionByRange(*ranking))
    fixed = ranged.sortWithinPartitions(*ranking).drop(row, origin).checkpoint()
    return fixed.withColumn(at, F.monotonically_increasing_id()).withColumns({
        span: F.shiftright(at, 33), place: F.col(at).bitwiseAND((1 << 33) - 1)}), at, span, place


def assign_pages(df: DataFrame, order_by: str | Sequence[str], page_size: int = PAGE_SIZE,
                 partitions: int | None = None) -> DataFrame:
    """Add ``row_idx``, ``page_idx``, ``skip`` and ``part_name`` in ``order_by`` order.

    Rows are range-partitioned and sorted, the sorted frame is checkpointed so
    that both passes see the same ranges, and each row's number is its place in
    its range plus the rows of the ranges before. Ties are ordered by a hash of
    the row, full copies by where they came from, so a key or a row repeated
    very often still spreads over ranges. Columns that already have one of the
    four names are replaced; all others stay.
    """
    numbered, at, span, place = _ranges(df, order_by, partitions)
    before, rows = fresh("_before", numbered), fresh("_n", numbered)
    # One row per range: the frame and the window below hold as many rows as there are ranges.
    sizes = numbered.groupBy(span).agg(F.count(F.lit(1)).alias(rows))
    earlier = Window.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(span, F.coalesce(F.sum(rows).over(earlier), F.lit(0)).alias(before))
    return (numbered.join(F.broadcast(offsets), span)
            .withColumn("row_idx", F.col(before) + F.col(place))
            .withColumn("page_idx", F.expr(f"row_idx div {int(page_size)}"))
            .withColumn("skip", F.col("page_idx") * page_size)
            .withColumn("part_name", part_name(F.col("page_idx")))
            .drop(at, span, place, before))


def page_manifest(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Rows per page and whether the page ends the table.

    A page that is not full is the last one by the paging protocol; so is the
    highest page. More than one ``is_last`` row therefore means a broken download.
    """
    counts = pages.groupBy("page_idx").agg(F.count(F.lit(1)).alias("n"))
    highest = counts.agg(F.max("page_idx")).scalar()
    return counts.select(
        "page_idx",
        part_name(F.col("page_idx")).alias("part_name"),
        (F.col("page_idx") * page_size).alias("skip"),
        "n",
        ((F.col("n") < page_size) | (F.col("page_idx") == highest)).alias("is_last"))


def page_gaps(manifest: DataFrame) -> DataFrame:
    """Every gap in the numbering from page 0 on: ``page_idx``, ``last_page`` and ``n_missing``.

    The page before a gap is one whose successor is missing. Each page looks
    back at the one before it within its block of a million numbers; what a
    block holds first looks at the end of the blocks before, of which there are few.
    """
    have = manifest.select("page_idx").distinct().withColumn("_block", F.expr("page_idx div 1000000"))
    ends = have.groupBy("_block").agg(F.max("page_idx").alias("_end"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_block", F.max("_end").over(earlier).alias("_end"))
    inside = Window.partitionBy("_block").orderBy("page_idx")
    before = F.coalesce(F.lag("page_idx").over(inside), F.col("_end"), F.lit(-1))
    return (have.join(ends, "_block").withColumn("_before", before)
            .where(F.col("page_idx") - F.col("_before") > 1)
            .select((F.col("_before") + 1).alias("_first"), (F.col("page_idx") - 1).alias("last_page"),
                    (F.col("page_idx") - F.col("_before") - 1).alias("n_missing"))
            .withColumnRenamed("_first", "page_idx"))


#: What ``assign_pages_by_bytes`` adds to a row.
BYTE_PAGE = ("row_idx", "page_idx", "part_name", "row_bytes")


def assign_pages_by_bytes(df: DataFrame, order_by: str | Sequence[str], page_bytes: int,
                          partitions: int | None = None) -> DataFrame:
    """Add ``row_idx``, ``page_idx``, ``part_name`` and ``row_bytes``: pages of bounded bytes.

    ``row_bytes`` is what the row takes in a page: its JSON text and the mark after it. Prefix
    sums of them decide the cuts: a row belongs to the page in which it starts. So all rows of a
    page but its last take fewer than ``page_bytes``. A row above the budget is the last one
    of its page and counts as one whole budget, so no page number is left out. Sums run within
    ranges, each offset by the bytes of the ranges before. Order, ties, copies and columns that
    already have one of the four names are as in ``assign_pages``.
    """
    if page_bytes < 1:
        raise ValueError(f"a page needs room for a byte: {page_bytes}")
    own = [c for c in df.columns if c.lower() not in BYTE_PAGE]
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    kept = [fresh(f"_order{i}", df) for i in range(len(order))]
    keyed = df.withColumns({k: F.col(c) for k, c in zip(kept, order)})
    numbered, at, span, place = _ranges(
        keyed.withColumn("row_bytes", row_bytes(df, own)).select(*own, *kept, "row_bytes"), kept, partitions)
    before, rows, start = (fresh(n, numbered) for n in ("_before", "_n", "_start"))
    weight = F.least("row_bytes", F.lit(page_bytes).cast("long"))
    earlier = Window.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy(span).agg(F.sum(weight).alias(before), F.count(F.lit(1)).alias(rows))
    offsets = sizes.select(span, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c)
                                   for c in (before, rows)])
    inside = Window.partitionBy(span).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn(start, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (placed.join(F.broadcast(offsets), span)
            .withColumns({"row_idx": F.col(rows) + F.col(place),
                          start: F.col(before) + F.col(start)})
            .withColumn("page_idx", F.expr(f"{start} div {int(page_bytes)}"))
            .withColumn("part_name", part_name(F.col("page_idx")))
            .select(*own, *BYTE_PAGE))


def row_bytes(df: DataFrame, columns: Sequence[str]) -> Column:
    """Bytes of a row in a page: its JSON text and the comma or bracket after it."""
    row = F.struct(*columns) if columns else F.struct(F.lit(None).cast("int").alias("none"))
    return (F.octet_length(F.to_json(row)) + 1).cast("long")


def byte_manifest(pages: DataFrame) -> DataFrame:
    """``page_idx, part_name, skip, n, n_bytes, is_last``: first row, rows and bytes of each page."""
    counts = pages.groupBy("page_idx").agg(
        F.min("row_idx").alias("skip"), F.count(F.lit(1)).alias("n"),
        (F.sum("row_bytes") + 1).alias("n_bytes"))
    return counts.select("page_idx", part_name(F.col("page_idx")).alias("part_name"), "skip", "n", "n_bytes",
                         (F.col("page_idx") == counts.agg(F.max("page_idx")).scalar()).alias("is_last"))


def page_requests(manifest: DataFrame, landed: DataFrame) -> DataFrame:
    """Pages to ask for again, with the reason, and landed pages that the manifest does not know.

    ``part_name, page_idx, skip, n, n_landed, reason``; no row of a damaged page counts as landed. ``landed`` is what
    ``sources.landing.landed_pages`` found. A page is ``missing`` without a file, ``repeated``
    with several, ``damaged`` if it is no JSON array, ``short`` or ``long`` by its rows, and
    ``altered`` if only its bytes differ. ``unknown`` pages have no number and nothing to ask for.
    """
    both = manifest.join(landed.withColumnRenamed("n_bytes", "_landed_bytes"), "part_name", "full_outer")
    reason = (F.when(F.col("page_idx").isNull(), "unknown")
              .when(F.col("n_files").isNull(), "missing")
              .when(F.col("n_files") > 1, "repeated")
              .when(F.col("n_landed").isNull(), "damaged")
              .when(F.col("n_landed") < F.col("n"), "short")
              .when(F.col("n_landed") > F.col("n"), "long")
              .when(F.col("_landed_bytes") != F.col("n_bytes"), "altered"))
    return both.select("part_name", "page_idx", "skip", "n",
                       F.coalesce("n_landed", F.lit(0)).alias("n_landed"), reason.alias("reason")).where("reason IS NOT NULL")
