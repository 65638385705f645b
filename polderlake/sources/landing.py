"""Landing: raw text formats as files, written by the tasks that hold the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.functions.scalars import comparable, fresh
from polderlake.operators.paging import BYTE_PAGE
from polderlake.session import listing_by_cores


def bundle(df: DataFrame, rows_per_file: int) -> DataFrame:
    """Group rows into documents of at most ``rows_per_file`` rows.

    A document's rows come from one input partition, so the group id is
    (partition, block within it) and no group can outgrow the limit. The
    local sort fixes which row gets which number: a task run again after a
    lost executor deals the same rows to the same documents.
    """
    at = fresh("_id", df)
    numbered = (df.sortWithinPartitions(F.xxhash64(*comparable(df)), *comparable(df))
                .withColumn(at, F.monotonically_increasing_id()))
    return (numbered
            .groupBy(F.shiftright(at, 33).alias("_part"),
                     F.expr(f"({at} & {(1 << 33) - 1}) div {int(rows_per_file)}").alias("_block"))
            .agg(F.collect_list(F.struct(*df.columns)).alias("rows")))


def _write_documents(docs: DataFrame, path: str, compression: str = "none") -> None:
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).option(
        "compression", compression).text(path)


def land_envelopes(df: DataFrame, path: str, rows_per_file: int = 10_000,
                   column: str = "value", pretty: bool = True, compression: str = "none") -> None:
    """``{"value": [...]}`` documents: pretty-printed one per file, or compact one per line.

    ``compression`` is a codec of Spark's text writer; the readers see it by the ending of the
    files. ``recut`` cuts at bytes and needs documents without.
    """
    docs = bundle(df, rows_per_file)
    wrapped = F.struct(F.col("rows").alias(column))
    if pretty:
        _write_documents(docs.select(F.to_json(wrapped, {"pretty": "true"}).alias("value")), path,
                         compression)
    else:
        docs.select(F.to_json(wrapped).alias("value")).write.mode("overwrite").option(
            "compression", compression).text(path)


def land_pages(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Bare JSON arrays, one page per file."""
    docs = bundle(df, rows_per_file)
    _write_documents(docs.select(F.to_json("rows").alias("value")), path)


def land_named_pages(pages: DataFrame, path: str) -> None:
    """Bare JSON arrays, each in a folder of its page's name: ``part_name=part-00010.json``.

    ``pages`` comes from ``assign_pages_by_bytes``, so a page fits a task. Only the pages
    present in it are written, in place of what was under their names: landing the pages of
    ``page_requests`` once more repairs a table and touches no other page.
    """
    own = [c for c in pages.columns if c not in BYTE_PAGE]
    row = F.struct(*own) if own else F.struct(F.lit(None).cast("int").alias("none"))
    texts = pages.groupBy("part_name").agg(F.array_sort(F.collect_list(
        F.struct("row_idx", F.to_json(row).alias("text")))).alias("rows"))
    value = F.concat(F.lit("["), F.array_join("rows.text", ","), F.lit("]")).alias("value")
    (texts.select(value, "part_name").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("part_name").text(path))


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """``part_name, n_files, n_landed, n_bytes`` of the pages under their names.

    The rows are counted without reading their fields. ``n_landed`` is null when a file of the
    page is no JSON array. Spark does not read files without a byte: such a page is not there.
    """
    with listing_by_cores(spark):
        read = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"part_name=([^/]+)", 1)
    text = F.rtrim(F.col("value"), F.lit("\n"))
    held = read.select(name.alias("part_name"), F.octet_length(text).cast("long").alias("bytes"),
                       F.json_array_length(text).cast("long").alias("rows"))
    return held.groupBy("part_name").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.when(F.count("rows") == F.count(F.lit(1)), F.sum("rows")).alias("n_landed"),
        F.sum("bytes").alias("n_bytes"))


def land_geojson(df: DataFrame, path: str, id_column: str, x: str, y: str,
                 rows_per_file: int = 1_000) -> None:
    """FeatureCollections of points, one per file; every column is a property."""
    feature = df.select(
        F.lit("Feature").alias("type"),
        F.col(id_column).cast("string").alias("id"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates")
                 ).alias("geometry"),
        F.struct(*df.columns).alias("properties"))
    docs = bundle(feature, rows_per_file)
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"),
                              F.col("rows").alias("features")), {"pretty": "true"})
    _write_documents(docs.select(text.alias("value")), path)


def land_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def land_commented_csv(df: DataFrame, path: str, every: int = 100) -> None:
    """Padded values with comment and blank lines between the data, no header line.

    Nulls are left empty; values with a comma, quote or edge blank are quoted, not padded.
    Line breaks inside values cannot be written in this form.
    """
    header = "# " + ",".join(df.columns)
    def padded(c: str) -> Column:
        text = F.col(c).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")),
                                               F.lit('"'), F.lit('\\"')), F.lit('"'))
        special = text.rlike(r'[",\r\n\\#]|^\s|\s$|^$')
        value = F.when(special, quoted).otherwise(F.concat(F.lit("  "), text, F.lit(" ")))
        return F.coalesce(value, F.lit(""))

    line = F.concat_ws(",", *[padded(c) for c in df.columns])
    first_of_block = F.pmod(F.monotonically_increasing_id(), F.lit(every)) == 0
    lines = F.when(first_of_block, F.array(F.lit(header), F.lit(""), line)).otherwise(F.array(line))
    df.select(F.explode(lines).alias("value")).write.mode("overwrite").text(path)


def land_xml(df: DataFrame, path: str, row_tag: str, root_tag: str = "rows") -> None:
    (df.write.format("xml").mode("overwrite")
     .option("rowTag", row_tag).option("rootTag", root_tag).save(path))
