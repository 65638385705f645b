"""Readers: one DataFrame per landed format.

Every reader takes an explicit schema; without one Spark infers it, at the
price of a pass over the files.

Damaged documents are not lost in silence: readers fail on them, unless asked
to skip them, and ``damaged_documents`` lists them with the reason. A single
value that does not parse is null, as in the silver job's own casts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType, StructField, StructType

from polderlake.functions.scalars import fresh
from polderlake.operators.normalize import flatten_envelope
from polderlake.session import listing_by_cores


def _as_schema(schema: StructType | str | None) -> StructType | None:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


CORRUPT = "_corrupt_record"


def _or_fail(value: Column, good: Column, reason: str) -> Column:
    """The value, or a failed read where it is not good.

    The check is part of the value and not a filter of its own: later filters,
    such as one on nulls, would be tried first and take the damaged rows away.
    """
    return F.when(good, value).otherwise(F.raise_error(F.lit(reason)))


def _json(spark: SparkSession, schema: StructType | None, multi_line: bool):
    reader = spark.read.option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT)
    return reader if schema is None else reader.schema(
        StructType([*schema.fields, StructField(CORRUPT, StringType())]))


def _broken_row(df: DataFrame) -> Column:
    """True for the row that stands for text that is no JSON: nothing but that text is set."""
    if CORRUPT not in df.columns:
        return F.lit(False)
    unset = [F.col(f"`{c}`").isNull() for c in df.columns if c != CORRUPT]
    return F.col(CORRUPT).isNotNull() & reduce(lambda a, b: a & b, unset, F.lit(True))


def damaged_documents(spark: SparkSession, path: str, schema: StructType | str,
                      column: str | None = "value", multi_line: bool = True) -> DataFrame:
    """``path, reason, text`` of the documents that ``read_envelope``, or with ``column=None``
    ``read_pages``, would skip; a file without a byte counts as one."""
    row = _as_schema(schema)
    shape = row if column is None else StructType([StructField(column, ArrayType(row))])
    docs = _json(spark, shape, multi_line).json(path)
    bad = _broken_row(docs) if column is None else F.col(column).isNull()
    reason = F.when(F.col(CORRUPT).isNotNull(), "not JSON").otherwise(F.lit(f"no {column}"))
    found = docs.select(F.col("_metadata.file_path").alias("path"), bad.alias("_bad"),
                        reason.alias("reason"), F.col(CORRUPT).alias("text")).where("_bad").drop("_bad")
    return found.unionByName(empty_files(spark, path).select(
        "path", F.lit("empty").alias("reason"), F.lit("").alias("text")))


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the files without a byte, which Spark does not read, by listing the folder."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for status in fs.globStatus(hadoop) or []:
        for f in fs.listStatus(status.getPath()):
            if f.isFile() and f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
                rows.append((f.getPath().toString(),))
    return spark.createDataFrame(rows, "path string")


def read_envelope(spark: SparkSession, path: str, schema: StructType | str | None = None,
                  column: str = "value", multi_line: bool = True,
                  skip_damaged: bool = False) -> DataFrame:
    """Rows of ``{"value": [...]}`` documents.

    By default a file is one document, pretty-printed or not, and the unit of
    parallel work: land a large response as many pages, never as a single
    document. ``multi_line=False`` reads one compact document per line; such
    files may hold any number of documents and are split.
    A document that is cut off or has no ``column`` fails the read; only when
    the schema is inferred and no document has it, are the documents the rows.
    """
    row = _as_schema(schema)
    shape = None if row is None else StructType([StructField(column, ArrayType(row))])
    docs = _json(spark, shape, multi_line).json(path)
    if column not in docs.columns:
        return flatten_envelope(docs.drop(CORRUPT), column)
    value = F.col(column)
    if not skip_damaged:
        value = _or_fail(value, value.isNotNull(), f"document without '{column}'")
    return flatten_envelope(docs.select(value.alias(column)), column)


def read_pages(spark: SparkSession, path: str, schema: StructType | str | None = None,
               multi_line: bool = False, skip_damaged: bool = False) -> DataFrame:
    """Rows of page parts that hold a bare JSON array on one line each.

    ``multi_line`` is for pretty-printed arrays, such as dimension files; a
    file is then read by one task. A page that is no JSON, such as one that
    was cut off, fails the read.
    """
    with listing_by_cores(spark):
        rows = _json(spark, _as_schema(schema), multi_line).json(path)
    good = ~_broken_row(rows)
    names = [c for c in rows.columns if c != CORRUPT]
    if skip_damaged:
        return rows.where(good).select(names)
    whole = _or_fail(F.struct(names), good, "page that is not JSON")
    return rows.select(whole.alias("_row")).select("_row.*")


def read_json_files(spark: SparkSession, path: str,
                    schema: StructType | str | None = None) -> DataFrame:
    """JSON lines by directory or glob."""
    return read_pages(spark, path, schema)


def parse_json(df: DataFrame, column: str, schema: StructType | str,
               prefix: str = "") -> DataFrame:
    """Add the fields of a JSON text column; unparsable text gives nulls."""
    row = _as_schema(schema)
    mark = fresh("_parsed", df)
    parsed = df.withColumn(mark, F.from_json(F.col(column), row))
    fields = {f"{prefix}{f.name}": F.col(f"{mark}.`{f.name}`") for f in row.fields}
    return parsed.withColumns(fields).drop(mark)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             mode: str = "FAILFAST") -> DataFrame:
    """Headered CSV; types are inferred only when no schema is given. Malformed lines fail."""
    reader = spark.read.option("header", True)
    reader = reader.schema(_as_schema(schema)) if schema else reader.option("inferSchema", True)
    return reader.option("mode", mode).csv(path)


def read_commented_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
                       comment: str = "#", header: bool = False,
                       mode: str = "FAILFAST", infer: bool = True) -> DataFrame:
    """CSV whose comment lines and blank lines are no data and whose values are padded.

    A value is null when nothing stands between its commas; malformed lines fail.
    With ``infer=False`` and no schema all columns are text.
    """
    reader = (spark.read
              .option("comment", comment)
              .option("header", header)
              .option("ignoreLeadingWhiteSpace", True)
              .option("ignoreTrailingWhiteSpace", True))
    reader = reader.schema(_as_schema(schema)) if schema else reader.option("inferSchema", infer)
    return reader.option("mode", mode).csv(path)


def read_geojson(spark: SparkSession, path: str, properties: StructType | str,
                 coordinates: DataType | None = None) -> DataFrame:
    """One row per feature: id, geometry type and coordinates, then the properties.

    A document without ``features`` fails the read.
    """
    props = _as_schema(properties)
    coords = coordinates if coordinates is not None else ArrayType(DoubleType())
    feature = StructType([
        StructField("id", StringType()),
        StructField("geometry", StructType([
            StructField("type", StringType()), StructField("coordinates", coords)])),
        StructField("properties", props),
    ])
    docs = (spark.read.option("multiLine", True)
            .schema(StructType([StructField("features", ArrayType(feature))]))
            .json(path))
    return _features(docs).select(
        F.col("id").alias("feature_id"),
        F.col("geometry.type").alias("geometry_type"),
        F.col("geometry.coordinates").alias("coordinates"),
        *[F.col(f"properties.`{f.name}`").alias(f.name) for f in props.fields])


def read_feature_maps(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON of any properties: id, geometry type, geometry as JSON, properties as a map of text.

    The columns do not depend on the data, so loads of different dates always fit together.
    """
    docs = spark.read.option("multiLine", True).schema(
        "features array<struct<id: string, geometry: struct<type: string, coordinates: string>, "
        "properties: map<string, string>>>").json(path)
    return _features(docs).select(
        F.col("id").alias("feature_id"), F.col("geometry.type").alias("geometry_type"),
        F.col("geometry.coordinates").alias("coordinates"), "properties")


def comment_names(spark: SparkSession, path: str, comment: str = "#") -> list[str] | None:
    """Column names from the comment line that lists them, None where no comment has a comma."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(
        F.startswith("line", F.lit(comment)) & F.contains("line", F.lit(",")))
    first = lines.limit(1).collect()
    return [n.strip() for n in first[0]["line"].lstrip(comment).split(",")] if first else None


def _features(docs: DataFrame) -> DataFrame:
    checked: Column = F.when(
        F.col("features").isNull(),
        F.raise_error(F.lit("GeoJSON document without 'features'"))
    ).otherwise(F.col("features"))
    return docs.select(F.explode(checked).alias("f")).select("f.*")


def read_xml(spark: SparkSession, path: str, row_tag: str,
             schema: StructType | str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """One row per element of that tag; malformed elements fail the read."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", mode)
    row = _as_schema(schema)
    if row is not None:
        reader = reader.schema(row)
    return reader.load(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Raw text files, one row per file, also an empty one: ``path`` and ``text``."""
    read = (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    return read.unionByName(empty_files(spark, path).withColumn("text", F.lit("")))


def read_parquet(spark: SparkSession, path: str,
                 schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(_as_schema(schema)) if schema else spark.read).parquet(path)


def read_silver(spark: SparkSession, path: str,
                schema: StructType | str | None = None) -> DataFrame:
    """A silver table whose batches may differ in columns.

    With a schema no footer is read ahead of the query and missing columns
    are null. Without one Spark merges the footers of all files, which is a
    job over every file: give the contract's schema on large tables.
    """
    if schema is not None:
        return spark.read.schema(_as_schema(schema)).parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def read_partition(spark: SparkSession, path: str, value: object,
                   partition_by: str = "ingestion_date",
                   schema: StructType | str | None = None) -> DataFrame:
    """One partition of a Hive-style table, pruned to its directory, column kept.

    Date-like directory names are inferred as dates; the tag is a string, so
    it is turned back into one after the pruning filter.
    """
    df = read_silver(spark, path, schema)
    pruned = df.where(F.col(partition_by) == F.lit(value))
    if isinstance(value, str):
        pruned = pruned.withColumn(partition_by, F.lit(value))
    return pruned
