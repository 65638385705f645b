"""Tables whose column types grow: a log of schema versions, files kept by version, casts on read.

``versions/<v>`` holds one row, the schema of version ``v``; ``data/version=<v>/load=<name>`` the
rows of a load, typed as that version. A load that fits the last schema joins its version; one
that brings new columns or wider types starts the next. No file is rewritten: older ones are cast
when read, and each cast keeps every value exactly. What no type of the lattice holds exactly,
such as long beside double, is refused before anything is written.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, ByteType, DataType, DateType, DecimalType, DoubleType,
                               FloatType, IntegerType, LongType, MapType, NullType, ShortType,
                               StructField, StructType, TimestampNTZType)

from polderlake.sources.tables import clear_partitions

VERSION = "version int, schema string"

#: Whole numbers from narrow to wide, each with the decimal digits of its largest value.
WHOLE = {ByteType(): 3, ShortType(): 5, IntegerType(): 10, LongType(): 19}
#: Widest whole number that a floating type holds exactly.
EXACT_IN = {FloatType(): ShortType(), DoubleType(): IntegerType()}


def _decimal(kind: DataType) -> DecimalType | None:
    return kind if isinstance(kind, DecimalType) else (
        DecimalType(WHOLE[kind], 0) if kind in WHOLE else None)


def widest(a: DataType, b: DataType) -> DataType | None:
    """The narrowest type that holds every value of both exactly; None where there is none."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(a, StructType) and isinstance(b, StructType):
        fields, clashes = _merged(a, b)
        return None if clashes else fields
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        item = widest(a.elementType, b.elementType)
        return item and ArrayType(item)
    if isinstance(a, MapType) and isinstance(b, MapType):
        value = widest(a.valueType, b.valueType)
        return value and a.keyType == b.keyType and MapType(a.keyType, value) or None
    whole = list(WHOLE)
    if a in WHOLE and b in WHOLE:
        return max(a, b, key=whole.index)
    for x, y in ((a, b), (b, a)):
        if x in EXACT_IN and y in WHOLE:
            fitting = [f for f, most in EXACT_IN.items()
                       if whole.index(y) <= whole.index(most) and (f == x or x == FloatType())]
            return fitting[0] if fitting else None
        if x == DoubleType() and y == FloatType():
            return x
        if x == TimestampNTZType() and y == DateType():
            return x
    x, y = _decimal(a), _decimal(b)
    if x is None or y is None:
        return None
    scale = max(x.scale, y.scale)
    digits = max(x.precision - x.scale, y.precision - y.scale) + scale
    return DecimalType(digits, scale) if digits <= 38 else None


def _merged(old: StructType, new: StructType) -> tuple[StructType, list[str]]:
    """Fields of both, the old first and in the old spelling, and those that no type holds."""
    come = {f.name.lower(): f for f in new.fields}
    if len(come) < len(new.fields) or len({f.name.lower() for f in old.fields}) < len(old.fields):
        raise ValueError(f"column names repeat: {new.fieldNames()}")
    fields, clashes = [], []
    for f in old.fields:
        other = come.pop(f.name.lower(), None)
        kind = widest(f.dataType, other.dataType) if other else f.dataType
        if kind is None:
            clashes.append(f"{f.name}: {other.dataType.simpleString()} beside "
                           f"{f.dataType.simpleString()}")
        fields.append(StructField(f.name, kind or f.dataType))
    fields += [StructField(f.name, f.dataType) for f in new.fields if f.name.lower() in come]
    return StructType(fields), clashes


def merged_schema(old: StructType, new: StructType) -> StructType:
    """The schema that holds rows of both; all columns that cannot be widened are named."""
    schema, clashes = _merged(old, new)
    if clashes:
        raise ValueError("no type holds both exactly: " + ", ".join(clashes))
    return schema


def _as(value: Column, have: DataType, want: DataType) -> Column:
    """The value in the wider type; structs by field name, a field they lack is null."""
    if have == want:
        return value
    if isinstance(want, StructType) and isinstance(have, StructType):
        held = {f.name.lower(): f for f in have.fields}
        fields = [(_as(value[held[f.name.lower()].name], held[f.name.lower()].dataType, f.dataType)
                   if f.name.lower() in held else F.lit(None).cast(f.dataType)).alias(f.name)
                  for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, ArrayType) and isinstance(have, ArrayType):
        return F.transform(value, lambda x: _as(x, have.elementType, want.elementType))
    if isinstance(want, MapType) and isinstance(have, MapType):
        return F.transform_values(value, lambda _, x: _as(x, have.valueType, want.valueType))
    return value.cast(want)


def typed_as(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` in the columns and types of a schema that ``merged_schema`` made of its own."""
    held = {f.name.lower(): f for f in df.schema.fields}
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    return df.select(*[
        (_as(quoted(held[f.name.lower()].name), held[f.name.lower()].dataType, f.dataType)
         if f.name.lower() in held else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _fs(spark, path)
    return fs.exists(folder)


def versions(spark: SparkSession, path: str) -> list[StructType]:
    """Schemas of the table, oldest first; a version counts once its log entry is complete."""
    out: list[StructType] = []
    while _exists(spark, f"{path}/versions/{len(out):06d}/_SUCCESS"):
        row = spark.read.schema(VERSION).parquet(f"{path}/versions/{len(out):06d}").first()
        out.append(StructType.fromJson(json.loads(row["schema"])))
    return out


def _plain(schema: StructType) -> StructType:
    """Without column notes and with every column nullable; columns without a type are refused."""
    untyped = [f.name for f in schema.fields if "void" in f.dataType.simpleString()]
    if untyped:
        raise ValueError(f"columns without a type in a new table: {untyped}")
    return StructType([StructField(f.name, f.dataType) for f in schema.fields])


def append_versioned(df: DataFrame, path: str, load: str) -> int:
    """Write a load, replacing an earlier one of the same name; returns its schema version.

    The log entry of a new version comes before its rows, so rows are never there without a
    schema; a version whose load failed has no rows. Two writers that widen a table at once
    collide on the log entry, and the second fails before it writes rows. A load without rows
    still brings its columns.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", load):
        raise ValueError(f"a load name of letters, digits, '_', '.' and '-' is needed: {load!r}")
    spark = df.sparkSession
    known = versions(spark, path)
    schema = merged_schema(known[-1], df.schema) if known else _plain(df.schema)
    at = len(known) - 1
    if not known or _shape(schema) != _shape(known[-1]):
        at += 1
        schema = _plain(schema)
        (spark.range(0, 1, 1, 1).select(F.lit(at).alias("version"), F.lit(schema.json()).alias("schema"))
         .write.mode("errorifexists").parquet(f"{path}/versions/{at:06d}"))
    typed_as(df, schema).write.mode("overwrite").parquet(f"{path}/data/version={at}/load={load}")
    for older in range(at):  # where the same load was written before the table was widened
        clear_partitions(spark, f"{path}/data/version={older}", [load], "load")
    return at


def _shape(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def read_versioned(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All loads as one table in the types of the last version, or of an earlier one.

    An earlier version shows the loads written up to it. One scan for each version that has
    rows; comparisons with a constant pass below the casts of whole numbers to the scan.
    """
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no table with a schema history at {path}")
    last = len(known) - 1 if version is None else version
    if not 0 <= last < len(known):
        raise ValueError(f"the table has versions 0 to {len(known) - 1}")
    parts = [typed_as(spark.read.schema(known[v]).option("recursiveFileLookup", True)
                      .parquet(f"{path}/data/version={v}"), known[last])
             for v in range(last + 1) if _exists(spark, f"{path}/data/version={v}")]
    if not parts:
        return spark.createDataFrame([], known[last])
    return reduce(DataFrame.unionAll, parts)


def schema_history(spark: SparkSession, path: str) -> DataFrame:
    """``version, column_name, type, change``: what each version added or widened."""
    rows, before = [], {}
    for v, schema in enumerate(versions(spark, path)):
        for name, kind in _shape(schema):
            if before.get(name) != kind:
                rows.append((v, name, kind, "widened" if name in before else "added"))
            before[name] = kind
    return spark.createDataFrame(rows, "version int, column_name string, type string, change string")
