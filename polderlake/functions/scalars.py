"""Scalar column expressions: dates, labels, payload text, exact arithmetic."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType

# Line boundaries of Unicode text, and its non-blank characters as Java regex.
LINE_BREAKS = ("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
NON_BLANK = (r"[^\t\n\x0b\x0c\r\x1c-\x20\x85\xa0"
             r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")



def comparable(df: DataFrame, columns: Iterable[str] | None = None) -> list[Column]:
    """Columns fit for sorting and hashing: those that hold maps as their JSON text."""
    names = df.columns if columns is None else columns
    return [F.to_json(F.struct(F.col(c))) if "map<" in df.schema[c].dataType.simpleString()
            else F.col(c) for c in names]


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no frame has such a column."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sum_parts(column: str, kind: DataType) -> dict[str, Column]:
    """Mergeable parts of a sum that does not depend on the order of the rows.

    Whole numbers and decimals are summed in their own type, as ``s``. A double is taken as the
    decimal that its shortest text shows and cut in words that are summed apart: ``h``, its whole
    part, below 1e24; ``l``, its fraction, from 1e-10 on; ``t``, all of it below that, down to
    1e-20. Each word has room for the sum of 10**12 rows. What lies outside, infinities and NaN
    are summed as doubles, ``r``.
    """
    value = F.col(column)
    if isinstance(kind, (IntegralType, DecimalType)):
        return {"s": F.sum(value)}
    x = value.cast("double")
    size, whole = F.abs(x), x - x % 1
    worded = (size >= 1e-10) & (size < 1e24) | (size == 0)
    tiny = (size >= 1e-20) & (size < 1e-10)
    high = F.when(size < 1e18, whole.cast("bigint").cast("decimal(28,0)")).otherwise(
        x.cast("decimal(28,0)"))
    low = (F.when(size < 1e11, x.cast("decimal(37,26)") - whole.cast("decimal(11,0)"))
           .when(size < 1e18, (x.cast("decimal(28,6)") - whole.cast("decimal(22,0)"))
                 .cast("decimal(28,26)")))
    return {"h": F.sum(F.when(worded, high)),
            "l": F.sum(F.when(worded, low.cast("decimal(28,26)"))),
            "t": F.sum(F.when(tiny, x.cast("decimal(36,36)"))),
            "r": F.sum(F.when(~worded & ~tiny, x))}


def sum_result(parts: Mapping[str, Column]) -> Column:
    """The sum as a double, null when there was no value.

    Whole part and fraction are added as decimals, with as many places as 38 digits allow.
    """
    if "s" in parts:
        return parts["s"].cast("double")
    high = F.coalesce(parts["h"], F.lit(0).cast("decimal(38,0)"))
    low = F.coalesce(parts["l"], F.lit(0).cast("decimal(38,26)"))
    added = lambda h, l: (high.cast(h) + low.cast(l)).cast("double")
    both = (F.when((F.abs(high) < 10**10) & (F.abs(low) < 10**10), added("decimal(11,0)", "decimal(37,26)"))
            .when(F.abs(high) < 10**18, added("decimal(19,0)", "decimal(30,18)"))
            .otherwise(added("decimal(37,0)", "decimal(14,0)")))
    some = F.coalesce(parts["h"].cast("double"), parts["t"].cast("double"), parts["r"])
    return F.when(some.isNotNull(), both + F.coalesce(parts["t"].cast("double"), F.lit(0.0))
                  + F.coalesce(parts["r"], F.lit(0.0)))


def exact_sum(df: DataFrame, column: str) -> Column:
    """Sum of a column as a double, the same whatever the order of the rows."""
    return sum_result(sum_parts(column, df.schema[column].dataType))


def compact_date(column: Column) -> Column:
    return F.date_format(column, "yyyyMMdd")


def iso_date(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def run_key(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd_HH-mm-ss")


def parse_run_key(column: Column) -> Column:
    return F.try_to_timestamp(column, F.lit("yyyy-MM-dd_HH-mm-ss"))


def in_relative_window(ts: Column, anchor: Column, start_days_ago: int = 7,
                       end_days_ago: int = 1) -> Column:
    """True between ``start_days_ago`` and ``end_days_ago`` before the anchor, both inclusive.

    Written as bounds on the timestamp itself, not on its date, so that the
    condition can be pushed to the scan.
    """
    first = F.date_sub(anchor, start_days_ago)
    after_last = F.date_add(F.date_sub(anchor, end_days_ago), 1)
    return (ts >= first.cast("timestamp_ntz")) & (ts < after_last.cast("timestamp_ntz"))


def clean_label(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def map_label(column: Column, mapping: Mapping[str, str], default: str) -> Column:
    """Trimmed lower-case label looked up in ``mapping``; anything else is ``default``."""
    label = clean_label(column)
    result = F.lit(default)
    for key, value in mapping.items():
        result = F.when(label == key, F.lit(value)).otherwise(result)
    return result


def endpoint_file(column: Column) -> Column:
    return F.concat(F.lower(column), F.lit(".json"))


def part_name(page: Column) -> Column:
    return F.format_string("part-%05d.json", page)


def data_lines(text: Column, comment: str = "#") -> Column:
    """Lines that hold something and do not start with the comment mark.

    Rare line ends are first replaced by the usual one: searching for literals
    is several times faster than splitting on a pattern, and the empty line
    that a two-character line end leaves is not counted anyway.
    """
    usual, *rare = LINE_BREAKS
    for mark in rare:
        text = F.replace(text, F.lit(mark), F.lit(usual))
    kept = F.filter(F.split(text, usual), lambda x: x.rlike(NON_BLANK) & ~x.startswith(comment))
    return F.size(kept).cast("bigint")


def raw_bytes(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-8")).cast("bigint")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(NON_BLANK)
