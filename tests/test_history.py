import decimal
import itertools

import pytest
from conftest import collect
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType,
                               LongType, NullType, ShortType, StringType, TimestampNTZType)

from polderlake.sources import history

KINDS = [ByteType(), ShortType(), IntegerType(), LongType(), FloatType(), DoubleType(),
         DecimalType(5, 2), DecimalType(20, 0), DecimalType(38, 30), DateType(), TimestampNTZType(),
         StringType(), NullType()]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(KINDS), st.sampled_from(KINDS))
def test_widening_has_no_direction(a, b):
    assert history.widest(a, b) == history.widest(b, a)
    both = history.widest(a, b)
    assert both is None or history.widest(a, both) == history.widest(b, both) == both


def test_widening_is_exact_or_refused():
    w = history.widest
    assert w(IntegerType(), LongType()) == LongType()
    assert w(LongType(), DecimalType(15, 2)) == DecimalType(21, 2)
    assert w(ShortType(), FloatType()) == FloatType()
    assert w(IntegerType(), FloatType()) == DoubleType()
    for a, b in [(LongType(), DoubleType()), (DecimalType(5, 2), DoubleType()), (LongType(), FloatType()),
                 (DecimalType(38, 30), LongType()), (StringType(), IntegerType()), (DateType(), LongType())]:
        assert w(a, b) is None


def test_loads_of_growing_types_read_as_one_table(spark, tmp_path):
    path = str(tmp_path / "t")
    big = 2**63 - 1
    loads = [("k int, v int", [(1, 2**31 - 1), (None, None)]), ("k int, v long", [(2, big), (2, big)]),
             ("K long, v decimal(15,2)", [(big, decimal.Decimal("0.01"))]),
             ("v int, extra string", [(7, "x")])]
    assert [history.append_versioned(spark.createDataFrame(rows, s), path, f"l{i}")
            for i, (s, rows) in enumerate(loads)] == [0, 1, 2, 3]
    table = history.read_versioned(spark, path)
    assert table.schema.simpleString() == "struct<k:bigint,v:decimal(21,2),extra:string>"
    d = decimal.Decimal
    assert collect(table) == sorted([
        (1, d("2147483647.00"), None), (None, None, None), (2, d(f"{big}.00"), None),
        (2, d(f"{big}.00"), None), (big, d("0.01"), None), (None, d("7.00"), "x")], key=repr)
    assert collect(history.read_versioned(spark, path, 0)) == sorted([(1, 2**31 - 1), (None, None)], key=repr)
    assert history.read_versioned(spark, path, 1).count() == 4
    assert collect(history.schema_history(spark, path).where("change = 'widened'")) == [
        (1, "v", "bigint", "widened"), (2, "k", "bigint", "widened"), (2, "v", "decimal(21,2)", "widened")]
    plan = table.where("k = 5")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(k") == 4  # in the scan of every version


def test_a_load_repeated_counts_once_even_after_widening(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.range(3).select(F.col("id").cast("int").alias("a")), spark.range(5).toDF("a")
    for _ in range(2):
        assert history.append_versioned(one, path, "monday") == 0
    assert history.append_versioned(two, path, "tuesday") == 1
    assert history.append_versioned(one, path, "monday") == 1
    assert collect(history.read_versioned(spark, path)) == [(i,) for i in (0, 0, 1, 1, 2, 2, 3, 4)]


def test_nested_fields_grow_and_stay_null_where_they_lack(spark, tmp_path):
    path = str(tmp_path / "t")
    history.append_versioned(spark.sql("SELECT named_struct('a', 1) AS s, array(1) AS l, map('m', 1) AS m"), path, "a")
    history.append_versioned(spark.sql(
        "SELECT named_struct('b', 'x', 'A', 2L) AS s, array(2L, null) AS l, map('m', 2L) AS m"), path, "b")
    history.append_versioned(spark.sql("SELECT CAST(null AS struct<a:int>) AS s, null AS l"), path, "c")
    rows = history.read_versioned(spark, path)
    assert rows.schema["s"].dataType.simpleString() == "struct<a:bigint,b:string>"
    assert collect(rows.select("s.a", "s.b", "l", "m")) == sorted([
        (1, None, [1], {"m": 1}), (2, "x", [2, None], {"m": 2}), (None, None, None, None)], key=repr)
    assert rows.where("s IS NULL").count() == 1


def test_what_does_not_fit_is_refused_and_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    history.append_versioned(spark.sql("SELECT 1L AS a, 'x' AS b"), path, "one")
    with pytest.raises(ValueError, match="a: double beside bigint, b: int beside string"):
        history.append_versioned(spark.sql("SELECT 1.5D AS a, 1 AS b"), path, "two")
    assert len(history.versions(spark, path)) == 1
    with pytest.raises(ValueError, match="without a type"):
        history.append_versioned(spark.sql("SELECT null AS a"), str(tmp_path / "u"), "one")
    with pytest.raises(ValueError, match="load name"):
        history.append_versioned(spark.range(1), path, "../x")
    with pytest.raises(FileNotFoundError):
        history.read_versioned(spark, str(tmp_path / "none"))


def test_empty_loads_bring_their_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    history.append_versioned(spark.range(0).toDF("a"), path, "none")
    history.append_versioned(spark.sql("SELECT 'y' AS `odd name.x`").limit(0), path, "odd")
    rows = history.read_versioned(spark, path)
    assert rows.columns == ["a", "odd name.x"] and rows.collect() == []


def test_a_version_without_complete_log_entry_is_not_there(spark, tmp_path):
    path = str(tmp_path / "t")
    history.append_versioned(spark.range(2).toDF("a"), path, "x")
    (tmp_path / "t" / "versions" / "000001").mkdir()
    assert len(history.versions(spark, path)) == 1
    assert history.read_versioned(spark, path).count() == 2
