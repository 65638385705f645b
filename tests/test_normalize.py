import pytest
from conftest import collect
from datetime import datetime
from pyspark.sql import functions as F

from polderlake.catalog import STATISTICS, DatasetSpec, load_catalog, schema_of
from polderlake.functions import scalars as fn
from polderlake.operators import normalize, quality


def test_flatten_only_when_the_array_is_there(spark):
    plain = spark.createDataFrame([(1, "a")], "id int, name string")
    assert normalize.flatten_envelope(plain).columns == ["id", "name"]
    nested = plain.select(F.array(F.struct("id", "name"), F.struct("id", "name")).alias("value"))
    assert collect(normalize.flatten_envelope(nested)) == [(1, "a"), (1, "a")]


def test_lineage_is_the_same_on_every_run(spark):
    df = spark.createDataFrame([(1,)], "id int")
    ts = datetime(2024, 2, 1, 6)
    first = normalize.tag_lineage(df, "cbs", "x", "2024-02-01", ts).collect()
    assert first == normalize.tag_lineage(df, "cbs", "x", "2024-02-01", ts).collect()
    assert first[0]["source"] == "cbs" and first[0]["ingestion_date"] == "2024-02-01"


def test_rename_refuses_one_name_for_two_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert normalize.rename_columns(df, {"a": "x", "absent": "y"}).columns == ["x", "b"]
    with pytest.raises(ValueError):
        normalize.rename_columns(df, {"a": "b"})


def test_unparsable_values_become_null_and_codes_are_trimmed(spark):
    df = spark.createDataFrame([(" GM01 ", "12"), ("GM02", ".")], "code string, n string")
    assert collect(normalize.cast_columns(df, {"code": "string", "n": "bigint"})) == [
        ("GM01", 12), ("GM02", None)]


def test_conform_fills_missing_and_drops_extra_columns(spark):
    df = spark.createDataFrame([("1", 9)], "n string, extra int")
    out = normalize.conform(df, schema_of(n="long", m="double"))
    assert out.columns == ["n", "m"] and collect(out) == [(1, None)]


def test_invalid_rows_go_and_undecided_rules_keep(spark):
    df = spark.createDataFrame([("a", 1), ("b", -1), (None, 5), ("c", None)], "k string, v int")
    kept = normalize.drop_invalid(df, ["k"], {"negative": F.col("v") < 0})
    assert collect(kept) == [("a", 1), ("c", None)]


def test_catalogue_refuses_duplicates_and_unknown_columns():
    assert len(load_catalog(STATISTICS)) == 4
    with pytest.raises(ValueError, match="twice"):
        load_catalog([STATISTICS[0], STATISTICS[0]])
    broken = DatasetSpec("s", "n", "t", schema_of(a="string"), columns={"b": "c"})
    with pytest.raises(ValueError, match="missing"):
        load_catalog([broken])
    with pytest.raises(ValueError, match="grain"):
        load_catalog([DatasetSpec("s", "n", "t", schema_of(a="string"), grain=("z",))])


@pytest.mark.parametrize("text", [
    "# head\na\n\n b \n", "a\r\nb\rc", "x\x85y z", "", "   \n\t", "#only", " #kept",
    " \nq", "a\x0bb\x0cc\x1cd", "café\n#x\nthe end"])
def test_payload_profile_matches_text_lines(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(
        fn.data_lines(F.col("t")), fn.raw_bytes(F.col("t")), fn.is_blank(F.col("t")))
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    assert df.first() == (len(lines), len(text.encode()), not text.strip())


def test_empty_payload_is_an_error(spark):
    df = spark.createDataFrame([(" \n",)], "t string")
    with pytest.raises(Exception, match="empty payload"):
        quality.require_payload(df, "t").collect()


def test_labels_and_names(spark):
    df = spark.createDataFrame([(" JSON ", 7), ("Xml", 0), ("tab\t", 123456)], "f string, p int")
    out = df.select(fn.map_label(F.col("f"), {"json": "json", "xml": "xml"}, "csv"),
                    fn.part_name(F.col("p")), fn.endpoint_file(F.col("f")))
    assert [r[0] for r in out.collect()] == ["json", "xml", "csv"]
    assert [r[1] for r in out.collect()] == ["part-00007.json", "part-00000.json", "part-123456.json"]


def test_relative_window_bounds_are_inclusive(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (1, timestamp_ntz'2024-01-12 23:59:59'), (2, timestamp_ntz'2024-01-13 00:00:00'),
      (3, timestamp_ntz'2024-01-19 23:59:59.999999'), (4, timestamp_ntz'2024-01-20 00:00:00') t(i, ts)""")
    inside = df.where(fn.in_relative_window(F.col("ts"), F.lit("2024-01-20").cast("date"), 7, 1))
    assert [r.i for r in inside.collect()] == [2, 3]


def test_run_key_round_trip(spark):
    df = spark.sql("SELECT timestamp'2024-02-01 06:07:08' AS t")
    assert df.select(fn.run_key(F.col("t")), fn.parse_run_key(fn.run_key(F.col("t"))) == F.col("t")
                     ).first() == ("2024-02-01_06-07-08", True)
