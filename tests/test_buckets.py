import os

import pytest
from conftest import collect

from polderlake.operators.incremental import upsert
from polderlake.sources import buckets


def frame(spark, rows, schema="k double, g string, v long"):
    return spark.createDataFrame(rows, schema)


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture()
def base(spark):
    return frame(spark, [(float(i), "ab"[i % 2], i) for i in range(500)]
                 + [(None, None, 1), (0.0, None, 2), (float("nan"), "a", 3)])


def test_upserts_equal_those_of_a_plain_table(spark, tmp_path, base):
    path, plain = str(tmp_path / "t"), base
    buckets.create_bucketed(base, path, ["k", "g"], 16)
    for step in range(3):
        delta = frame(spark, [(float(i), "ab"[i % 2], -i - step) for i in range(step, 900, 97)]
                      + [(None, None, 7 + step), (None, None, 5), (-0.0, None, 8), (float("nan"), "a", step)])
        buckets.upsert_bucketed(spark, path, delta, ["v"])
        plain = upsert(plain, delta, ["k", "g"], ["v"])
        assert repr(collect(buckets.read_bucketed(spark, path))) == repr(collect(plain))
    assert buckets.generations(spark, path) == [0, 1, 2, 3]


def test_a_small_delta_rewrites_only_its_buckets(spark, tmp_path, base):
    path = str(tmp_path / "t")
    buckets.create_bucketed(base, path, ["k", "g"], 100)
    before = files(path + "/data")
    report = buckets.upsert_bucketed(spark, path, frame(spark, [(7.0, "b", 0)]))
    assert report == {"buckets": 100, "touched": 1, "generation": 1}
    new = files(path + "/data") - before
    assert before <= files(path + "/data") and len({os.path.dirname(f) for f in new}) == 1
    assert collect(buckets.read_keys(spark, path, frame(spark, [(7.0, "b", 9), (8.5, "a", 9)]))) == [(7.0, "b", 0)]
    assert buckets.upsert_bucketed(spark, path, frame(spark, []))["touched"] == 0


def test_an_update_that_was_not_committed_is_not_read(spark, tmp_path, base):
    path = str(tmp_path / "t")
    buckets.create_bucketed(base, path, ["k", "g"], 8)
    want = repr(collect(buckets.read_bucketed(spark, path)))
    buckets._write(base.limit(3), path, ["k", "g"], 8, "0000000001-crashed")
    os.makedirs(f"{path}/pointers/0000000001")  # no _SUCCESS
    assert repr(collect(buckets.read_bucketed(spark, path))) == want


def test_old_generations_are_read_until_removed(spark, tmp_path, base):
    path = str(tmp_path / "t")
    buckets.create_bucketed(base, path, ["k", "g"], 8)
    for v in (1, 2, 3):
        buckets.upsert_bucketed(spark, path, frame(spark, [(5.0, "b", v)]))
    assert buckets.read_bucketed(spark, path, 1).where("k = 5").first()["v"] == 1
    want = repr(collect(buckets.read_bucketed(spark, path)))
    assert buckets.vacuum(spark, path, keep=1)
    assert repr(collect(buckets.read_bucketed(spark, path))) == want
    assert buckets.generations(spark, path) == [3]
    assert buckets.vacuum(spark, path, keep=1) == []


def test_new_columns_empty_tables_and_refusals(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = frame(spark, [])
    buckets.create_bucketed(empty, path, ["k"], 4)
    assert buckets.read_bucketed(spark, path).collect() == []
    buckets.upsert_bucketed(spark, path, frame(spark, [(1, 2)], "k int, extra int"))
    buckets.upsert_bucketed(spark, path, frame(spark, [(2.0, "g", 3)]))
    rows = buckets.read_bucketed(spark, path).select("k", "g", "v", "extra")
    assert collect(rows) == [(1.0, None, None, 2), (2.0, "g", 3, None)]
    with pytest.raises(FileExistsError):
        buckets.create_bucketed(empty, path, ["k"], 4)
    with pytest.raises(FileNotFoundError):
        buckets.read_bucketed(spark, str(tmp_path / "none"))
