import random

from conftest import collect

from polderlake.operators import digests, incremental

SCHEMA = "k long, ts double, v string, node int"


def table(spark, seed, n=600):
    r = random.Random(seed)
    rows = [(i if i % 40 else None, float(r.randrange(9)), r.choice("abc"), 1) for i in range(n)]
    return rows + [(5, -0.0, None, 1), (5, 0.0, "a", 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_changes_equal_the_full_comparison(spark):
    old = table(spark, 1)
    new = [(k, ts, v if k != 77 else "zz", 1) for k, ts, v, _ in old if k not in (3, 4)] + [(9_999, 1.0, "x", 1)]
    random.Random(2).shuffle(new)
    for latest in (None, ["ts"]):
        full = incremental.detect_changes(frame(spark, old), frame(spark, new), ["k"], ["ts", "v"], latest)
        got = digests.changes_by_digest(frame(spark, old), frame(spark, new), ["k"], ["ts", "v"], latest,
                                        leaves=256)
        assert collect(got) == collect(full.where("change <> 'same'"))
        assert {r["change"] for r in got.collect()} == {"new", "changed", "missing"}


def test_equal_loads_differ_in_no_leaf_and_one_row_in_one(spark):
    rows = table(spark, 3)
    tree = lambda x: digests.digest_tree(frame(spark, x).repartition(5), ["k"], ["ts", "v"], 256)
    assert digests.differing_leaves(tree(rows), tree(rows[::-1]), 256).collect() == []
    assert digests.differing_leaves(tree(rows), tree([*rows, (1, 1.0, "n", 1)]), 256).count() == 1
    assert digests.differing_leaves(tree(rows), tree(rows[:-1] + rows[-2:-1]), 256).count() == 1
    assert tree(rows).where("level = 0").first()["n"] == len(rows)
    assert digests.changes_by_digest(frame(spark, rows), frame(spark, rows), ["k"], ["ts", "v"],
                                     old_tree=tree(rows), new_tree=tree(rows), leaves=256).collect() == []
    assert digests.differing_leaves(tree([]), tree([]), 256).collect() == []


def test_nulls_have_a_place(spark):
    a = spark.createDataFrame([(None, 1), (2, None)], "x int, y int")
    b = spark.createDataFrame([(1, None), (None, 2)], "x int, y int")
    got = digests.reconcile(a.selectExpr("1 p", "*"), b.selectExpr("1 p", "*"), ["p"], ["x", "y"]).first()
    assert (got["rows_before"], got["rows_after"], got["same_keys"]) == (2, 2, False)


def test_reconciliation_names_what_counts_hide(spark):
    before = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5), ("c", 5)], "p string, k int")
    after = spark.createDataFrame([("a", 1), ("a", 1), ("b", 3), (None, 4), ("c", 5), ("d", 6)], "p string, k int")
    state = {r["p"]: r["same_keys"] for r in digests.reconcile(before, after, ["p"], ["k"]).collect()}
    assert state == {"a": False, "b": True, None: True, "c": False, "d": False}
    off = digests.unreconciled_keys(before, after, ["p"], ["k"])
    assert collect(off) == [("a", 1, 1, 2, "multiplied"), ("a", 2, 1, 0, "vanished"),
                            ("c", 5, 2, 1, "reduced"), ("d", 6, 0, 1, "appeared")]
    assert digests.unreconciled_keys(before, before, ["p"], ["k"]).collect() == []


def test_rows_are_not_shuffled_by_partition_to_find_keys(spark):
    rows = spark.range(4_000).selectExpr("id % 2 AS p", "id AS k").repartition(4)
    off = digests.unreconciled_keys(rows, rows.where("k % 100 <> 0"), ["p"], ["k"])
    assert collect(off) == sorted([(0, k, 1, 0, "vanished") for k in range(0, 4_000, 100)], key=repr)
    plan = off._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    before = off._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in before and before.count("BroadcastHashJoin") == 2
