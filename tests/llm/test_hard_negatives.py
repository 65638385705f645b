import math
import random

import numpy as np
import pytest
from fixtures import CLASHES
from pyspark.sql import functions as F

from polderlake.llm import hard_negatives as hn


def brute(rows, is_anchor, positives=5, k=10):
    out = []
    for a, la, va in rows:
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in rows if i != a]
        for p, pid in sorted((s, i) for s, i, lab in scored if lab == la)[:positives]:
            inside = sorted((s, i) for s, i, lab in scored
                            if lab != la and 30 * -p <= 100 * -s <= 90 * -p)
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(inside[:k], 1)]
    return sorted(out)


def mined(spark, rows, mod=10, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    return sorted(map(tuple, hn.mine(spark, df, F.col("vec_id") % mod == 0, **options).collect()))


@pytest.mark.parametrize("spread,dims", [(300, 6), (2, 3)])
def test_equals_brute_force_with_ties_and_several_shards(spark, monkeypatch, spread, dims):
    monkeypatch.setattr(hn, "SHARD_ROWS", 60)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 7)
    r = random.Random(dims)
    rows = [(i, r.randrange(4), [r.randint(-spread, spread) for _ in range(dims)])
            for i in range(240)]
    rows += [(1_000 + i, i % 3, rows[0][2]) for i in range(60)]  # one vector many times
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_reading_stops_before_the_end_of_the_lists():
    r = np.random.default_rng(3)
    x = r.integers(-20, 20, (4_000, 3)).astype(np.float64)
    x[:20] += 400
    lists = hn.Lists(x)
    depths = lists.depths()
    anchor = np.array([5.0, 7.0, 3.0])
    bounds = lists.thresholds(anchor[None], depths)[0]
    at, scores = lists.search(anchor, bounds, depths, np.ones(len(x), bool), [(-np.inf, np.inf)], 5)
    assert len(at) < 300
    want = np.sort(x @ anchor)[::-1][:5]
    assert scores[hn.best(scores, at, -np.inf, np.inf, 5)].tolist() == want.tolist()


def test_usable_rows(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, None, [1.0, 1.0]), (3, 1, None), (4, 1, [1.0, None]),
            (5, 1, [float("nan"), 1.0]), (6, 1, [float("inf"), 1.0]), (None, 1, [1.0, 1.0]),
            (7, 2, [1.0, 1.0]), (7, 2, [1.0, 1.0]), (7, 1, [2.0, 2.0]), (8, 1, [])]
    df = spark.createDataFrame([(*x, *["c"] * len(CLASHES)) for x in rows],
                               "vec_id long, label int, embedding array<float>, "
                               + ", ".join(f"{c} string" for c in CLASHES))
    got = {r["vec_id"]: (r["label"], r["v"]) for r in hn.usable(df).collect()}
    assert got == {1: (1, [128, -1]), 7: (1, [512, 512]), 8: (1, [])}


def test_vectors_of_differing_length_empty_tables_and_lonely_labels(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3]), (2, 2, [1, 1, 9]), (3, 2, []), (10, 9, [1, 1])]
    padded = [(i, lab, [*v, 0, 0, 0][:3]) for i, lab, v in rows]
    assert mined(spark, rows) == brute(padded, lambda i: i % 10 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(3, 1, [1])]) == []
    assert mined(spark, [(10, 1, [1]), (11, 1, [-5]), (12, 2, [-2])]) == []  # no window below zero


def test_scores_stay_exact_or_are_refused():
    big = np.array([[3_000_000_019, 7]])
    assert hn.exact_type(np.array([[256] * 64]), np.array([[256] * 64])) is np.float32
    assert hn.exact_type(np.array([[70_000, 1]]), np.array([[70_000, 1]])) is np.float64
    assert hn.exact_type(np.array([[100_000_007, 7]]), np.array([[100_000_007, 7]])) is np.int64
    with pytest.raises(OverflowError):
        hn.exact_type(big, big)
    assert math.isfinite(hn.top_of(big))
