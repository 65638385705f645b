import math
import random
from datetime import datetime, timedelta

import pytest
from conftest import collect
from pyspark.sql import functions as F

from polderlake.operators import monitor


def test_sketch_quantiles_are_within_the_bound_and_merge(spark):
    r = random.Random(4)
    t0 = datetime(2024, 1, 1)
    delays = [int(10 ** r.uniform(0, 13)) * r.choice([1, 1, 1, -1]) for _ in range(1_500)] + [0, 1, 127, 128, 255, 256]
    rows = [(i % 3, i % 5, t0, t0 + timedelta(microseconds=v)) for i, v in enumerate(delays)]
    df = spark.createDataFrame([*rows, (0, 0, t0, None)], "g int, day int, a timestamp_ntz, b timestamp_ntz")
    ps = [0.01, 0.2, 0.5, 0.9, 0.99, 1.0]
    days = [monitor.latency_sketch(df.where(F.col("day") == k), ["g", "day"], F.col("a"), F.col("b")) for k in range(5)]
    merged = monitor.merge_sketches(days, ["g"])
    assert collect(merged) == collect(monitor.latency_sketch(df, ["g"], F.col("a"), F.col("b")))
    for row in monitor.sketch_quantiles(merged, ["g"], ps).collect():
        mine = sorted(v for i, v in enumerate(delays) if i % 3 == row["g"])
        assert row["n"] == len(mine)
        for p in ps:
            exact = mine[math.ceil(p * len(mine)) - 1] / 1e6
            assert abs(row[f"p{round(p * 100)}_seconds"] - exact) <= abs(exact) / 256 + 1e-12
    assert merged.count() <= 3 * 2 ** 13
    assert monitor.sketch_quantiles(merged.limit(0), ["g"], ps).collect() == []


def test_reachability_equals_a_walk_and_refuses_circles(spark):
    r = random.Random(5)
    edges = [(f"t{a}", f"t{b}") for a in range(14) for b in range(a + 1, 14) if r.random() < 0.25]
    frame = lambda rows: spark.createDataFrame(rows, "from_table string, to_table string")
    want = {}
    for start in {a for a, _ in edges}:
        level, hops = {start}, 0
        while level:
            hops += 1
            level = {b for a, b in edges if a in level and (start, b) not in want}
            want.update({(start, b): hops for b in level})
    got = monitor.reachable(frame(edges + edges[:3] + [(None, "t1"), ("t1", None)]))
    assert {(x["source"], x["target"]): x["hops"] for x in got.collect()} == want and got.count() == len(want)
    assert monitor.reachable(frame([])).collect() == []
    for circle in ([("a", "a")], [("a", "b"), ("b", "c"), ("c", "a")]):
        with pytest.raises(ValueError, match="circle"):
            monitor.reachable(frame(circle))
