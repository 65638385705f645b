"""Hard negatives by Fagin's threshold algorithm.

Vectors are whole numbers, a score is their inner product. Rows are dealt to shards by the hash
of their id, anchors to blocks; each shard meets each block once, in a group of bounded size.
There every dimension is a list of the shard's rows, sorted by component. For an anchor the
lists are read in step, from the largest component down where the anchor is positive and from
the smallest up where it is negative, a zero dimension not at all. A row met for the first time
is looked up and scored in full. What is still unseen scores at most the sum of the anchor's
products with the components last read, the threshold: reading stops once that is strictly
below the k-th score of every window (or below the window, while it holds fewer than k). So
ties at the k-th score are always complete.

Two rounds: the rows of the anchor's own label give its positives, whose scores set the windows
in which rows of other labels are sought. The best k of a shard are merged over all shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polderlake.llm.common import staged

SHARD_ROWS, BLOCK_ANCHORS = 4_096, 1_024
FIRST_DEPTH, DEEPER = 32, 4  # lists are read to this depth, then to so many times the last


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
           label: str = "label", scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: components as ``floor(scale * x)``, one row per id.

    Rows with a null id, label or vector or with a null, infinite or NaN component are left
    out. Of rows that share an id the one with the smallest label, then vector, stays.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    good = (F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & finite)
    rows = df.where(good).select(F.col(vec_id).alias("vec_id"),
                                 F.struct(F.col(label).alias("label"), whole.alias("v")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


class Lists:
    """A shard's vectors and, per dimension, its rows sorted by component."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(x.T, self.order, axis=1)

    def depths(self) -> list[int]:
        n, d, out = len(self.x), FIRST_DEPTH, []
        while d < n:
            out.append(d)
            d *= DEEPER
        return [*out, n]

    def thresholds(self, anchors: np.ndarray, depths: list[int]) -> np.ndarray:
        """For each anchor and depth, the highest score that an unseen row can have."""
        down = self.values[:, [len(self.x) - d for d in depths]]
        up = self.values[:, [d - 1 for d in depths]]
        return np.maximum(anchors, 0) @ down + np.minimum(anchors, 0) @ up

    def search(self, anchor: np.ndarray, bounds: np.ndarray, depths: list[int],
               allowed: np.ndarray, windows: list[tuple[float, float]], k: int):
        """Rows and scores of the allowed rows, complete for the first ``k`` of each window."""
        n = len(self.x)
        plus, minus = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        rest = allowed.copy()
        found, scores, last = [], [], 0
        for bound, depth in zip(bounds, depths):
            met = np.zeros(n, bool)
            met[self.order[plus, n - depth:n - last]] = True
            met[self.order[minus, last:depth]] = True
            if depth == n:  # an anchor without any component meets no row in its lists
                met[:] = True
            new = np.flatnonzero(met & rest)
            rest[new] = False
            found.append(new)
            scores.append(self.x[new] @ anchor)
            seen = np.concatenate(scores)
            if all(bound < self._least(seen, low, high, k) for low, high in windows):
                break
            last = depth
        return np.concatenate(found), np.concatenate(scores)

    @staticmethod
    def _least(scores: np.ndarray, low: float, high: float, k: int) -> float:
        """The k-th score within a window; its lower end while it holds fewer."""
        inside = scores[(scores >= low) & (scores <= high)]
        return np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else low


def best(scores: np.ndarray, ids: np.ndarray, low: float, high: float, k: int) -> np.ndarray:
    """Places of the first ``k`` within the window, by score, ties by smaller id."""
    inside = np.flatnonzero((scores >= low) & (scores <= high))
    if len(inside) > k:
        part = scores[inside]
        inside = inside[part >= np.partition(part, len(part) - k)[len(part) - k]]
    return inside[np.lexsort((ids[inside], -scores[inside]))[:k]]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def top_of(m: np.ndarray) -> int:
    return max(-int(m.min()), int(m.max())) if m.size else 0


def exact_type(rows: np.ndarray, anchors: np.ndarray) -> type:
    """The cheapest type whose sums of products are exact."""
    reach = rows.shape[1] * max(1, top_of(rows)) * max(1, top_of(anchors))
    if reach >= 1 << 63:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64


def _searched(rows: DataFrame, anchors: DataFrame, dims: int, n_rows: int, n_anchors: int,
              same: bool, k: int, schema: str) -> DataFrame:
    """Every shard against every block of anchors; the best ``k`` per shard and window.

    An anchor has a list ``windows`` of ``id, score, low, high``; without one the window is open.
    """
    shards = max(1, math.ceil(n_rows / SHARD_ROWS))
    blocks = max(1, math.ceil(n_anchors / BLOCK_ANCHORS))
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"),
                              "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = anchors.select(  # names of their own: both sides come from one table
        F.col("vec_id").alias("anchor"), F.col("label").alias("its_label"), F.col("v").alias("its_v"),
        *(["windows"] if "windows" in anchors.columns else []))
    asked = asked.withColumns({"block": F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"),
                               "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, anchor_ids = left["vec_id"].to_numpy(), right["anchor"].to_numpy()
        codes = pc.dictionary_encode(pa.chunked_array(
            [*left["label"].chunks, *right["its_label"].chunks],
            left.schema.field("label").type)).combine_chunks().indices.to_numpy()
        mine, theirs = codes[:len(ids)], codes[len(ids):]
        x, a = _matrix(left["v"], dims), _matrix(right["its_v"], dims)
        kind = exact_type(x, a)
        lists, a = Lists(x.astype(kind)), a.astype(kind)
        depths = lists.depths()
        bounds = lists.thresholds(a, depths)
        asked_for = right["windows"].to_pylist() if "windows" in right.column_names else None
        out: list[tuple] = []
        for i, anchor in enumerate(anchor_ids):
            own = mine == theirs[i]
            allowed = own & (ids != anchor) if same else ~own
            windows = asked_for[i] if asked_for else [
                {"id": None, "score": None, "low": -np.inf, "high": np.inf}]
            spans = [(w["low"], w["high"]) for w in windows]
            at, scores = lists.search(a[i], bounds[i], depths, allowed, spans, k)
            at_ids = ids[at]
            for w, (low, high) in zip(windows, spans):
                for j in best(scores, at_ids, low, high, k):
                    out.append((anchor, w["id"], w["score"], at_ids[j], int(scores[j])))
        names = [f.split()[0] for f in schema.split(", ")]
        columns = list(zip(*out)) or [()] * 5
        picked = [columns[0], columns[3], columns[4]] if same else columns
        return pa.table({n: pa.array([None if v is None else int(v) for v in c], pa.int64())
                         for n, c in zip(names, picked)})

    return (dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
            .applyInArrow(_guarded(run, schema), schema))


def _guarded(run, schema: str):
    """Groups without rows or without anchors give nothing."""
    empty = pa.table({f.split()[0]: pa.array([], pa.int64()) for f in schema.split(", ")})

    def guarded(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right) if left.num_rows and right.num_rows else empty
    return guarded


def mine(spark: SparkSession, rows: DataFrame, is_anchor: Column, positives: int = 5,
         k: int = 10, low_percent: int = 30, high_percent: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` holds ``vec_id`` (whole numbers, not null, unique), ``label`` and ``v`` (whole
    numbers), as ``usable`` gives them; shorter vectors count as filled with zeros. For each
    anchor its first ``positives`` other rows of the same label, and for each of them the first
    ``k`` rows of another label whose score lies between the two percentages of the positive's.
    Higher scores come first, ties by smaller id. An anchor without a row of its label, or a
    positive whose window holds no row (as when its score is negative), gives no row; an empty
    table gives an empty result. Scores that could pass 64 bits are refused.
    """
    rows = staged(spark, rows.select("vec_id", "label", "v"), "hard-negatives-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"),
                    F.min(F.size("v")).alias("least"),
                    F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    dims = size["dims"] or 0
    if size["least"] != size["dims"]:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(
            F.lit(0).cast("long"), F.lit(dims) - F.size("v"))))
    anchors = rows.where(is_anchor)
    counts = (dims, size["n"], size["anchors"])
    near = _searched(rows, anchors, *counts, True, positives,
                     "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    score = F.col("positive_score")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # At most `positives` windows an anchor: bounds are the whole scores that satisfy
    # low * positive <= 100 * negative <= high * positive.
    windows = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(
        F.col("positive_id").alias("id"), score.alias("score"),
        (-F.expr(f"floor(-positive_score * {low_percent} / 100BD)")).cast("long").alias("low"),
        F.expr(f"floor(positive_score * {high_percent} / 100BD)").cast("long").alias("high")
    )).alias("windows"))
    windows = staged(spark, windows, "hard-negatives-windows")
    found = _searched(rows, anchors.join(windows, "vec_id"), *counts, False, k,
                      "anchor_id long, positive_id long, positive_score long, "
                      "negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(
        F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score"))
