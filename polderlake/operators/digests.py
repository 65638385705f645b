"""Fingerprints of tables: trees of digests for change detection, and layer reconciliation.

A digest is the number of rows of a set and the sums of two 64-bit hashes of them. It does not
depend on the order of the rows, counts copies, and digests of parts add up to that of the
whole. Two sets that differ have equal digests with a chance of about 2**-128.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.functions.scalars import comparable, fresh
from polderlake.operators.incremental import detect_changes, union_batches
from polderlake.operators.joins import skew_safe_join
from polderlake.session import scratch_root

LEAVES, FANOUT = 1 << 12, 16
PARTS = ("n", "d1", "d2")


def _hash(df: DataFrame, columns: Sequence[str], seed: int) -> Column:
    """Hash of the values; a null is told apart from a value left out, -0.0 equals 0.0."""
    parts: list[Column] = [F.lit(seed)]
    for name, c in zip(columns, comparable(df, columns)):
        if df.schema[name].dataType.typeName() in ("double", "float"):
            c = c + F.lit(0.0).cast(df.schema[name].dataType)
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def leaf(df: DataFrame, keys: Sequence[str], leaves: int = LEAVES) -> Column:
    """The leaf of a row: by its key, so all rows of a key share it."""
    return F.pmod(_hash(df, keys, 1), F.lit(leaves)).cast("int")


def _digest(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    wide = "decimal(28,0)"  # sums of 10**18 hashes
    return [F.count(F.lit(1)).alias("n"), F.sum(_hash(df, columns, 2).cast(wide)).alias("d1"),
            F.sum(_hash(df, columns, 3).cast(wide)).alias("d2")]


def digest_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str], leaves: int = LEAVES,
                fanout: int = FANOUT) -> DataFrame:
    """``level, node, n, d1, d2`` from the root (level 0) down to the leaves.

    The rows are read once and shuffle as one digest per task and leaf. The tree is small and
    meant to be kept beside the load, so that the next load compares without reading this one.
    """
    depth, width = 0, leaves
    while width > 1:
        if width % fanout:
            raise ValueError(f"the number of leaves is no power of {fanout}: {leaves}")
        depth, width = depth + 1, width // fanout
    rows = df.groupBy(leaf(df, keys, leaves).alias("leaf")).agg(*_digest(df, [*keys, *columns]))
    above = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.expr(
        f"leaf div {fanout ** (depth - level)}").cast("int").alias("node")) for level in range(depth + 1)]))
    return rows.withColumn("at", above).groupBy("at.level", "at.node").agg(
        *[F.sum(p).alias(p) for p in PARTS])


def differing_leaves(old: DataFrame, new: DataFrame, leaves: int = LEAVES,
                     fanout: int = FANOUT) -> DataFrame:
    """``node``: leaves whose digests differ, found from the root down.

    Each level looks only at children of nodes that differ.
    """
    depth = 0
    while fanout ** depth < leaves:
        depth += 1

    def differing(level: int) -> DataFrame:
        side = lambda df, name: df.where(F.col("level") == level).select(
            "node", F.struct(*PARTS).alias(name))
        both = side(old, "was").join(side(new, "now"), "node", "full_outer")
        return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("node")

    nodes = differing(0)
    for level in range(1, depth + 1):
        parents = nodes.select(F.col("node").alias("parent"))
        below = differing(level).withColumn("parent", F.expr(f"node div {fanout}").cast("int"))
        nodes = below.join(parents, "parent", "left_semi").select("node")
    return nodes


def changes_by_digest(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str],
                      latest_by: str | Sequence[str] | None = None,
                      old_tree: DataFrame | None = None, new_tree: DataFrame | None = None,
                      leaves: int = LEAVES, fanout: int = FANOUT) -> DataFrame:
    """The keys that ``detect_changes`` labels ``new``, ``changed`` or ``missing``.

    Only rows of leaves that differ are shuffled and compared; of equal loads only digests move.
    Trees that were kept spare the first reading. Leaves are few by declaration, so those that
    differ are broadcast.
    """
    extra = [] if latest_by is None else [latest_by] if isinstance(latest_by, str) else list(latest_by)
    covered = [*columns, *(c for c in extra if c not in columns and c not in keys)]
    trees = [t if t is not None else digest_tree(df, keys, covered, leaves, fanout)
             for df, t in ((old, old_tree), (new, new_tree))]
    nodes = differing_leaves(*trees, leaves, fanout)
    mark = fresh("_leaf", old, new)
    touched = F.broadcast(nodes.select(F.col("node").alias(mark)))

    def part(df: DataFrame) -> DataFrame:
        kept = df.select(*dict.fromkeys([*keys, *covered]))
        return kept.withColumn(mark, leaf(kept, keys, leaves)).join(touched, mark, "left_semi").drop(mark)

    return detect_changes(part(old), part(new), keys, columns, latest_by).where("change <> 'same'")


def reconcile(before: DataFrame, after: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per partition ``by``: rows on both sides, and whether they hold the same keys as often.

    Counts alone hide a key that vanished while another one doubled; the fingerprints do not.
    """
    side = lambda df, name: df.groupBy(*by).agg(*_digest(df, keys)).select(
        *by, F.struct(*PARTS).alias(name))
    was, now = fresh("_was", before, after), fresh("_now", before, after)
    none = lambda name: F.lit(None).cast(
        "struct<n:bigint,d1:decimal(38,0),d2:decimal(38,0)>").alias(name)
    both = union_batches(side(before, was).withColumn(now, none(now)),
                         side(after, now).withColumn(was, none(was))).groupBy(*by).agg(
        F.max(was).alias(was), F.max(now).alias(now))
    rows = lambda c: F.coalesce(F.col(f"{c}.n"), F.lit(0))
    return both.select(*by, rows(was).alias("rows_before"), rows(now).alias("rows_after"),
                       F.col(was).eqNullSafe(F.col(now)).alias("same_keys"))


def unreconciled_keys(before: DataFrame, after: DataFrame, by: Sequence[str],
                      keys: Sequence[str]) -> DataFrame:
    """Keys that vanished, appeared, or are there more or fewer times than before.

    Only partitions whose fingerprints differ are counted key by key. Those are found first, once;
    rows are held against that list, not shuffled by partition, as a few of them may hold all rows.
    """
    both = [*by, *(k for k in keys if k not in by)]
    scratch_root(before.sparkSession)
    mark = fresh("_by", before, after)
    off = reconcile(before, after, by, keys).where(~F.col("same_keys")).select(
        F.struct(*by).alias(mark)).checkpoint()

    def side(df: DataFrame, n_before: int, n_after: int) -> DataFrame:
        kept = skew_safe_join(df.select(*both, F.struct(*by).alias(mark)), off, [mark], "left_semi")
        return kept.select(*both, F.lit(n_before).alias("n_before"), F.lit(n_after).alias("n_after"))

    counted = union_batches(side(before, 1, 0), side(after, 0, 1)).groupBy(*both).agg(
        *[F.sum(n).alias(n) for n in ("n_before", "n_after")])
    what = (F.when(F.col("n_after") == 0, "vanished").when(F.col("n_before") == 0, "appeared")
            .when(F.col("n_after") > F.col("n_before"), "multiplied").otherwise("reduced"))
    return counted.where("n_before <> n_after").withColumn("what", what)
