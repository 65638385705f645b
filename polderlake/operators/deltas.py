"""Gold tables kept by deltas: rows that left are retracted, rows that came are added.

The state of a gold table holds the mergeable parts of its measures per group. Sums and counts
take the signed parts of a delta. A minimum or maximum is taken anew from the group's rows only
where a retracted value reached it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.functions.scalars import fresh
from polderlake.operators.incremental import union_batches
from polderlake.operators.joins import skew_safe_join
from polderlake.operators.rollup import Measure

ROWS = "n_rows"
EXTREMES = {"min": F.min, "max": F.max}


def _parts(df: DataFrame, measures: Sequence[Measure]) -> dict[str, tuple[str, Column]]:
    """Column name of each part in the state, with the part's kind and aggregate."""
    parts = {}
    for m in measures:
        for part, c in {**m.parts(df), "n": F.count(F.col(m.column))}.items():
            parts[f"{m.name}__{part}"] = (part, c)
    return parts


def gold_state(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """``keys``, ``n_rows`` and the parts of the measures, from all rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS), *[
        c.alias(name) for name, (_, c) in _parts(df, measures).items()])


def apply_delta(state: DataFrame, added: DataFrame, removed: DataFrame, current: DataFrame,
                keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """The state after ``removed`` rows left and ``added`` rows came.

    ``current`` is the table after the change. It is read only for groups whose extreme was
    retracted, or whose retracted values have no exact sum (infinite, NaN, beyond 1e24). A group
    without rows goes. Null keys are a group. Equals ``gold_state(current)``.
    """
    parts = _parts(current, measures)
    gone = lambda name: f"{name}__gone"
    plus, minus = gold_state(added, keys, measures), gold_state(removed, keys, measures)
    signed = minus.select(*keys, (-F.col(ROWS)).alias(ROWS), *[
        (F.col(name).alias(gone(name)) if part in EXTREMES or part == "r" else
         (-F.col(name)).alias(name)) for name, (part, _) in parts.items()])
    both = union_batches(state, plus, signed).groupBy(*keys).agg(F.sum(ROWS).alias(ROWS), *[
        EXTREMES.get(part, F.sum)(name).alias(name) for name, (part, _) in parts.items()], *[
        EXTREMES.get(part, F.sum)(gone(name)).alias(gone(name))
        for name, (part, _) in parts.items() if part in EXTREMES or part == "r"])
    stale = F.lit(False)
    for name, (part, _) in parts.items():
        if part in EXTREMES:
            reached = F.col(gone(name)) <= F.col(name) if part == "min" else F.col(gone(name)) >= F.col(name)
            stale = stale | F.coalesce(reached, F.lit(False))
        elif part == "r":
            stale = stale | F.col(gone(name)).isNotNull()
    mark = fresh("_stale", state, current)
    merged = both.where(F.col(ROWS) > 0).withColumn(mark, stale)
    out = [*keys, ROWS, *parts]
    kept = merged.where(~F.col(mark)).select(*keys, ROWS, *[
        # A sum without values left is null, as it is when built from all rows.
        F.col(name) if part in ("n", *EXTREMES) else F.when(
            F.col(f"{name.rsplit('__', 1)[0]}__n") > 0, F.col(name)).alias(name)
        for name, (part, _) in parts.items()])
    group = fresh("_group", current, merged)
    touched = merged.where(F.col(mark)).select(F.struct(*keys).alias(group))
    rows = skew_safe_join(current.withColumn(group, F.struct(*keys)), touched, [group], "left_semi")
    return kept.select(*out).unionByName(gold_state(rows.drop(group), keys, measures).select(*out))


def gold_from_state(state: DataFrame, source: DataFrame, keys: Sequence[str],
                    measures: Sequence[Measure]) -> DataFrame:
    """The gold table that ``rollup`` gives, from its state; ``source`` lends the column types."""
    return state.select(*keys, *[
        m.result(lambda part, m=m: F.col(f"{m.name}__{part}"), source) for m in measures])
