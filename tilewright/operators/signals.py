"""Operators on one-dimensional series in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that ``fitting_lines`` holds in one block.
CELLS_AT_ONCE = 1_000_000


def moving_average(v: Column, keys: list[str], pos: str, width: int) -> Column:
    """Mean over ``width`` places around each, places beyond the ends counting as 0."""
    half = width // 2
    around = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-half, half)
    return F.sum(v).over(around) / F.lit(width)


def dip(v: Column, keys: list[str], pos: str) -> Column:
    """Mean of the eight values two to five places off minus the value itself; 0 within five places of an end."""
    order = Window.partitionBy(*keys).orderBy(pos)
    before, after = order.rowsBetween(-5, -2), order.rowsBetween(2, 5)
    inside = F.lag(F.lit(1), 5).over(order).isNotNull() & F.lead(F.lit(1), 5).over(order).isNotNull()
    return F.when(inside, (F.sum(v).over(before) + F.sum(v).over(after)) / 8.0 - v).otherwise(F.lit(0.0))


def is_peak(v: Column, keys: list[str], pos: str) -> Column:
    """Whether a value is above both neighbours; the ends are no peaks."""
    order = Window.partitionBy(*keys).orderBy(pos)
    return F.coalesce((v > F.lag(v).over(order)) & (v > F.lead(v).over(order)), F.lit(False))


def spaced_peaks(rows: DataFrame, keys: list[str], pos: str, score: str, apart: int, most: int = 3) -> DataFrame:
    """The rows of the best scores that are at least ``apart`` from all better ones kept, ``most`` for each key.

    Ties go to the lower position; positions must be distinct. One shuffle: each round is a maximum over the key.
    """
    whole = Window.partitionBy(*keys)
    free, kept = F.col(score).isNotNull(), F.lit(False)
    for i in range(most):
        top = F.max(F.when(free, F.struct(F.col(score).alias("s"), (-F.col(pos)).alias("p")))).over(whole)
        rows = rows.withColumn(f"_top{i}", -top["p"])
        kept = kept | F.col(pos).eqNullSafe(F.col(f"_top{i}"))
        free = free & (F.abs(F.col(pos) - F.col(f"_top{i}")) >= apart)
    return rows.where(kept).drop(*[f"_top{i}" for i in range(most)])


def strongest_near(rows: DataFrame, bounds: DataFrame, keys: list[str], pos: str, score: str, radius: int) -> DataFrame:
    """``bounds`` (keys, bound, lo, hi) with snapped: the place of the best score within the radius, at least two off lo and hi.

    Ties go to the lower place; a bound without any place in reach stays. Each bound looks for the 2 *
    radius + 1 places around it, so the join is by equal places, not by ranges.
    """
    reach = bounds.select(*keys, "bound", "lo", "hi", F.explode(F.sequence(F.col("bound") - radius, F.col("bound") + radius)).alias("_at"))
    reach = reach.where((F.col("_at") >= F.col("lo") + 2) & (F.col("_at") <= F.col("hi") - 2))
    held = rows.select(*keys, F.col(pos).alias("_at"), F.col(score).alias("_score"))
    best = reach.join(held, [*keys, "_at"]).groupBy(*keys, "bound").agg(F.max(F.struct("_score", (-F.col("_at")).alias("p"))).alias("x"))
    found = bounds.join(best, [*keys, "bound"], "left")
    return found.withColumn("snapped", F.coalesce(-F.col("x.p"), F.col("bound"))).drop("x")


def stopped_early(rows: DataFrame, keys: list[str], pos: str, score: str, patience: int, start: float = 0.0) -> DataFrame:
    """The rows of each series up to the one at which the score has not improved ``patience`` times, with improved and stale.

    A score improves if it is above all before it and above ``start``; stale counts the rows since the last
    that did. The last row of a stopped series is the one that used up the patience.
    """
    order = Window.partitionBy(*keys).orderBy(pos)
    before = F.greatest(F.max(score).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(start))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("improved", F.coalesce(F.col(score) > before, F.lit(False))).withColumn("_n", F.row_number().over(order))
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("_n"))).over(upto), F.lit(0))
    found = found.withColumn("stale", (F.col("_n") - last).cast("int"))
    over = F.coalesce(F.max("stale").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) >= patience
    return found.withColumn("_over", over).where(~F.col("_over")).drop("_n", "_over")


def distinct_lattices(candidates: Column, within: float = 3.0) -> Column:
    """An array of lattices (arrays of lines) without those all of whose lines lie within ``within`` of one kept before."""

    def known(kept: Column, lines: Column) -> Column:
        apart = lambda other: F.array_max(F.zip_with(lines, other, lambda a, b: F.abs(a - b)))
        return F.exists(kept, lambda other: F.coalesce(apart(other) <= within, F.lit(False)))

    first = F.slice(candidates, 1, 0)
    return F.aggregate(candidates, first, lambda kept, x: F.when(known(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def softmax_top(scores: Column) -> Column:
    """The softmax value of an array's largest score."""
    top = F.array_max(scores)
    total = F.aggregate(F.transform(scores, lambda s: F.exp(s - top)), F.lit(0.0), lambda a, b: a + b)
    return F.lit(1.0) / total


def first_largest(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _misfits(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over the last axis of sorted lines: how far any gap is from the median gap, and that median."""
    gaps = np.diff(lines)
    pitch = np.median(gaps, axis=-1, keepdims=True)
    return np.abs(gaps - pitch).max(axis=-1), pitch[..., 0]


def _without_misfits(found: list[np.ndarray | None], within: float) -> None:
    """Shortens arrays of sorted lines in place: the longest together, down to those of four lines."""
    by_size: dict[int, list[int]] = {}
    for i, lines in enumerate(found):
        if lines is not None:
            by_size.setdefault(len(lines), []).append(i)
    for n in range(max(by_size, default=0), 3, -1):
        at = by_size.get(n, [])
        others = np.array([[i for i in range(n) if i != j] for j in range(n)])
        each = max(1, CELLS_AT_ONCE // (n * n))
        for some in (at[k : k + each] for k in range(0, len(at), each)):
            rows = np.stack([found[i] for i in some])
            far, pitch = _misfits(rows)
            left = np.flatnonzero(~(far <= pitch * within))
            shorter = rows[left][:, others]  # row, lost line, lines left
            best = shorter[np.arange(len(left)), _misfits(shorter)[0].argmin(axis=1)]
            for k, lines in zip(left, best, strict=True):
                found[some[k]] = lines
                by_size.setdefault(n - 1, []).append(some[k])


def fitting_lines(lines: Column, within: float = 0.12) -> Column:
    """The lines that fit one pitch: while a gap is off the median gap by more than ``within`` of it, one line goes.

    It is the line whose loss leaves the gaps closest to their median, the first of several. Three lines
    always stay. ``lines`` is an array of doubles in any order; its nulls and NaNs are left out, a null
    array gives null. The work grows with the cube of an array, which should hold one image's or card's
    lines; arrays of a batch are worked on together.
    """

    def run(arrays: pd.Series) -> pd.Series:
        found: list[np.ndarray | None] = []
        for array in arrays:
            held = None if array is None else np.array(array, float)
            found.append(None if held is None else np.sort(held[~np.isnan(held)]))
        _without_misfits(found, within)
        return pd.Series(found, dtype=object)

    return F.pandas_udf(run, "array<double>")(lines)
