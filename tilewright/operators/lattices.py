"""Lattices of lines: dividers that depend on each other, the search for a better lattice, and the valley between two fused signs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a grid, so one line more.
PARTS = 5

# The pitches and starts that are tried first, as shares of the pitch by which the band would be cut
# evenly; how far beyond the band the last line may lie, and when a found lattice is taken.
PITCHES = (0.72, 0.8, 0.85, 0.9, 1.0, 1.1, 1.22)
STARTS = (-0.35, -0.2, -0.05, 0.1, 0.25)
BEYOND, GOOD, BETTER = 8, 0.85, 0.10
# A valley has less than so much of the profile's maximum, and as much in five places on one side.
EMPTY, FLANK, REACH = 0.06, 0.30, 5


def divided(cards: DataFrame, lines: DataFrame, keys: list[str], total: str, x: str, parts: int = PARTS, tolerance: float = 0.4) -> DataFrame:
    """``cards`` with bounds: 0, the dividers in order, and the total.

    Each divider is guessed one equal step after the divider chosen before it, and is the nearest line (of the same
    keys, the lower of two as near) within the tolerance, a share of the step; without such a line it is the guess,
    rounded half to even. Keys are distinct in ``cards`` and null keys have no lines. Each step is a join
    on the keys whose rows are reduced to one before they are shuffled; no card's lines come together.
    """
    step = F.col(total).cast("double") / parts
    found = cards.withColumn("_step", step).withColumn("_last", F.lit(0).cast("double")).withColumn("bounds", F.array(F.lit(0).cast("long")))
    near = lines.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(x).cast("long").alias("_x"))
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    for _ in range(parts - 1):
        guess = F.col("_last") + F.col("_step")
        off = F.abs(F.col("_x") - F.col("_guess"))
        asked = found.select(*keys, guess.alias("_guess"), (F.col("_step") * tolerance).alias("_far"))
        best = asked.join(near, on).where(off <= F.col("_far")).groupBy(*keys).agg(F.min(F.struct(off.alias("off"), F.col("_x").alias("x"))).alias("_best"))
        found = found.join(best, keys, "left").withColumn("_last", F.coalesce(F.col("_best.x"), F.bround(guess).cast("long")).cast("double"))
        found = found.withColumn("bounds", F.concat("bounds", F.array(F.col("_last").cast("long")))).drop("_best")
    return found.withColumn("bounds", F.concat("bounds", F.array(F.col(total).cast("long")))).drop("_step", "_last")


def _lattice(start: Column, pitch: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS)), lambda k: (start + F.bround(pitch * k)).cast("long"))


def _best(lattices: Column, bottom: Column, score: Callable[[Column], Column]) -> Column:
    """(score, lattice) of the first of the best among those within the band; null if there is none."""
    inside = F.filter(lattices, lambda b: F.element_at(b, PARTS + 1) <= bottom + BEYOND)
    rated = F.transform(inside, lambda b, i: F.struct(score(b).alias("score"), (-i).alias("place"), b.alias("lattice")))
    # the lattice itself is not compared: of two with one score the places differ
    return F.array_max(F.filter(rated, lambda r: r["score"].isNotNull()))


def better_lattice(
    cards: DataFrame, top: str, bottom: str, lattice: str, base: str, probe: Callable[[Column], Column], score: Callable[[Column], Column]
) -> DataFrame:
    """``cards`` with found: a clearly better lattice (six bounds) than the one they have, or null.

    First all pitches and starts of a family that the band between ``top`` and ``bottom`` suggests are rated by ``probe``,
    then the best of them with its neighbours, and the card's own lattice, by ``score``. The best is taken if it
    scores at least GOOD and is above ``base`` by more than BETTER. Both functions take an array of bounds and give a
    column over the card's row, null for a lattice that can't be rated. All of it is one projection.
    """
    pitch = F.greatest(F.lit(40.0), (F.col(bottom) - F.col(top)) / float(PARTS))
    pitches = F.array_sort(F.array_distinct(F.array(*[F.bround(pitch * f) for f in PITCHES])))
    starts = F.array_sort(F.array_distinct(F.array(*[F.bround(F.col(top) + pitch * o) for o in STARTS])))
    family = F.flatten(F.transform(pitches, lambda p: F.transform(starts, lambda s: _lattice(s, p))))
    rows = cards.withColumn("_probe", _best(family, F.col(bottom), probe)["lattice"])
    s, p = F.get("_probe", F.lit(0)), F.get("_probe", F.lit(1)) - F.get("_probe", F.lit(0))
    near_p = F.array_sort(F.array_distinct(F.array(p, F.greatest(p - 3, F.bround(p * 0.94).cast("long")), F.least(p + 3, F.bround(p * 1.06).cast("long")))))
    near = F.flatten(F.transform(near_p, lambda a: F.transform(F.array(s - 6, s, s + 6), lambda b: _lattice(b, a))))
    rows = rows.withColumn("_near", F.concat(F.array(F.col(lattice).cast("array<long>")), near))
    rows = rows.withColumn("_best", F.when(F.col("_probe").isNotNull(), _best(F.col("_near"), F.col(bottom), score)))
    taken = (F.col("_best.score") >= GOOD) & (F.col("_best.score") > F.col(base) + BETTER)
    return rows.withColumn("found", F.when(taken, F.col("_best.lattice"))).drop("_probe", "_near", "_best")


def valleys(rows: DataFrame, keys: list[str], pos: str, v: str) -> DataFrame:
    """(keys, valley): where a profile that looks like two fused signs is to be cut; keys without a valley give no row.

    ``rows`` has every place of a profile, from 0 on. The valley is the lowest place (the first of ties) in the middle
    half that has at most EMPTY of the maximum, if the REACH places before it or those after it have FLANK of the
    maximum in all; fewer than REACH places before it count as nothing.
    """
    order, whole = Window.partitionBy(*keys).orderBy(pos), Window.partitionBy(*keys)
    before = F.when(F.col(pos) >= REACH, F.coalesce(F.sum(v).over(order.rowsBetween(-REACH, -1)), F.lit(0))).otherwise(0)
    after = F.coalesce(F.sum(v).over(order.rowsBetween(1, REACH)), F.lit(0))
    rows = rows.withColumns({"_most": F.max(v).over(whole), "_wide": F.count(F.lit(1)).over(whole), "_before": before, "_after": after})
    middle = (F.col(pos) > F.floor(F.col("_wide") * 0.25)) & (F.col(pos) < F.floor(F.col("_wide") * 0.75))
    flanked = (F.col("_before") >= F.col("_most") * FLANK) | (F.col("_after") >= F.col("_most") * FLANK)
    low = (F.col("_most") > 0) & (F.col(v) <= F.col("_most") * EMPTY)
    return rows.where(middle & flanked & low).groupBy(*keys).agg(F.min(F.struct(v, pos))[pos].alias("valley"))
