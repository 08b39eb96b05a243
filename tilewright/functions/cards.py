"""Grids as arrays of 25 numbers, row by row: seeded random ones, and the position at which each cell is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import LETTERS, WIDTH
from .patterns import CELLS, FREE_BIT, NEVER, SIDE


def random_grid(card: Column, seed: str) -> Column:
    """Five different numbers of each column's range, in the order of their hashes with the card and seed; the free cell is 0."""

    def column(c: int) -> Column:
        numbers = F.sequence(F.lit(c * WIDTH + 1), F.lit(c * WIDTH + WIDTH))
        drawn = F.sort_array(F.transform(numbers, lambda n: F.struct(F.md5(F.concat_ws("-", F.lit(seed), card, n)).alias("h"), n.alias("n"))))
        return F.slice(drawn["n"], 1, SIDE)

    columns = F.array(*[column(c) for c in range(len(LETTERS))])
    places = F.sequence(F.lit(1), F.lit(SIDE))
    turn = lambda held: F.flatten(F.transform(places, lambda r: F.transform(held, lambda x: F.element_at(x, r))))
    by_row = F.element_at(F.transform(F.array(columns), turn), 1)  # the columns are drawn once, outside the loop over rows
    return F.transform(by_row, lambda n, i: F.when(i == FREE_BIT, 0).otherwise(n))


def call_positions(grid: Column, calls: list[int]) -> list[Column]:
    """For each cell the 1-based position of its number among ``calls``: the free cell 0, a number never called NEVER."""
    at: dict[int, int] = {}
    for i, n in enumerate(calls, 1):
        at.setdefault(n, i)
    table = F.array(*[F.lit(at.get(n, NEVER)).cast("long") for n in range(1, WIDTH * len(LETTERS) + 1)])
    return [F.lit(0).cast("long") if i == FREE_BIT else F.element_at(table, F.element_at(grid, i + 1)) for i in range(CELLS)]


def mismatches(a: Column, b: Column) -> Column:
    """How many cells of two grids differ; nulls equal nulls."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
