"""Grids as nested arrays of numbers: shape, ranges, labels, and places in lists and images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import LETTERS, WIDTH
from .patterns import FREE_BIT, SIDE


def is_square(grid: Column) -> Column:
    """Whether a grid has five rows of five; a null grid or row has not."""
    return F.coalesce((F.size(grid) == SIDE) & F.forall(grid, lambda r: F.coalesce(F.size(r) == SIDE, F.lit(False))), F.lit(False))


def violations(grid: Column) -> Column:
    """What keeps a square grid from play, as (r, c, value, kind) in order: cells that are ``missing`` or ``out of range``."""

    def cells(row: Column, r: Column) -> Column:
        def cell(v: Column, c: Column) -> Column:
            kind = F.when(r * SIDE + c == FREE_BIT, None).when(v.isNull(), "missing")
            kind = kind.when(~v.between(c * WIDTH + 1, (c + 1) * WIDTH), "out of range")
            return F.struct(r.alias("r"), c.alias("c"), v.alias("value"), kind.alias("kind"))

        return F.transform(row, cell)

    return F.filter(F.flatten(F.transform(grid, cells)), lambda x: x["kind"].isNotNull())


def labelled(grid: Column) -> Column:
    """A playable grid's labels, row by row in one array, FREE in the middle; null for a grid of another shape or with violations."""
    letters = F.array(*map(F.lit, LETTERS))

    def labels(row: Column, r: Column) -> Column:
        free = lambda c: r * SIDE + c == FREE_BIT
        return F.transform(row, lambda v, c: F.when(free(c), "FREE").otherwise(F.concat(F.get(letters, c), v.cast("string"))))

    return F.when(is_square(grid) & (F.size(violations(grid)) == 0), F.flatten(F.transform(grid, labels)))


def by_columns(items: Column) -> Column:
    """24 values column by column (the middle one has four) as 25 row by row, the free cell null; null for another number of values."""
    full = F.concat(F.slice(items, 1, FREE_BIT), F.array(F.lit(None)), F.slice(items, FREE_BIT + 1, SIDE * SIDE))
    places = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    turned = F.transform(places, lambda i: F.get(full, (i % SIDE) * SIDE + F.floor(i / SIDE).cast("int")))
    return F.when(F.size(items) == SIDE * SIDE - 1, turned)


def checked_cell(text: Column, place: Column) -> Column:
    """(value, is_free_space, valid, raw) of a cell's recognised text at a place 0 to 24: digits, and in the column's range."""
    column = place % SIDE
    value = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    free, inside = place == FREE_BIT, value.between(column * WIDTH + 1, (column + 1) * WIDTH)
    return F.struct(
        F.when(~free, value).alias("value"), free.alias("is_free_space"),
        (free | F.coalesce(inside, F.lit(False))).alias("valid"), text.alias("raw"),
    )


def in_wrapped(x: Column, low: Column, high: Column) -> Column:
    """Whether a value on a circle lies from ``low`` up to ``high``, both included, going through the wrap if low is above high."""
    return F.when(low <= high, x.between(low, high)).otherwise((x >= low) | (x <= high))


def scaled_box(box: Column, by_x: Column, by_y: Column) -> Column:
    """A box (x0, y0, x1, y1) times the ratios of two images' sizes, cut to whole numbers."""
    return F.transform(box, lambda v, i: (v * F.when(i % 2 == 0, by_x).otherwise(by_y)).cast("int"))


def cuts(extent: Column, parts: int = SIDE, floor: bool = False) -> Column:
    """Where an extent is cut into equal parts, its ends included; rounded (half to even), or cut down."""
    at = lambda k: k * extent.cast("double") / parts
    return F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda k: (F.floor(at(k)) if floor else F.bround(at(k))).cast("int"))


def cropped(plane: Column, y0: Column, y1: Column, x0: Column, x1: Column, inset: int = 0) -> Column:
    """The rows and columns of a nested array from y0 and x0 up to y1 and x1, without ``inset`` of them on each side; null if nothing is left.

    Bounds are counted from 0 and the upper ones are not included; what lies beyond the array is left out.
    """
    high, wide = y1 - y0 - 2 * inset, x1 - x0 - 2 * inset
    rows = F.transform(F.slice(plane, y0 + inset + 1, F.greatest(high, F.lit(0))), lambda r: F.slice(r, x0 + inset + 1, F.greatest(wide, F.lit(0))))
    return F.when((high > 0) & (wide > 0), rows)
