"""Points of the plane as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A scale nearer to 0 than this puts a point at infinity (the step of doubles at 1).
LEAST_SCALE = 2.0**-52


def projected(h: Column, x: Column, y: Column) -> Column:
    """The point (x, y) under a homography, as a struct of doubles x and y.

    ``h`` is an array of nine numbers, the rows of the 3 x 3 matrix. A point that goes to infinity becomes
    (0, 0); a null coordinate or a shorter array gives null coordinates.
    """
    row = lambda i: F.get(h, F.lit(3 * i)) * x + F.get(h, F.lit(3 * i + 1)) * y + F.get(h, F.lit(3 * i + 2))
    scale = row(2)
    part = lambda i: F.when(F.abs(scale) > LEAST_SCALE, row(i) / scale).when(scale.isNotNull(), F.lit(0.0))
    return F.struct(part(0).alias("x"), part(1).alias("y"))


def line_at(x: Column, y: Column, to_x: Column, to_y: Column, at: Column) -> Column:
    """Where the line from (x, y) to (to_x, to_y) has the ordinate ``at``; a level line counts as upright."""
    slope = F.when(to_y != y, (to_x - x) / (to_y - y)).when(to_y == y, F.lit(0.0))
    return x + slope * (at - y)


def completed_lines(lines: Column, count: int = 6) -> Column:
    """Exactly ``count`` lines of a lattice: sorted lines, continued by the median gap, which is rounded half to even.

    A first gap below 0.7 of the median shows a header's edge, so the first of three or more lines is left
    out then. Lines beyond ``count`` are cut. Null for fewer than two lines, a gap that is not positive, or nulls.
    """
    n = F.size(lines)
    gaps = F.zip_with(F.slice(lines, F.lit(2), n - 1), F.slice(lines, F.lit(1), n - 1), lambda b, a: b - a)
    known = F.when((n > 1) & F.forall(lines, lambda x: x.isNotNull()), gaps)
    ranked = F.array_sort(known)
    pitch = (F.get(ranked, F.floor((n - 2) / 2).cast("int")) + F.get(ranked, F.floor((n - 1) / 2).cast("int"))) / 2
    first = F.when((n > 2) & (F.get(known, F.lit(0)) < pitch * 0.7), 2).otherwise(1)
    more = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.element_at(lines, -1) + k * F.bround(pitch))
    return F.when(pitch > 0, F.slice(F.concat(F.slice(lines, first, n), more), 1, count))
