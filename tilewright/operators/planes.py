"""Cells of planes in long form (keys, y, x): connected components of lit cells, and the variance of second differences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import join_few, settled, written

#: Side of a tile; with the rows around it, it is what one task holds at once.
TILE = 256


def linked(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the links (a, b) reaches; nodes are whole numbers without links to null.

    Alternately each node's larger neighbours are linked to the least of its neighbours and itself, and its smaller ones to the
    least of them, until nothing changes: a number of rounds that grows with the logarithm of the longest way.
    A hot node's links are summed before they are shuffled, and the join back is split by adaptive execution.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = written(small.select("e.u", "e.v").where("u <> v").distinct())
        same = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        edges = small
        if same:
            break
    return nodes.join(edges.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))


def components(cells: DataFrame, keys: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """(keys, first_y, first_x, area, y0, y1, x0, x1): the 8-way components of lit cells, named by their first cell.

    Cells of a line that stand side by side are one run, and runs are what is linked and labelled. Two runs of
    neighbouring lines touch if, for one of them, the other is the first to end no earlier and begins no later than one
    place after it; so each run looks at one run of each neighbouring line. Repeated cells count once; a cell without key, y
    or x is left out.
    """
    lit = cells.select(*keys, F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x")).dropna().distinct()
    place = F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    runs = lit.withColumn("_run", F.col("x") - place).groupBy(*keys, "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")
    runs = written(runs.withColumn("id", F.monotonically_increasing_id()))
    # Each run with its line and the one below (lower), and with its line and the one above.
    pairs = runs.select("*", F.explode(F.array(F.struct(F.col("y").alias("at"), F.lit(False).alias("lower")), F.struct((F.col("y") - 1).alias("at"), F.lit(True).alias("lower")))).alias("_p"))
    pairs = pairs.select(*keys, "_p.at", "_p.lower", "x0", "x1", "id")
    onward = Window.partitionBy(*keys, "at").orderBy(F.desc("x1")).rangeBetween(Window.unboundedPreceding, 0)
    run = F.struct("x1", "x0", "id")
    other = F.when(F.col("lower"), F.min(F.when(~F.col("lower"), run)).over(onward)).otherwise(F.min(F.when(F.col("lower"), run)).over(onward))
    links = pairs.withColumn("_o", other).where(F.col("_o.x0") <= F.col("x1") + 1).select(F.col("id").alias("a"), F.col("_o.id").alias("b"))
    named = runs.join(linked(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = F.min(F.struct("y", "x0"))
    found = named.groupBy(*keys, "root").agg(
        first.alias("_first"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1")
    )
    return found.select(*keys, F.col("_first.y").alias("first_y"), F.col("_first.x0").alias("first_x"), "area", "y0", "y1", "x0", "x1")


def largest(found: DataFrame, keys: list[str]) -> DataFrame:
    """The component of the largest area for each key; of equal ones that with the first cell."""
    rest = [c for c in found.columns if c not in keys]
    order = F.struct(F.col("area"), -F.col("first_y"), -F.col("first_x"))
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_l")).select(*keys, "_l.*")


_PART = "n long, mean double, squares double"


def _tile(keys: list[str], tile: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        ty, tx = table.column("_ty")[0].as_py(), table.column("_tx")[0].as_py()
        y, x = (table.column(c).to_numpy() - t * tile + 1 for c, t in (("y", ty), ("x", tx)))
        plane = np.zeros((tile + 2, tile + 2))
        plane[y, x] = table.column("v").to_numpy()
        inside = (y > 0) & (y <= tile) & (x > 0) & (x <= tile) & table.column("_own").to_numpy(zero_copy_only=False)
        y, x = y[inside], x[inside]
        d = plane[y - 1, x] + plane[y + 1, x] + plane[y, x - 1] + plane[y, x + 1] - 4 * plane[y, x]
        mean = d.mean() if len(d) else 0.0
        own = [table.column(k).slice(0, 1).combine_chunks() for k in keys]
        return pa.table([*own, pa.array([len(d)], pa.int64()), pa.array([mean]), pa.array([((d - mean) ** 2).sum()])], names=[*keys, "n", "mean", "squares"])

    return run


def second_difference_variance(cells: DataFrame, keys: list[str], y: str = "y", x: str = "x", v: str = "v", tile: int = TILE) -> DataFrame:
    """(keys, variance): of the sums of the four neighbours less four times the value, over all cells of each plane.

    A plane has all cells of a rectangle that begins at (0, 0), once each; beyond a border it is its mirror about the
    border's cells. Cells are shuffled once, to their tile and, from a tile's border, to the tiles beside it; a task
    holds one tile at a time, and the tiles' means and squares are summed up. A null value counts as 0; cells
    without key or place are left out.
    """
    held = cells.select(*keys, F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x"), F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias("v")).dropna()
    sides = held.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    rows = join_few(held, settled(sides), keys)

    def mirrored(at: str, n: str):
        """The place itself, and those beyond the borders where the cell stands as well."""
        here, size = F.col(at), F.col(n)
        low = F.when((here == 1) | (size == 1), F.lit(-1).cast("long"))
        high = F.when((here == size - 2) | (size == 1), size)
        return F.filter(F.array(here, low, high), lambda p: p.isNotNull())

    rows = rows.select(*keys, "v", F.explode(mirrored("y", "_h")).alias("y"), "x", "_h", "_w").select(*keys, "v", "y", F.explode(mirrored("x", "_w")).alias("x"), "_h", "_w")
    own = (F.col("y") >= 0) & (F.col("y") < F.col("_h")) & (F.col("x") >= 0) & (F.col("x") < F.col("_w"))
    rows = rows.withColumn("_own", own).drop("_h", "_w")
    tiles = lambda c: F.array_distinct(F.transform(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1), lambda p: F.floor(p / tile)))
    rows = rows.select("*", F.explode(tiles("y")).alias("_ty")).select("*", F.explode(tiles("x")).alias("_tx"))
    kinds = ", ".join(f"`{k}` {held.schema[k].dataType.simpleString()}" for k in keys)
    parts = rows.groupBy(*keys, "_ty", "_tx").applyInArrow(_tile([*keys], tile), f"{kinds}, {_PART}")
    return parts.where("n > 0").groupBy(*keys).agg(_variance().alias("variance"))


def _variance():
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    return F.greatest((F.sum("squares") + F.sum(F.col("n") * F.col("mean") * F.col("mean"))) / n - mean * mean, F.lit(0.0))
