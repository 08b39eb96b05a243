"""Runs, clusters and sessions on ordered values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, keys: list[str], pos: str, least: int = 1) -> DataFrame:
    """(keys, start, end, n): maximal runs of consecutive positions of at least ``least``; positions must be distinct."""
    order = Window.partitionBy(*keys).orderBy(pos)
    island = F.col(pos) - F.row_number().over(order)
    out = rows.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min(pos).alias("run_start"), F.max(pos).alias("run_end"), F.count(F.lit(1)).alias("n")
    )
    return out.where(F.col("n") >= least).drop("_island")


def clustered(rows: DataFrame, keys: list[str], x: str, new: Column) -> DataFrame:
    """Adds _cluster: counted up at each row for which ``new`` (of _gap, the step from the row before) holds; rows without a value come last."""
    order = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    gaps = rows.withColumn("_gap", F.col(x) - F.lag(x).over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return gaps.withColumn("_cluster", F.sum(F.when(new, 1).otherwise(0)).over(upto))


def clusters_by_gap(rows: DataFrame, keys: list[str], x: str, tolerance: int, support: int = 1) -> DataFrame:
    """(keys, center, n): values whose steps are at most ``tolerance`` are one cluster; its mean is truncated. Null values count in a key's last cluster."""
    out = clustered(rows, keys, x, F.col("_gap") > tolerance).groupBy(*keys, "_cluster").agg(
        F.expr(f"cast(sum({x}) div count(*) as bigint)").alias("center"), F.count(F.lit(1)).alias("n")
    )
    return out.where(F.col("n") >= support).drop("_cluster")


def merged_runs(rows: DataFrame, keys: list[str], pos: str, least: int, gap: int) -> DataFrame:
    """(keys, run_start, run_end): runs of at least ``least``, those less than ``gap`` apart joined if nothing at all lies between."""
    order = Window.partitionBy(*keys).orderBy("run_start")
    long = F.col("n") >= least
    step = F.col("run_start") - F.lag("run_end").over(order)
    new = ~F.coalesce(F.lag(long).over(order) & (step < gap), F.lit(False))
    every = runs(rows, keys, pos).withColumn("_new", new).where(long)  # shorter runs have been seen by their neighbours
    joined = every.withColumn("_k", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*keys, "_k").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end")).drop("_k")


def longest_run(flags: Column) -> Column:
    """The length of an array's longest run of true values; 0 for an empty one."""
    step = lambda s, x: F.struct(
        F.when(F.coalesce(x, F.lit(False)), s["now"] + 1).otherwise(0).alias("now"),
        F.greatest(s["best"], F.when(F.coalesce(x, F.lit(False)), s["now"] + 1).otherwise(0)).alias("best"),
    )
    return F.aggregate(flags, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda s: s["best"])


def even_chains(rows: DataFrame, keys: list[str], y: str) -> DataFrame:
    """(keys, first, last, n): lines grouped into cards, and of each card its longest chain of evenly spaced lines.

    Lines that are more than 1.7 median gaps apart are of different cards. A chain's gaps are from 0.55 to
    1.6 median gaps; of equal chains the first counts. Chains of one line, and those whose own median gap
    is not within 0.7 to 1.3 of the median, are left out, as are keys with a median gap of 0. A key holds
    one image's lines, so that its medians are exact.
    """
    order = Window.partitionBy(*keys).orderBy("_y")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    gaps = rows.select(*keys, F.col(y).cast("double").alias("_y")).withColumn("_gap", F.col("_y") - F.lag("_y").over(order))
    gaps = gaps.withColumn("_med", F.median("_gap").over(Window.partitionBy(*keys))).where("_med > 0")
    far = F.coalesce(F.col("_gap") > 1.7 * F.col("_med"), F.lit(True))
    uneven = ~F.coalesce(F.col("_gap").between(0.55 * F.col("_med"), 1.6 * F.col("_med")), F.lit(False))
    named = gaps.withColumn("_card", F.sum(F.when(far, 1).otherwise(0)).over(upto))
    named = named.withColumn("_chain", F.sum(F.when(far | uneven, 1).otherwise(0)).over(upto)).withColumn("_inner", F.when(~(far | uneven), F.col("_gap")))
    chains = named.groupBy(*keys, "_card", "_chain").agg(
        F.min("_y").alias("first"), F.max("_y").alias("last"), F.count(F.lit(1)).alias("n"), F.median("_inner").alias("_pitch"), F.first("_med").alias("_med")
    )
    best = chains.groupBy(*keys, "_card").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "first", "last", "_pitch", "_med")).alias("x"))
    fits = (F.col("x.n") >= 2) & F.col("x._pitch").between(0.7 * F.col("x._med"), 1.3 * F.col("x._med"))
    return best.where(fits).select(*keys, "x.first", "x.last", "x.n")


def sheet_structure(bands: Column, img_height: Column | None = None) -> Column:
    """(score, ok) of the header bands (top, bottom) found on an image.

    One band is a single card, unless it is higher than half the image. Three are a sheet if their bottoms
    are evenly spaced (the steps differ by 0.28 of the larger at most) and none is lower than 0.45 of the
    highest. Any other number is not.
    """
    heights = F.transform(bands, lambda b: (b["bottom"] - b["top"]).cast("double"))
    ends = F.array_sort(F.transform(bands, lambda b: b["bottom"].cast("double")))
    one, two = F.get(ends, F.lit(1)) - F.get(ends, F.lit(0)), F.get(ends, F.lit(2)) - F.get(ends, F.lit(1))
    low, high = F.array_min(heights), F.array_max(heights)
    even = (one > 0) & (F.greatest(one, two) - F.least(one, two) <= 0.28 * F.greatest(one, two)) & (low >= 0.45 * high)
    n = F.size(bands)
    whole = F.coalesce(high > 0.5 * img_height, F.lit(False)) if img_height is not None else F.lit(False)
    score = F.when(n == 1, F.when(whole, 0.0).otherwise(10.0)).when((n == 3) & even, 1000.0 + low / high).otherwise(F.greatest(n, F.lit(0)).cast("double"))
    ok = F.coalesce(((n == 1) & ~whole) | ((n == 3) & even), F.lit(False))
    return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), ok.alias("ok"))
