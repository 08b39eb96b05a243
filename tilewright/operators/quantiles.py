"""Exact quantiles of groups by counting: neither are values sorted nor do a group's values come together in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import are_few, join_few, settled

#: Parts into which the range of a rank is cut at each step, and rows of a range whose values are then put in order.
PARTS, FEW = 4_096, 50_000
_MOST = 1.7976931348623157e308


def exact(rows: DataFrame, keys: list[str], x: str, shares: list[float]) -> DataFrame:
    """(keys, i, value): for each group its quantile at shares[i], between neighbouring values by linear interpolation.

    Null and NaN are left out, infinite values count as the largest finite ones; a group without values gives
    no rows, and a null key is a group like others. Each rank that is asked for has a range, at first its
    group's; a step counts the rows in equal parts of it and goes on with the part that holds the rank, from its least to
    its greatest value, until that is one value or holds few rows. So outliers cost another step, not a large
    task, and what is shuffled is one row for each part and task.
    """
    held = rows.select(*keys, F.col(x).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    held = held.withColumn("_x", F.greatest(F.least("_x", F.lit(_MOST)), F.lit(-_MOST)))
    ends = held.groupBy(*keys).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count(F.lit(1)).alias("_n"))
    at = F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("i", "_share")
    asked = ends.select("*", at).withColumn("_rank", (F.col("_n") - 1) * F.col("_share"))
    asked = settled(asked.select(*keys, "i", "_rank", F.explode(F.array_distinct(F.array(F.floor("_rank"), F.ceil("_rank")))).alias("_at"), "_low", "_high", "_n"))
    ranks = settled(asked.select(*keys, "_at", "_low", "_high", "_n", F.lit(0).cast("long").alias("_before")).distinct())
    done = None
    while True:
        is_open = (F.col("_n") > FEW) & (F.col("_high") > F.col("_low"))
        closed = ranks.where(~is_open)
        done = closed if done is None else done.unionByName(closed)
        still = ranks.where(is_open)
        if hasattr(ranks, "_few_rows"):
            more = any(r["_n"] > FEW and r["_high"] > r["_low"] for r in ranks._few_rows)
        else:
            more = bool(still.limit(1).count())
        if not more:
            break
        ranks = settled(_narrowed(held, still, keys, ranks))
    ranges = are_few(done.select(*keys, "_low", "_high", "_before").distinct(), asked)
    inside = _inside(held, ranges, keys).groupBy(*keys, "_low", "_before", "_x").agg(F.count(F.lit(1)).alias("_k"))
    running = Window.partitionBy(*keys, "_low", "_before").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("_upto", F.col("_before") + F.sum("_k").over(running))
    # A rank's value is the least one that the running count passes.
    values = _ranked(done, placed.select(*keys, "_low", "_before", "_x", "_k", "_upto"), keys).select(*keys, "_at", "_x")
    found = _same(asked.select(*keys, "i", "_rank", "_at"), values, [*keys, "_at"])
    low, high, rank = F.min("_x"), F.max("_x"), F.first("_rank")
    return found.groupBy(*keys, "i").agg((low + (high - low) * (rank - F.floor(rank))).alias("value"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Joins on keys, null with null."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]).drop(*[f"_r_{k}" for k in keys])


def _inside(held: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The values with the range that each lies in; a group's ranges don't overlap."""
    return join_few(held, ranges, keys).where((F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high")))


def _ranked(ranks: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """Each rank with the row of its range, among those with running counts, that holds it."""
    rows = _same(ranks.select(*keys, "_at", "_low", "_before"), placed, [*keys, "_low", "_before"])
    return rows.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_k") <= F.col("_at")))


def _part() -> Column:
    """The part of its range in which a value lies; halves, so that a range of all numbers does not overflow."""
    half = lambda c: F.col(c) * 0.5
    return F.least(F.floor((half("_x") - half("_low")) / (half("_high") - half("_low")) * PARTS), F.lit(PARTS - 1))


def _narrowed(held: DataFrame, ranks: DataFrame, keys: list[str], of: DataFrame) -> DataFrame:
    """Each open rank with the part of its range that holds it."""
    ranges = are_few(ranks.select(*keys, "_low", "_high", "_before").distinct(), of)
    parts = _inside(held, ranges, keys).groupBy(*keys, "_low", "_before", _part().alias("_part")).agg(
        F.count(F.lit(1)).alias("_k"), F.min("_x").alias("_least"), F.max("_x").alias("_greatest")
    )
    running = Window.partitionBy(*keys, "_low", "_before").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("_upto", F.col("_before") + F.sum("_k").over(running)).drop("_part")
    found = _ranked(ranks, placed, keys)
    return found.select(*keys, "_at", F.col("_least").alias("_low"), F.col("_greatest").alias("_high"), F.col("_k").alias("_n"), (F.col("_upto") - F.col("_k")).alias("_before"))
