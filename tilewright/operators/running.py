"""Running sums and last values along each key's rows, also where one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: A key with more rows than this (by a count) is not sorted in one task.
MOST_IN_ONE = 1_000_000


def running(
    rows: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False
) -> DataFrame:
    """Adds, for each name in ``sums``, the sum (0 for nothing), and for each in ``lasts`` the last value that is not null, of the key's
    rows up to this one, or only those ``before`` it.

    ``order`` must leave no ties that matter. A null key is a key like others. If no key has many rows, a window does
    it. Else rows are dealt by ranges of (keys, order), so that a hot key lies in several tasks: a window runs within each range, and what
    a range's first key has before it comes from one row a range, which the driver adds up.
    """
    sums, lasts = sums or {}, lasts or {}
    columns = rows.columns
    if (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= MOST_IN_ONE:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        return rows.select("*", *_within(sums, lasts, window))

    order = [F.col(o) if isinstance(o, str) else o for o in order]
    held = {f"_s_{n}": c for n, c in sums.items()} | {f"_l_{n}": c for n, c in lasts.items()}
    dealt = rows.withColumns(held).repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()))
    whole = Window.partitionBy("_part", *keys).orderBy(*order)
    ends = dealt.withColumn("_nth", F.row_number().over(whole))
    group = [F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums]
    group += [F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.col("_nth"))).alias(f"_l_{n}") for n in lasts]
    key = F.struct(*keys)
    totals = ends.groupBy("_part", *keys).agg(F.lit(1).alias("_one"), *group)
    parts = totals.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(F.struct("_one", *held), key).alias("end"))
    carried = _carried(sorted(parts.collect(), key=lambda p: p["_part"]), keys, list(held))
    fields = [f"_part int", *[f"`_first_{k}` {dealt.schema[k].dataType.simpleString()}" for k in keys], *[f"`_in{h}` {totals.schema[h].dataType.simpleString()}" for h in held]]
    small = F.broadcast(rows.sparkSession.createDataFrame(carried, ", ".join(fields)))  # a row for each range
    window = whole.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = dealt.select("*", *_within({n: F.col(f"_s_{n}") for n in sums}, {n: F.col(f"_l_{n}") for n in lasts}, window)).join(small, "_part")
    goes_on = F.lit(True)
    for k in keys:
        goes_on = goes_on & F.col(k).eqNullSafe(F.col(f"_first_{k}"))
    added = [(F.col(n) + F.coalesce(F.when(goes_on, F.col(f"_in_s_{n}")), F.lit(0))).alias(n) for n in sums]
    added += [F.coalesce(n, F.when(goes_on, F.col(f"_in_l_{n}"))).alias(n) for n in lasts]
    return out.select(*columns, *added)


def _within(sums: dict[str, Column], lasts: dict[str, Column], window) -> list[Column]:
    found = [F.coalesce(F.sum(c).over(window), F.lit(0)).alias(n) for n, c in sums.items()]
    return found + [F.last(c, True).over(window).alias(n) for n, c in lasts.items()]


def _carried(parts: list, keys: list[str], held: list[str]) -> list[tuple]:
    """For each range its first key and what that has in the ranges before."""
    out, key, sofar = [], None, {}
    for part in parts:
        first, last = tuple(part["first"]), tuple(part["last"])
        before = sofar if key == first else {}
        out.append((part["_part"], *first, *[before.get(h) for h in held]))
        sofar = {}
        for h in held:
            own, old = part["end"][h], before.get(h) if first == last else None
            sofar[h] = (own or 0) + (old or 0) if h.startswith("_s_") else old if own is None else own
        key = last
    return out
