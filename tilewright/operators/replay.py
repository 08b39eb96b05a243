"""Replay of ordered calls over grids: marks, first wins, winners per call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import CELLS, FREE_BIT, first_hold, holds


def grid_marks(cells: DataFrame, key: str, bit: Column) -> DataFrame:
    """(key, marked): each key's marked cells as a bitmask, the free cell included."""
    one = F.call_function("shiftleft", F.lit(1), bit.cast("int"))
    return cells.groupBy(key).agg(F.bit_or(one).bitwiseOR(F.lit(1 << FREE_BIT)).alias("marked"))


def win_sequence(calls: DataFrame, key: str, bit: Column, order: list[str], pattern) -> DataFrame:
    """(key, win_seq): the number of the call, in the given order, at which a pattern first holds, for keys that win.

    No window: each cell's first call is a minimum, the pattern's is one of these, and its number a count of
    the calls up to it. A pattern with AtMost holds in spans between such minima, and the first call within one
    is taken. Both aggregations combine before they shuffle; the join's hot keys can be split.
    """
    at = F.struct(*order)
    rows = calls.select(key, bit.alias("_bit"), F.struct(F.lit(1).alias("_k"), at.alias("_at")).alias("_p"))
    kind = rows.schema["_p"].dataType
    start, never = (F.struct(F.lit(k).alias("_k"), F.lit(None).cast(kind["_at"].dataType).alias("_at")) for k in (0, 2))
    firsts = [F.coalesce(F.min(F.when(F.col("_bit") == i, F.col("_p"))), never).alias(f"c{i}") for i in range(CELLS)]
    firsts[FREE_BIT] = start.alias(f"c{FREE_BIT}")
    held = rows.groupBy(key).agg(*firsts, F.min("_p").alias("_first"))
    # the first call of all is never before the start, so a pattern that holds from there on wins by that call
    won = held.select(key, first_hold(pattern, [F.col(f"c{i}") for i in range(CELLS)], F.col("_first"), start, never).alias("_won")).where("_won._k = 1")
    upto = rows.join(won, key).where(F.col("_p") <= F.col("_won"))
    return upto.groupBy(key).agg(F.count(F.lit(1)).alias("win_seq"))


def replayed(calls: DataFrame, key: str, bit: Column, seq: Column, pattern) -> DataFrame:
    """Each call with the marks after it, whether its cell is a new one, and whether the pattern holds: for patterns that can stop holding."""
    order = Window.partitionBy(key).orderBy("_seq")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumn("_seq", seq)
    one = F.call_function("shiftleft", F.lit(1), bit.cast("int"))
    rows = rows.withColumn("marked", F.bit_or(one).over(running).bitwiseOR(F.lit(1 << FREE_BIT)))
    before = F.coalesce(F.lag("marked").over(order), F.lit(1 << FREE_BIT))
    return rows.withColumn("fresh", before.bitwiseAND(one) == 0).withColumn("won", holds(pattern, F.col("marked")))


def winner_lists(cards: DataFrame, calls: list[int]) -> DataFrame:
    """(game, call, number, fresh, winners) at each call of a number not called before, if any card then holds the pattern.

    ``cards`` has game, card and won, the 1-based call at which the card's pattern first holds (0: before
    any call). fresh are the cards that win by this call, in order; winners how many hold the pattern after it,
    those of earlier calls included. A repeated call announces nothing. Cards are counted by game and call
    first; a call's list is as long as what is announced.
    """
    first: dict[int, int] = {}
    for at, number in enumerate(calls, 1):
        first.setdefault(number, at)
    told = F.array(*[F.struct(F.lit(at).alias("call"), F.lit(number).alias("number")) for number, at in first.items()])
    # exploding what the filter leaves of one value keeps a costly ``won`` from being computed again for the filter
    inside = F.transform(F.filter(F.array("won"), lambda w: (w >= 0) & (w <= len(calls))), lambda w: w.cast("int"))
    by_call = cards.select("game", "card", F.explode(inside).alias("call")).groupBy("game", "call").agg(
        F.array_sort(F.collect_list("card")).alias("fresh")
    )
    order = Window.partitionBy("game").orderBy("call")
    total = F.sum(F.size("fresh")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = by_call.select("game", F.col("call").alias("_own"), "fresh", total.cast("int").alias("winners"), F.lead("call").over(order).alias("_next"))
    until = F.coalesce("_next", F.lit(len(calls) + 1))
    spread = rows.select("*", F.explode(F.filter(told, lambda t: (t["call"] >= F.col("_own")) & (t["call"] < until))).alias("t"))
    none = F.array().cast(by_call.schema["fresh"].dataType)
    return spread.select("game", "t.call", "t.number", F.when(F.col("t.call") == F.col("_own"), F.col("fresh")).otherwise(none).alias("fresh"), "winners")


def winner_rows(cards: DataFrame, calls: list[int]) -> tuple[DataFrame, DataFrame]:
    """What ``winner_lists`` announces, as rows: the cards that win by a call, and the counts of each call.

    The first has the columns of ``cards`` (game, card, won, and any others, such as the player) with call and number: one row
    for each card that wins at all. The second is (game, call, number, fresh, winners), with a row for each call
    of a new number after which some card holds the pattern. No game's cards come together.
    """
    first: dict[int, int] = {}
    for at, number in enumerate(calls, 1):
        first.setdefault(number, at)
    told = F.array(*[F.struct(F.lit(at).alias("call"), F.lit(number).alias("number")) for number, at in first.items()])
    numbers = F.array(F.lit(None).cast("int"), *[F.lit(n) for n in calls])  # by call, from 0 on
    # exploding what the filter leaves of one value keeps a costly ``won`` from being computed again for the filter
    inside = F.transform(F.filter(F.array("won"), lambda w: (w >= 0) & (w <= len(calls))), lambda w: w.cast("int"))
    won = cards.withColumn("call", F.explode(inside)).withColumn("number", F.get(numbers, F.col("call")))
    counts = won.groupBy("game", "call").agg(F.count(F.lit(1)).alias("fresh"))
    order = Window.partitionBy("game").orderBy("call")  # a row for each call of a game
    rows = counts.select("game", F.col("call").alias("_own"), "fresh", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("winners"), F.lead("call").over(order).alias("_next"))
    until = F.coalesce("_next", F.lit(len(calls) + 1))
    spread = rows.select("*", F.explode(F.filter(told, lambda t: (t["call"] >= F.col("_own")) & (t["call"] < until))).alias("t"))
    fresh = F.when(F.col("t.call") == F.col("_own"), F.col("fresh")).otherwise(0)
    return won, spread.select("game", "t.call", "t.number", fresh.alias("fresh"), "winners")


def first_calls(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first call of each key; later ones are repeats. A minimum over structs, so no sort by key."""
    rest = [c for c in calls.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_f")
    return calls.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in [*order, *rest]])
