"""A game's whole state as JSON and as tables: games, players, cards and waiters.

Fields that are missing get the defaults that a restart gives them; broken texts are kept apart. ``state_texts`` is the way
back, so that what was restored can be saved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.patterns import CELLS, FREE_BIT, SIDE
from .store import STATES, restored

_CARD = "struct<card_id: string, player_id: string, grid: array<array<string>>, marked: array<array<boolean>>>"
_STATE = (
    "game_id string, status string, called_numbers array<string>, current_number string, winning_pattern_name string, last_activity string, "
    f"waiting_room map<string, struct<display_name: string>>, players map<string, struct<player_id: string, display_name: string, connected_at: string, cards: array<{_CARD}>>>"
)


def _rows_of(values: list, kind: str) -> Column:
    return F.array(*[F.array(*[F.lit(v).cast(kind) for v in values[i : i + SIDE]]) for i in range(0, CELLS, SIDE)])


def restored_state(rows: DataFrame, key: str, text: str, patterns: list[str], now: Column) -> dict[str, DataFrame]:
    """``games``, ``players``, ``cards`` and ``waiters`` of each row's JSON text, and the ``broken`` rows; all with the row's ``key``.

    games: key, game_id (missing: empty), status (missing or unknown: the first of STATES), called_numbers (missing:
    none), current_number, winning_pattern_name, wins (the name is among ``patterns``), last_activity (missing or
    unreadable: ``now``). players: key, player_id (missing: its name in the JSON), display_name (missing: empty), connected
    (false: nobody is, after a restart), connected_at (unreadable: null). cards: key, player_id, place (1, 2, ... within
    the player), card_id (missing: named by game, player and place), grid (missing: zeros), marked (missing: the free
    cell). waiters: key, pending_id, display_name. Each row is read once for each table that is used.
    """
    good, broken = restored(rows.select(F.col(key).alias("key"), F.col(text).alias("_text")), "_text", StructType.fromDDL(_STATE), {"game_id": ""})
    status = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise(STATES[0])
    seen = F.coalesce(F.col("last_activity").try_cast("timestamp_ntz"), now)
    games = good.select(
        "key", "game_id", status.alias("status"), F.coalesce("called_numbers", F.array().cast("array<string>")).alias("called_numbers"), "current_number",
        "winning_pattern_name", F.coalesce(F.col("winning_pattern_name").isin(*patterns), F.lit(False)).alias("wins"), seen.alias("last_activity"),
    )
    each = good.select("key", F.explode("players").alias("_name", "_p"))
    named = each.select("key", F.coalesce("_p.player_id", "_name").alias("player_id"), "_p")
    players = named.select(
        "key", "player_id", F.coalesce("_p.display_name", F.lit("")).alias("display_name"), F.lit(False).alias("connected"),
        F.col("_p.connected_at").try_cast("timestamp_ntz").alias("connected_at"),
    )
    held = named.select("key", "player_id", F.posexplode("_p.cards").alias("_at", "_c"))
    place = F.col("_at") + 1
    grid, marked = F.col("_c.grid"), F.col("_c.marked")
    cards = held.select(
        "key", F.coalesce("_c.player_id", "player_id").alias("player_id"), place.alias("place"),
        F.coalesce("_c.card_id", F.concat_ws("/", F.col("key"), F.col("player_id"), place)).alias("card_id"),
        F.when(F.size(grid) > 0, grid).otherwise(_rows_of([0] * CELLS, "string")).alias("grid"),
        F.when(F.size(marked) > 0, marked).otherwise(_rows_of([i == FREE_BIT for i in range(CELLS)], "boolean")).alias("marked"),
    )
    waiters = good.select("key", F.explode("waiting_room").alias("pending_id", "_w")).select("key", "pending_id", F.coalesce("_w.display_name", F.lit("")).alias("display_name"))
    return {"games": games, "players": players, "cards": cards, "waiters": waiters, "broken": broken.withColumnRenamed("_text", "text")}


def state_texts(parts: dict[str, DataFrame]) -> DataFrame:
    """(key, text): each game's state as one JSON text, with its players by id, their cards by place, and its waiters.

    A game is one value, so its players, cards and waiters meet in one task, and their number must be that of a game.
    """
    card = F.struct("place", "card_id", "player_id", "grid", "marked")
    cards = parts["cards"].groupBy("key", "player_id").agg(F.array_sort(F.collect_list(card)).alias("_c"))
    cards = cards.select("key", "player_id", F.transform("_c", lambda c: c.dropFields("place")).alias("cards"))
    none = F.array().cast(f"array<{_CARD}>")
    at = F.date_format("connected_at", "yyyy-MM-dd'T'HH:mm:ss")
    player = F.struct("player_id", "display_name", at.alias("connected_at"), F.coalesce("cards", none).alias("cards"))
    players = parts["players"].join(cards, ["key", "player_id"], "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("player_id", player))).alias("_p"))
    waiters = parts["waiters"].groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pending_id", F.struct("display_name")))).alias("_w"))
    games = parts["games"].join(players, "key", "left").join(waiters, "key", "left")
    as_map = lambda c: F.map_from_entries(F.coalesce(c, F.array()))
    whole = F.struct(
        "game_id", "status", "called_numbers", "current_number", "winning_pattern_name",
        F.date_format("last_activity", "yyyy-MM-dd'T'HH:mm:ss").alias("last_activity"), as_map("_w").alias("waiting_room"), as_map("_p").alias("players"),
    )
    return games.select("key", F.to_json(whole).alias("text"))


def saved_cards(cards: DataFrame, keys: list[str], calls: DataFrame) -> DataFrame:
    """(keys, grid, marked) of cards as arrays of 25 numbers in rows of five, a cell being marked if its number is among ``calls`` (keys, called) or it is free.

    ``calls`` has one row for each key, with the array of numbers called so far.
    """
    rows = cards.withColumnRenamed("grid", "_grid").join(calls, keys)
    places = F.sequence(F.lit(0), F.lit(SIDE - 1))
    # each array is made once, outside the loop over rows
    five = lambda held: F.element_at(F.transform(F.array(held), lambda h: F.transform(places, lambda r: F.slice(h, r * SIDE + 1, SIDE))), 1)
    marked = F.transform("_grid", lambda n, i: (i == FREE_BIT) | F.array_contains(F.col("called"), n))
    rest = [c for c in cards.columns if c != "grid"]
    return rows.select(*rest, five(F.col("_grid").cast("array<string>")).alias("grid"), five(marked).alias("marked"))
