"""A game's rounds: which calls count, what the game's status is, and what a client that comes back is told.

Messages are (game, time, seq, kind, cell) with the kinds ``setup``, ``start``, ``over`` and ``call``. A setup
begins a new round and forgets the calls of the one before; a call counts in a started game unless its cell was
called before in the round. The stream and the table form give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running
from .ordered import InOrder, in_order

#: What a message of a kind makes of the game, and why a call is turned away in a state.
STATUS = {"setup": "setup", "start": "in_progress", "over": "game_over"}
REASONS = {"none": "no_game", "setup": "not_started", "game_over": "over"}

_OUT = "long, seq long, round long, reason string, called long"


class _Rounds(InOrder):
    """State per game: its status, round, number of counted calls and the last of them; and the cells called in the round."""

    def open(self) -> None:
        self.game = self.handle.getValueState("game", "status string, round long, called long, current long")
        self.cells = self.handle.getMapState("cells", "cell long", "seq long")

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        status, number, called, current = self.game.get() if self.game.exists() else ("none", 0, 0, None)
        cells, fresh, out = {k[0] for k in self.cells.keys()} if self.cells.exists() else set(), {}, []
        for _, seq, kind, cell in rows:
            if kind == "call":
                reason = REASONS.get(status) or ("repeat" if cell in cells else None)
                if reason is None:
                    cells.add(cell)
                    fresh[cell] = seq
                    called, current = called + 1, seq
                out.append((seq, number, reason, called))
            elif kind in STATUS:
                status = STATUS[kind]
                if kind == "setup":
                    number, called, current = number + 1, 0, None
                    cells, fresh = set(), {}
                    self.cells.clear()
        for cell, seq in fresh.items():
            self.cells.updateValue((cell,), (seq,))
        self.game.update((status, number, called, current))
        return out


def call_verdicts(messages: DataFrame, game: str, ts: str, seq: str, delay: str = "0 seconds") -> DataFrame:
    """(game, seq, round, reason, called) of each call: null if it counts, and the calls that count in the round up to it.

    ``messages`` also has kind and cell (whole numbers; all null cells are one). Reasons are ``no_game``,
    ``not_started``, ``over`` and ``repeat``. Unknown kinds change nothing. Rows without a game, time or seq are
    left out. As a stream, a call comes out once the watermark has passed it, and a game's state is its cells of
    the present round.
    """
    rows = messages.select(F.col(game).cast("long").alias(game), F.col(ts).cast("timestamp").alias("_ts"), F.col(seq).cast("long").alias("seq"), "kind", F.coalesce(F.col("cell").cast("long"), F.lit(-1)).alias("cell"))
    if messages.isStreaming:
        processor = _Rounds("us long, seq long, kind string, cell long", [game, "seq", "round", "reason", "called"])
        return in_order(rows, game, "_ts", "seq", ["kind", "cell"], processor, f"{game} {_OUT}", delay)
    rows = _placed(rows.dropna(subset=[game, "_ts", "seq"]), game)
    rows = running(_counted(rows, game), [game, "round"], ["_ts", "seq"], {"called": F.col("counts").cast("long")})
    return rows.where("kind = 'call'").select(game, "seq", "round", "reason", "called")


def _placed(rows: DataFrame, game: str) -> DataFrame:
    """Adds the status and round that each message meets; a setup is of the round that it begins."""
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    setup = (F.col("kind") == "setup").cast("long")
    found = running(rows, [game], ["_ts", "seq"], {"round": setup}, {"status": F.try_element_at(names, F.col("kind"))}, before=True)
    return found.fillna("none", ["status"]).withColumn("round", F.col("round") + F.coalesce(setup, F.lit(0)))


def _counted(rows: DataFrame, game: str) -> DataFrame:
    """Adds reason, and counts: whether a message is a call that counts, as the first of its cell in its round."""
    taken = F.coalesce((F.col("kind") == "call") & (F.col("status") == "in_progress"), F.lit(False))
    first = rows.where(taken).groupBy(game, "round", "cell").agg(F.min(F.struct("_ts", "seq")).alias("_first"))
    told = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    again = F.when(F.struct("_ts", "seq") > F.col("_first"), "repeat")
    rows = rows.join(first, [game, "round", "cell"], "left").withColumn("reason", F.when(taken, again).otherwise(F.try_element_at(told, F.col("status"))))
    return rows.withColumn("counts", taken & F.col("reason").isNull()).drop("_first")


def game_status(messages: DataFrame, game: str, ts: str, seq: str) -> DataFrame:
    """(game, status, round, called, current) of each game at the end of a table: what a client that comes back is told."""
    rows = messages.select(F.col(game).cast("long").alias(game), F.col(ts).cast("timestamp").alias("_ts"), F.col(seq).cast("long").alias("seq"), "kind", F.coalesce(F.col("cell").cast("long"), F.lit(-1)).alias("cell"))
    rows = _counted(_placed(rows.dropna(subset=[game, "_ts", "seq"]), game), game)
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    last = F.struct("_ts", "seq")
    change = F.try_element_at(names, F.col("kind"))
    ends = rows.groupBy(game, "round").agg(
        F.max_by(change, F.when(change.isNotNull(), last)).alias("status"), F.count_if("counts").alias("called"), F.max_by("seq", F.when(F.col("counts"), last)).alias("current")
    )
    newest = ends.groupBy(game).agg(F.max_by(F.struct("status", "round", "called", "current"), "round").alias("_e"))
    return newest.select(game, F.coalesce("_e.status", F.lit("none")).alias("status"), "_e.round", "_e.called", "_e.current")


def running_status(spark: SparkSession, checkpoint: str, game: str) -> DataFrame:
    """(game, status, round, called, current, cells) from the state of a running (or stopped) stream of ``call_verdicts``.

    Read from the checkpoint by Spark's state source, without a word to the stream: the state after its last
    finished micro-batch. ``cells`` are the cells called in the round, ascending.
    """
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    games = read("game").select(F.col(f"key.{game}").alias(game), "value.*")
    cells = read("cells").groupBy(F.col(f"key.{game}").alias(game)).agg(F.array_sort(F.collect_list("user_map_key.cell")).alias("cells"))
    return games.join(cells, game, "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<long>")))
