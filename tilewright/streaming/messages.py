"""Messages as JSON text: reading, routing by type, and what games keep of them. The same functions work on streams and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.running import running
from ..operators.tables import join_few, settled
from ..sources.deltas import created, names
from .ordered import InOrder, in_order

# The types of messages that are known, with the part of the game that takes them.
ROUTES = {
    "ping": "liveness", "join": "players", "create_game": "games", "submit_number": "calls", "reconnect": "players",
    "leave": "players", "load_test_cards": "cards", "add_scanned_card": "cards", "dispose_cards": "cards",
    "setup_new_game": "games", "start_game": "games", "request_game_status": "games", "game_over": "games",
    "set_winning_pattern": "games", "host_reconnect": "players",
}


def read_messages(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """A stream of the lines of text files that arrive in a folder: one message each, as ``value``."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", most_files).load(folder)


def routed(messages: DataFrame, text: str, fields: StructType) -> DataFrame:
    """Adds type, body (``fields``), route, and reason: why a message is in quarantine, null if it has a route.

    Reasons are ``not json`` (also null, empty, or no object), ``no type`` and ``unknown type``. A message
    is never dropped; take those with a route, and those with a reason, as two outputs.
    """
    schema = StructType([*fields.fields]).add("type", "string").add("_corrupt_record", "string")
    body = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = messages.withColumn("_m", body)
    bad = F.col("_m").isNull() | F.col("_m._corrupt_record").isNotNull() | ~F.coalesce(F.trim(text).startswith("{"), F.lit(False))
    kind = F.when(~bad, F.col("_m.type"))
    route = F.try_element_at(F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair]), kind)
    reason = F.when(bad, "not json").when(kind.isNull(), "no type").when(route.isNull(), "unknown type")
    names = [f.name for f in fields.fields]
    rows = rows.select(*messages.columns, kind.alias("type"), F.struct(*[F.col(f"_m.{n}") for n in names]).alias("body"), route.alias("route"), reason.alias("reason"))
    return rows


def missed_pongs(beats: DataFrame, key: str, order: list[str], pong: Column) -> DataFrame:
    """Adds missed: the pings of a client since its last pong, this one included; 0 at a pong."""
    rows = running(beats.withColumn("_pong", pong), [key], order, {"_beat": F.col("_pong").cast("long")})
    return running(rows, [key, "_beat"], order, {"missed": (~F.col("_pong")).cast("long")}).drop("_beat", "_pong")


def idle_games(games: DataFrame, players: DataFrame, waiters: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """The games (game, host, last_activity) to be removed: no host, no connected player, nobody waiting, and idle for long enough.

    ``players`` has game and connected, ``waiters`` has game. A game that nobody ever joined counts too; a
    game without a last activity does not.
    """
    here = players.where("connected").select("game").unionByName(waiters.select("game"))
    idle = games.where(F.col("host").isNull() & (F.col("last_activity") <= now - F.make_interval(mins=F.lit(minutes))))
    return idle.join(here, "game", "left_anti")


#: Rows of a block: a game's messages and those that they go to are dealt into blocks of about so many, and each block of the one meets each of the other.
BLOCK_ROWS = 1_000

#: Rows that one task is meant to send.
ROWS_SENT = 5_000_000


def recipients(messages: DataFrame, players: DataFrame, hosts: DataFrame) -> DataFrame:
    """(message, game, role, recipient): each message of a game with every connected player and the hosts that it goes to.

    ``messages`` has message and game, ``players`` game, player and connected, ``hosts`` game and host. The
    rows are as many as what is sent, which grows with the square of a game, though its tables are small: blocks of a game's messages
    and recipients meet in as many tasks as counts show rows for, and what is shuffled is a small part of the rows. A stream's
    messages are joined as they come.
    """
    to = players.where("connected").select("game", F.lit("player").alias("role"), F.col("player").cast("string").alias("recipient"))
    to = to.unionByName(hosts.where("host is not null").select("game", F.lit("host").alias("role"), F.col("host").cast("string").alias("recipient")))
    sent, out = messages.select("message", "game"), ["message", "game", "role", "recipient"]
    if messages.isStreaming:
        return sent.join(to, "game").select(out)
    blocks = lambda rows, n: rows.groupBy("game").agg(F.count(F.lit(1)).alias(f"{n}_rows"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias(n))
    games = settled(blocks(sent, "_sent").join(blocks(to, "_to"), "game"))
    total = games.agg(F.sum(F.col("_sent_rows") * F.col("_to_rows"))).first()[0] or 0
    if total <= ROWS_SENT:
        return sent.join(to, "game").select(out)
    spark = messages.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-total // ROWS_SENT))
    own = lambda of, n: F.pmod(F.xxhash64(*of), n).alias(f"{n}_block")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(f"{n}_block")
    at = ["game", "_sent_block", "_to_block"]
    sent = join_few(sent, games, ["game"]).select("message", "game", own(["message"], "_sent"), every("_to")).repartition(tasks, *at)
    to = join_few(to, games, ["game"]).select("game", "role", "recipient", own(["role", "recipient"], "_to"), every("_sent")).repartition(tasks, *at)
    return sent.join(to, at).select(out)


class _Waiting(InOrder):
    """State per game: who waits, and since which message."""

    def open(self) -> None:
        self.waiters = self.handle.getMapState("names", "name string", "seq long")

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        held = {k[0]: v[0] for k, v in self.waiters.iterator()} if self.waiters.exists() else {}
        before, out = dict(held), []
        for _, seq, kind, name in rows:
            if kind == "setup":
                out += [(n, s, seq) for n, s in held.items()]
                held.clear()
            elif kind == "wait" and name is not None:
                held.setdefault(name, seq)
            elif kind == "left":
                held.pop(name, None)
        for name in before.keys() - held.keys():
            self.waiters.removeKey((name,))
        for name, seq in held.items():
            if before.get(name) != seq:
                self.waiters.updateValue((name,), (seq,))
        return out


def waiting(joins: DataFrame, key: str, ts: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(key, name, seq, admitted_at): waiters of each game with the reset that lets them in, as a stream or a table.

    ``joins`` has key (long), seq (long), kind (``wait``, ``left`` or ``setup``), name, and the time ``ts``, which a
    stream needs: rows count in the order of (ts, seq), or of seq alone. A waiter who left before the reset is not
    let in; one who waits at the end of the input gives no row, nor does one without a name. On a stream a row
    waits for the watermark to pass it, and beside such rows the state is the names that wait.
    """
    rows = joins.select(
        F.col(key).cast("long").alias(key), (F.col(ts).cast("timestamp") if ts else F.lit(0).cast("timestamp")).alias("_ts"), F.col("seq").cast("long").alias("seq"), "kind", F.col("name").cast("string").alias("name")
    )
    if not joins.isStreaming:
        return _waited(rows, key)
    if ts is None:
        raise ValueError("a stream's rows need a time to be put in order")
    processor = _Waiting("us long, seq long, kind string, name string", [key, "name", "seq", "admitted_at"])
    return in_order(rows, key, "_ts", "seq", ["kind", "name"], processor, f"{key} long, name string, seq long, admitted_at long", delay)


class _Idle(InOrder):
    """State per key: its last time."""

    def __init__(self, gap: int, *args) -> None:
        super().__init__(*args)
        self.gap = gap

    def open(self) -> None:
        self.last = self.handle.getValueState("last", "us long")

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        times = [r[0] for r in rows]
        if self.last.exists():
            times.insert(0, self.last.get()[0])
        self.last.update((times[-1],))
        return [(a,) for a, b in zip(times, times[1:], strict=False) if b - a >= self.gap]

    def idle(self, key: tuple, watermark: int) -> tuple[list[tuple], int | None]:
        if not self.last.exists():
            return [], None
        (last,) = self.last.get()
        if last + self.gap > watermark * 1000:
            return [], -(-(last + self.gap) // 1000)
        self.last.clear()
        return [(last,)], None


def evicted(events: DataFrame, key: str, ts: str, minutes: int = 30, delay: str = "0 seconds") -> DataFrame:
    """(key, last): each time that a key has had no event for so many minutes, with its last event before.

    On a stream a key goes once the watermark has passed its last event by the minutes (or a later event
    shows it), and the state is one time for each key that is there, beside rows that the watermark has not
    passed. On a table a key's last event counts as idle if the table's last event is so much later. Events
    without a key or time are left out.
    """
    gap = minutes * 60_000_000
    rows = events.select(F.col(key).cast("long").alias(key), F.col(ts).cast("timestamp").alias("_ts")).dropna()
    if events.isStreaming:
        rows = rows.withColumn("seq", F.lit(0).cast("long"))
        found = in_order(rows, key, "_ts", "seq", [], _Idle(gap, "us long, seq long", [key, "last"]), f"{key} long, last long", delay)
        return found.select(key, F.timestamp_micros("last").alias("last"))
    now = rows.agg(F.max("_ts").alias("_now"))
    spaced = running(rows, [key], [F.desc("_ts")], lasts={"_next": F.col("_ts")}, before=True).join(F.broadcast(now))  # one row
    later = F.unix_micros(F.coalesce("_next", "_now")) - F.unix_micros("_ts")
    return spaced.where(later >= gap).select(key, F.col("_ts").alias("last"))


def _waited(rows: DataFrame, key: str) -> DataFrame:
    """``waiting`` for tables: each wait since the waiter last left, with the reset that ends its round."""
    at = F.struct("_ts", "seq")
    rows = running(rows, [key], ["_ts", "seq"], {"_round": (F.col("kind") == "setup").cast("long")}, before=True)
    ends = rows.where("kind = 'setup'").select(key, "_round", F.col("seq").alias("admitted_at"))
    gone = rows.where("kind = 'left'").groupBy(key, "_round", "name").agg(F.max(at).alias("_gone"))
    waits = rows.where("kind = 'wait' and name is not null").join(gone, [key, "_round", "name"], "left").where(F.col("_gone").isNull() | (at > F.col("_gone")))
    first = waits.groupBy(key, "_round", "name").agg(F.min_by("seq", at).alias("seq"))
    return first.join(ends, [key, "_round"]).select(key, "name", "seq", "admitted_at")


def once_per_batch(write: Callable[[DataFrame], None], done: Callable[[], set[int]], mark: Callable[[int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that a restart may call again: a batch whose number is marked as done is left out.

    ``write`` must itself be repeatable (it may be cut off before its mark): a keyed upsert, or a folder named by batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        if number not in done():
            write(batch)
            mark(number)

    return run


def marks_beside(spark: SparkSession, root: str) -> tuple[Callable[[], set[int]], Callable[[int], None]]:
    """``done`` and ``mark`` for ``once_per_batch`` that keep a small file for each batch beside what is written below ``root``."""
    folder = f"{root}/_marks"

    def mark(number: int) -> None:
        created(spark, f"{folder}/{number:020d}", str(number))

    return lambda: {int(n) for n in names(spark, folder) if not n.startswith(".")}, mark
