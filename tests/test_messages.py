"""Streams of messages against the same functions on tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.sources import store
from tilewright.streaming import messages, ordered

BODY = T.StructType([T.StructField("k", T.LongType()), T.StructField("game_id", T.StringType())])
TEXTS = [
    '{"type": "join", "k": 1, "game_id": "g"}', '{"type": "ping"}', "{broken", "", None, "[1]", '{"k": 5}', '{"type": "shrug", "k": 6}', '"join"',
    '{"type": "submit_number", "k": "x"}',
]


def _drained(frame, name, folder):
    run = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return frame.sparkSession.table(name).collect()


def test_routes_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "value string")
    batch = messages.routed(rows, "value", BODY).collect()
    assert [(r["route"], r["reason"]) for r in batch[:9]] == [
        ("players", None), ("liveness", None), (None, "not json"), (None, "not json"), (None, "not json"), (None, "not json"), (None, "no type"),
        (None, "unknown type"), (None, "not json"),
    ]
    assert batch[0]["body"]["k"] == 1 and batch[0]["body"]["game_id"] == "g"
    rows.where("value is not null").write.text(str(tmp_path / "in"))
    found = _drained(messages.routed(messages.read_messages(spark, str(tmp_path / "in")), "value", BODY), "routes", tmp_path / "c")
    key = lambda r: (r["value"], r["type"], r["route"], r["reason"])
    assert sorted(map(key, found), key=repr) == sorted((key(r) for r in batch if r["value"] is not None), key=repr)


def test_waiting_room(spark, tmp_path):
    """Waiters are let in by the next reset of their game, but for those who have left."""
    rows = [
        (1, 1, "wait", "a"), (1, 2, "wait", "b"), (1, 3, "left", "a"), (1, 4, "setup", None), (1, 5, "wait", "c"), (2, 1, "setup", None),
        (2, 2, "wait", "d"), (2, 3, "wait", "d"), (1, 6, "setup", None), (2, 9, "setup", None), (3, 1, "wait", "e"),
    ]
    told = [(1, "b", 2, 4), (1, "c", 5, 6), (2, "d", 2, 9)]
    table, path = spark.createDataFrame(rows, "game long, seq long, kind string, name string"), str(tmp_path / "in")
    assert sorted(tuple(r) for r in messages.waiting(table, "game").collect()) == told
    timed = table.withColumn("ts", F.timestamp_seconds("seq"))
    assert sorted(tuple(r) for r in messages.waiting(timed, "game", "ts").collect()) == told
    for a, b in ((0, 3), (3, 6), (6, 99)):
        timed.where(f"seq >= {a} and seq < {b}").coalesce(1).write.mode("append").parquet(path)
    ordered.use_rocksdb(spark)
    stream = messages.waiting(spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(path), "game", "ts")
    assert sorted(tuple(r) for r in _drained(stream, "waiting", tmp_path / "c")) == told


def test_batches_are_written_once(spark, tmp_path):
    done: set[int] = set()
    write = messages.once_per_batch(lambda df: df.write.mode("append").parquet(str(tmp_path / "out")), lambda: done, done.add)
    rows = spark.createDataFrame([(1,), (2,)], "a long")
    for number in (0, 0, 1, 0):
        write(rows, number)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4 and done == {0, 1}
    rows.write.parquet(str(tmp_path / "in"))
    again = messages.once_per_batch(lambda df: df.write.mode("append").parquet(str(tmp_path / "two")), lambda: done, done.add)
    run = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(again)
    done.clear()
    run.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "two")).count() == 2


def test_idle_games_and_recipients(spark):
    games = spark.createDataFrame([(1, None, "2024-01-01 10:00:00"), (2, "h", "2024-01-01 10:00:00"), (3, None, "2024-01-01 10:00:01"), (4, None, None), (5, None, "2024-01-01 09:00:00"), (6, None, "2024-01-01 09:00:00")], "game long, host string, t string")
    games = games.withColumn("last_activity", F.to_timestamp_ntz("t"))
    players = spark.createDataFrame([(1, 7, False), (5, 8, True), (3, 9, True)], "game long, player long, connected boolean")
    waiters = spark.createDataFrame([(6,)], "game long")
    now = F.lit("2024-01-01 10:30:00").cast("timestamp_ntz")
    assert [r["game"] for r in messages.idle_games(games, players, waiters, now).collect()] == [1]
    sent = spark.createDataFrame([(100, 5), (101, 2), (102, 9), (103, None)], "message long, game long")
    found = {tuple(r) for r in messages.recipients(sent, players, games.select("game", "host")).collect()}
    assert found == {(100, 5, "player", "8"), (101, 2, "host", "h")}
    beats = spark.createDataFrame([(1, i, i in (2, 5)) for i in range(7)], "c long, i int, pong boolean")
    assert [r["missed"] for r in messages.missed_pongs(beats, "c", ["i"], F.col("pong")).orderBy("i").collect()] == [1, 2, 0, 1, 2, 0, 1]


def test_recipients_are_dealt(spark, monkeypatch):
    """A large game of small tables is sent in many tasks, with the same rows, repeated and null ones too."""
    sent = spark.range(3_000).select(F.col("id").alias("message"), (F.col("id") % 2).alias("game")).coalesce(1)
    players = spark.range(4_000).select((F.col("id") % 2).alias("game"), F.col("id").alias("player"), F.lit(True).alias("connected")).coalesce(1)
    hosts = spark.createDataFrame([(0, "1"), (1, None)], "game long, host string")
    rows = messages.recipients(sent, players, hosts).groupBy(F.spark_partition_id().alias("task"), "game").agg(F.count("*").alias("n"), F.sum("message").alias("m"), F.sum(F.col("message") * F.col("recipient").cast("long")).alias("both"))
    found = rows.collect()
    of = lambda game, up_to: sum(range(game, up_to, 2))
    for game, host in ((0, 1), (1, 0)):
        own = [r for r in found if r["game"] == game]
        assert sum(r["n"] for r in own) == 1_500 * (2_000 + host) and sum(r["m"] for r in own) == of(game, 3_000) * (2_000 + host)
        assert sum(r["both"] for r in own) == of(game, 3_000) * (of(game, 4_000) + host)
    assert len({r["task"] for r in found}) > 1 and max(r["n"] for r in found) < 3_000_000
    sent = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (None, 5), (3, 6), (4, None), (5, 9)], "message long, game long")
    players = spark.createDataFrame([(5, 1, True), (5, 1, True), (5, None, True), (5, 2, False), (6, 3, True), (None, 4, True), (8, 5, True)], "game long, player long, connected boolean")
    hosts = spark.createDataFrame([(5, "1"), (6, None), (None, "h")], "game long, host string")
    plain = [tuple(r) for r in messages.recipients(sent, players, hosts).collect()]
    monkeypatch.setattr(messages, "ROWS_SENT", 3)
    monkeypatch.setattr(messages, "BLOCK_ROWS", 2)
    assert sorted(map(tuple, messages.recipients(sent, players, hosts).collect()), key=repr) == sorted(plain, key=repr) and len(plain) == 4 * 4 + 1


def test_restored_games(spark):
    blobs = ['{"game_id": "a", "status": "game_over", "winning_pattern_name": "x"}', '{"status": "odd", "winning_pattern_name": "no", "last_activity": "soon"}', "{}", "{not json", None]
    rows = spark.createDataFrame(list(enumerate(blobs)), "i long, blob string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    good, broken = store.restored_games(rows, "blob", ["x"], now)
    found = {r["i"]: (r["game_id"], r["status"], r["winning_pattern_name"], r["wins"], str(r["last_activity"])) for r in good.collect()}
    day = "2024-01-01 00:00:00"
    assert found == {0: ("a", "game_over", "x", True, day), 1: ("", "setup", "no", False, day), 2: ("", "setup", None, False, day)}
    assert {r["i"] for r in broken.collect()} == {3, 4}


def test_idle_keys_of_a_stream(spark, tmp_path):
    """Each time a key is idle for half an hour, as a stream and as a table."""
    at = lambda m: f"2024-01-01 {10 + m // 60:02d}:{m % 60:02d}:00"
    rows = spark.createDataFrame([(1, at(0)), (1, at(29)), (1, at(59)), (2, at(5)), (2, at(34)), (3, at(50)), (4, at(0)), (4, at(95)), (5, at(100))], "game long, t string")
    rows = rows.withColumn("ts", F.to_timestamp("t"))
    pairs = lambda found: sorted((r["game"], r["last"].strftime("%H:%M")) for r in found)
    told = [(1, "10:29"), (1, "10:59"), (2, "10:34"), (3, "10:50"), (4, "10:00")]
    assert pairs(messages.evicted(rows, "game", "ts").collect()) == told
    path = str(tmp_path / "in")
    ordered.use_rocksdb(spark)
    for a, b in ((0, 40), (40, 60), (60, 200)):
        part = rows.where((F.col("ts") >= F.lit(at(a)).cast("timestamp")) & (F.col("ts") < F.lit(at(b)).cast("timestamp")))
        part.select("game", "ts").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("game long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    assert pairs(_drained(messages.evicted(stream, "game", "ts"), "idle", tmp_path / "c")) == told
