"""Stateful streams against the same functions on tables, with rows in any order and Arrow batches of two rows."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.plans import games
from tilewright.streaming import messages, ordered, requests, rounds

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def small_batches(spark):
    ordered.use_rocksdb(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _drained(frame, name, folder):
    run = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    run.awaitTermination(300)
    return sorted(map(tuple, frame.sparkSession.table(name).collect()), key=repr)


def _shuffled(spark, rows, schema, path, files, delay):
    """Rows (with their times in seconds first) in files; each comes at most ``delay`` seconds late. The last row only moves the watermark on."""
    r = random.Random(7)
    rows = sorted(rows, key=lambda x: x[0] + r.uniform(0, delay * 0.9))
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        r.shuffle(part)
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(path)
    frame = spark.read.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_rounds_of_a_stream_equal_those_of_a_table(spark, tmp_path, small_batches):
    table = games.round_messages(spark, SF_DIR).where("game < 12")
    held = table.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "game", "seq", "kind", "cell").collect()
    told = sorted(map(tuple, rounds.call_verdicts(table, "game", "ts", "seq").collect()), key=repr)
    assert {r[3] for r in told} == {None, "no_game", "not_started", "over", "repeat"}
    last = max(r["at"] for r in held) / 1e6
    rows = [(r["at"] / 1e6, *r[1:]) for r in held] + [(last + 10 * 86400.0, -1, 0, "setup", None)]
    stream = _shuffled(spark, rows, "at double, game long, seq long, kind string, cell long", str(tmp_path / "in"), 6, 3 * 86400)
    checkpoint = str(tmp_path / "c")
    assert _drained(rounds.call_verdicts(stream, "game", "ts", "seq", "3 days"), "rounds", checkpoint) == told
    state = rounds.running_status(spark, checkpoint, "game")
    status = sorted(map(tuple, rounds.game_status(table, "game", "ts", "seq").collect()), key=repr)
    assert sorted(map(tuple, state.where("game >= 0").drop("cells").collect()), key=repr) == status
    assert all(len(r["cells"]) == r["called"] for r in state.collect())


def test_messages_without_game_or_time(spark):
    rows = [(None, 1, 1, "setup", None), (1, None, 2, "start", None), (1, 3, None, "start", None), (1, 4, 4, "call", 3), (1, 5, 5, "odd", None), (1, 6, 6, "setup", None), (1, 7, 7, "start", None), (1, 8, 8, "call", None), (1, 9, 9, "call", None)]
    table = spark.createDataFrame(rows, "game long, at long, seq long, kind string, cell int").withColumn("ts", F.timestamp_seconds("at"))
    assert sorted(map(tuple, rounds.call_verdicts(table, "game", "ts", "seq").collect())) == [(1, 4, 0, "no_game", 0), (1, 8, 1, None, 1), (1, 9, 1, "repeat", 1)]
    assert [tuple(r) for r in rounds.game_status(table, "game", "ts", "seq").collect()] == [(1, "in_progress", 1, 1, 8)]
    assert rounds.game_status(table.limit(0), "game", "ts", "seq").count() == 0


def test_waiting_room_in_any_order(spark, tmp_path, small_batches):
    r = random.Random(2)
    rows = [(float(i), g, i, r.choice(["wait", "wait", "left", "setup"]), r.choice("abcd")) for i in range(1, 120) for g in (1, 2)]
    schema = "at double, game long, seq long, kind string, name string"
    table = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at"))
    told = sorted(map(tuple, messages.waiting(table, "game", "ts").collect()), key=repr)
    assert told
    stream = _shuffled(spark, [*rows, (1000.0, 3, 0, "setup", None), (1.5, None, 7, "wait", "x")], schema, str(tmp_path / "in"), 4, 40)
    assert _drained(messages.waiting(stream, "game", "ts", "40 seconds"), "waits", tmp_path / "c") == told
    with pytest.raises(ValueError):
        messages.waiting(stream, "game")


def test_a_batch_in_falling_order(spark, tmp_path, small_batches):
    """One micro-batch of several Arrow batches, the last message first."""
    rows = [(6.0, 1, 6, "setup", None), (5.0, 1, 5, "wait", "b"), (4.0, 1, 4, "setup", None), (3.0, 1, 3, "left", "a"), (2.0, 1, 2, "wait", "b"), (1.0, 1, 1, "wait", "a"), (99.0, 2, 9, "setup", None)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "at double, game long, seq long, kind string, name string").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    assert _drained(messages.waiting(stream, "game", "ts"), "falling", tmp_path / "c") == [(1, "b", 2, 4), (1, "b", 5, 6)]


def test_idle_keys_with_null_and_late_times(spark, tmp_path, small_batches):
    r = random.Random(3)
    rows = [(60.0 * r.randint(0, 600), r.randint(1, 3)) for _ in range(40)]
    table = spark.createDataFrame(rows, "at double, game long").withColumn("ts", F.timestamp_seconds("at"))
    sentinel = (60.0 * 5000, 9)
    told = {tuple(x) for x in messages.evicted(table.unionByName(spark.createDataFrame([sentinel], "at double, game long").withColumn("ts", F.timestamp_seconds("at"))), "game", "ts").collect()}
    path = str(tmp_path / "in")
    spark.createDataFrame([(None, 1), (None, None), (5.0, None)], "at double, game long").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(path)
    stream = _shuffled(spark, [*rows, sentinel], "at double, game long", path, 4, 6000)
    assert set(_drained(messages.evicted(stream, "game", "ts", delay="100 minutes"), "idles", tmp_path / "c")) == told


def test_tries_until_acknowledged(spark, tmp_path, small_batches):
    r = random.Random(8)
    rows = [(float(i + 1), r.randint(1, 3), i, r.choice(["a", "b"]), r.random() < 0.3) for i in range(100)]
    schema = "at double, client long, seq long, request string, is_ack boolean"
    table = spark.createDataFrame([*rows, (3.0, 1, 500, None, False), (None, 1, 501, "a", False)], schema).withColumn("ts", F.timestamp_seconds("at"))
    told, first = [], {}
    for _, client, seq, request, is_ack in rows:
        if is_ack:
            first.pop((client, request), None)
        else:
            f = first.setdefault((client, request), seq)
            told.append((client, seq, request, f, f != seq))
    assert sorted(map(tuple, requests.answered(table, "client", "ts", "seq").collect()), key=repr) == sorted(told, key=repr)
    stream = _shuffled(spark, [*rows, (1000.0, 9, 900, "z", None)], schema, str(tmp_path / "in"), 4, 30)
    assert _drained(requests.answered(stream, "client", "ts", "seq", "30 seconds"), "tries", tmp_path / "c") == sorted(told, key=repr)


def test_marks_beside_the_sink(spark, tmp_path):
    root, rows = str(tmp_path), spark.createDataFrame([(1,), (2,)], "a long")
    for number in (0, 0, 1, 0):  # each time as after a restart
        done, mark = messages.marks_beside(spark, root)
        messages.once_per_batch(lambda df: df.write.mode("append").parquet(f"{root}/out"), done, mark)(rows, number)
    assert spark.read.parquet(f"{root}/out").count() == 4 and messages.marks_beside(spark, root)[0]() == {0, 1}
