"""The store that is merged when it is read, and whole game states as JSON and back."""

import json

import pytest
from pyspark.sql import functions as F

from tilewright.sources import deltas, gamestate

KEYS = ["id"]


def _rows(found):
    return sorted((r["id"], r["blob"]) for r in found.collect())


def _drain(stream, root, checkpoint):
    run = deltas.autosave(stream, root, checkpoint, KEYS, "at", "gone").trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert run.exception() is None


def test_autosave_keeps_what_a_batch_does_not_name(spark, tmp_path):
    """Two batches of different keys, a change, a deletion, a restart, and a second writer."""
    path, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "c")
    schema = "id long, blob string, at long, gone boolean"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    put((1, "a", 1, False), (2, "b", 2, None))
    put((3, "c", 3, False), (3, "old", 1, False))
    _drain(stream(), root, checkpoint)
    assert _rows(deltas.live(spark, root, KEYS)) == [(1, "a"), (2, "b"), (3, "c")]
    put((1, "new", 4, False), (2, None, 5, True), (4, "x", 1, False), (4, "x", 2, True))
    _drain(stream(), root, checkpoint)  # a restart goes on with the next batch
    told = [(1, "new"), (3, "c")]
    assert _rows(deltas.live(spark, root, KEYS)) == told
    assert deltas.merge(spark, root, KEYS) and _rows(deltas.live(spark, root, KEYS)) == told
    assert not deltas.merge(spark, root, KEYS)
    assert deltas.vacuum(spark, root) == 3 and _rows(deltas.live(spark, root, KEYS)) == told
    spark.createDataFrame([(2, "back", 0, False), (3, "changed", 0, False)], schema).coalesce(1).write.parquet(str(tmp_path / "more"))
    _drain(spark.readStream.schema(schema).parquet(str(tmp_path / "more")), root, str(tmp_path / "c2"))  # its batches count as later
    assert _rows(deltas.live(spark, root, KEYS)) == [(1, "new"), (2, "back"), (3, "changed")]
    deltas.save(spark.createDataFrame([(1, None, 0, True)], schema), root, KEYS, "at", "gone")
    assert _rows(deltas.live(spark, root, KEYS)) == [(2, "back"), (3, "changed")]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, blob string, at long")
    writer = deltas.generation(spark, root, "w")
    assert writer == deltas.generation(spark, root, "w") < deltas.generation(spark, root, "v")
    assert deltas.live(spark, root, KEYS) is None and not deltas.merge(spark, root, KEYS)
    for number in (0, 0, 1, 1):
        deltas.append_delta(one.where(F.col("id") == number + 1), root, writer, number, KEYS, "at")
    assert _rows(deltas.live(spark, root, KEYS)) == [(1, "a"), (2, "b")]
    assert len(deltas.names(spark, f"{root}/delta")) == 2


def test_merging_stops_at_a_batch_that_is_not_finished(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(i, str(i), 1) for i in range(4)], "id long, blob string, at long")
    for number in range(4):
        deltas.append_delta(rows.where(F.col("id") == number), root, 1, number, KEYS, "at")
    (tmp_path / "delta" / f"{1:010d}-{2:020d}" / "_SUCCESS").unlink()
    deltas.append_delta(rows.where("id = 0").withColumn("blob", F.lit("other")), root, 2, 7, KEYS, "at")
    assert deltas.merge(spark, root, KEYS) and not deltas.merge(spark, root, KEYS)
    assert {int(w): int(n) for w, n in deltas._version(spark, root)[2].items()} == {1: 1, 2: 7} and len(_rows(deltas.live(spark, root, KEYS))) == 4
    deltas.vacuum(spark, root)
    deltas.append_delta(rows.where("id = 1").withColumn("blob", F.lit("late")), root, 1, 4, KEYS, "at")  # a writer older than one that was merged
    assert _rows(deltas.live(spark, root, KEYS)) == [(0, "other"), (1, "late"), (2, "2"), (3, "3")]
    wider = spark.createDataFrame([(9, "n", 1, "more")], "id long, blob string, at long, extra string")
    deltas.append_delta(wider, root, 1, 5, KEYS, "at")
    assert {r["id"]: r["extra"] for r in deltas.live(spark, root, KEYS).collect()} == {0: None, 1: None, 2: None, 3: None, 9: "more"}


def test_two_merges_at_once(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, "a", 1)], "id long, blob string, at long")
    deltas.append_delta(rows, root, 1, 0, KEYS, "at")
    assert deltas.created(spark, f"{root}/versions/{1:020d}", json.dumps({"base": None, "upto": {}}))
    assert not deltas.created(spark, f"{root}/versions/{1:020d}", "other")
    assert deltas.merge(spark, root, KEYS) and _rows(deltas.live(spark, root, KEYS)) == [(1, "a")]


GRID = [["B1", "I16", "N31", "G46", "O61"]] + [[f"x{r}{c}" for c in range(5)] for r in range(4)]
FULL = {
    "game_id": "g", "status": "in_progress", "called_numbers": ["B1", "O61"], "current_number": "O61", "winning_pattern_name": "p", "last_activity": "2024-05-01T10:00:00",
    "waiting_room": {"w1": {"display_name": "d"}, "w2": {}},
    "players": {"a": {"player_id": "a", "display_name": "Al", "connected_at": "2024-05-01T09:00:00", "cards": [{"card_id": "a1", "player_id": "a", "grid": GRID, "marked": [[True] * 5] + [[False] * 5] * 4}, {}]}, "b": {"connected_at": "soon", "cards": None}},
}


@pytest.fixture(scope="module")
def parts(spark):
    texts = [json.dumps(FULL), "{not json", None, "{}", json.dumps({"game_id": "h", "status": "odd", "winning_pattern_name": "q", "players": {"z": {"cards": [{"grid": [], "marked": []}]}}})]
    rows = spark.createDataFrame(list(enumerate(texts)), "game_id long, blob string")
    return gamestate.restored_state(rows, "game_id", "blob", ["p"], F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


def test_nested_state_with_defaults(parts):
    games = {r["key"]: (r["game_id"], r["status"], r["called_numbers"], r["current_number"], r["winning_pattern_name"], r["wins"], str(r["last_activity"])) for r in parts["games"].collect()}
    assert games == {
        0: ("g", "in_progress", ["B1", "O61"], "O61", "p", True, "2024-05-01 10:00:00"), 3: ("", "setup", [], None, None, False, "2024-06-01 00:00:00"),
        4: ("h", "setup", [], None, "q", False, "2024-06-01 00:00:00"),
    }
    players = {(r["key"], r["player_id"], r["display_name"], r["connected"], str(r["connected_at"])) for r in parts["players"].collect()}
    assert players == {(0, "a", "Al", False, "2024-05-01 09:00:00"), (0, "b", "", False, "None"), (4, "z", "", False, "None")}
    cards = {(r["key"], r["player_id"], r["place"]): r for r in parts["cards"].collect()}
    assert cards[0, "a", 1]["grid"] == GRID and cards[0, "a", 1]["marked"][0] == [True] * 5 and cards[0, "a", 1]["card_id"] == "a1"
    for at in ((0, "a", 2), (4, "z", 1)):
        assert cards[at]["grid"] == [["0"] * 5] * 5 and [x for row in cards[at]["marked"] for x in row] == [i == 12 for i in range(25)]
        assert cards[at]["card_id"] == "/".join(map(str, at))
    assert {(r["key"], r["pending_id"], r["display_name"]) for r in parts["waiters"].collect()} == {(0, "w1", "d"), (0, "w2", "")}
    assert {r["key"] for r in parts["broken"].collect()} == {1, 2}


def test_state_goes_back_to_text(spark, parts):
    texts = gamestate.state_texts(parts).collect()
    whole = json.loads({r["key"]: r["text"] for r in texts}[0])
    assert whole["players"]["a"]["cards"][0] == FULL["players"]["a"]["cards"][0] and whole["called_numbers"] == FULL["called_numbers"]
    again = gamestate.restored_state(spark.createDataFrame(texts), "key", "text", ["p"], F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    for name in ("games", "players", "cards", "waiters"):
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, parts[name].collect()))
