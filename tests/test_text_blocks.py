"""Text files read in small blocks, the sheet function, pending cells, and winners as rows."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import replay, tables
from tilewright.plans import records
from tilewright.sources import pending, text

from conftest import SF_DIR


@pytest.fixture
def tiny_blocks(spark):
    held = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0"}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k in held:
        spark.conf.unset(k)


def _file(r, end):
    """A truth file whose sections are longer than a block, with blank lines, comments, and numbers under no header."""
    lines, told = ["[1, 2]", ""], {}
    for sheet in r.sample(range(1, 90), 12):
        lines += [f"#blue_sheet_{sheet:03d}:", "[9, 9]"] if r.random() < 0.5 else [f"#blue_sheet_{sheet:03d}:"]
        for card in range(1, r.randint(1, 4)):
            lines += ["", f"  #card{card} "]
            for row in range(r.choice([1, 5, 60])):
                cells = [r.choice([None, r.randint(1, 75)]) for _ in range(5)]
                lines += ["# note"] * r.randint(0, 1) + ["[" + ", ".join("FREE" if c is None else str(c) for c in cells) + "]"]
                told |= {(sheet, card, row, c): v for c, v in enumerate(cells)}
    return end.join(lines), lines, told


def test_blocks_equal_whole_files(spark, tmp_path, tiny_blocks):
    r = random.Random(9)
    told = {}
    for name, end in (("a", "\n"), ("b", "\r\n"), ("c", "\n")):
        body, lines, cells = _file(r, end)
        (tmp_path / f"{name}.txt").write_bytes(body.encode() + (end.encode() if name != "c" else b""))
        told[name] = (lines, cells)
    rows = text.numbered_lines(spark, str(tmp_path)).cache()
    assert rows.select("file", "block").distinct().count() > 12
    for name, (lines, cells) in told.items():
        own = rows.where(F.col("file").endswith(f"{name}.txt"))
        found = [x["text"] for x in own.orderBy("line").collect()]
        assert found == [x.strip(" ") for x in lines] and sorted(x["line"] for x in own.collect()) == list(range(len(lines)))
        got = text.truth_cells(own).collect()
        assert {(x["sheet"], x["card"], x["r"], x["c"]): x["value"] for x in got} == cells and len(got) == len(cells)


def test_headers_over_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "PIECE", 7)
    body, lines, cells = _file(random.Random(5), "\n")
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text(body)
    rows = text.numbered_lines(spark, str(tmp_path))
    assert rows.groupBy("file", "block").count().agg(F.max("count")).first()[0] == 7
    number = F.nullif(F.regexp_extract("text", "^#blue_sheet_0*([0-9]+):", 1), F.lit("")).cast("long")
    now, told = None, []
    for i, x in enumerate(lines):
        now = int(x[12:15]) if x.startswith("#blue") else now
        told.append((i, x.strip(), now))
    found = text.under_headers(rows, number, "sheet").where("file like '%b.txt'").orderBy("line").collect()
    assert [(x["line"], x["text"], x["sheet"]) for x in found] == told
    got = text.truth_cells(rows.where("file like '%a.txt'")).collect()
    assert {(x["sheet"], x["card"], x["r"], x["c"]): x["value"] for x in got} == cells and len(got) == len(cells)


def test_dictated_cards_over_blocks(spark, tmp_path, tiny_blocks):
    r = random.Random(3)
    lines, told = [], {}
    for i in range(30):
        lines.append(f"shot_{i}.png:")
        for card in r.sample([1, 2, 3], 2):
            numbers = [r.randint(1, 75) for _ in range(24)]
            lines += [f"Card {['one', 'two', 'three'][card - 1]}:", ", ".join(map(str, numbers[:10])) + ",", ", ".join(map(str, numbers[10:])), ""]
            told[f"shot_{i}.png", card] = numbers
    (tmp_path / "d.txt").write_text("\n".join(lines))
    found = {}
    for x in text.dictated_cells(text.numbered_lines(spark, str(tmp_path))).orderBy("c", "r").collect():
        found.setdefault((x["image"], x["card"]), []).append(x["value"])
    assert found == told


def test_sheet_function(spark):
    rows = [(1, 0, "[1, 2]"), (1, 1, "#card2"), (1, 2, "[1, FREE, 3]"), (1, 3, ""), (1, 4, "# x"), (1, 5, "[7]"), (1, 6, "#card1"), (1, 7, "[8]"), (2, 0, "#card3"), (2, 1, None), (2, 9, "[75]"), (3, 0, "[1]")]
    lines = spark.createDataFrame(rows[::-1], "sheet int, line long, text string")
    found = sorted(map(tuple, text.sheet_cells(lines).collect()))
    assert found == [(1, 1, 0, 0, 8), (1, 2, 0, 0, 1), (1, 2, 0, 1, None), (1, 2, 0, 2, 3), (1, 2, 1, 0, 7), (2, 3, 0, 0, 75)]


def test_grids_are_drawn_in_many_tasks(spark):
    few = tables.dealt(spark.range(500).coalesce(1), "id")
    sizes = few.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 8 and sum(x["count"] for x in sizes) == 500
    # the customers' file is one block; each task writes a file of sheets
    assert records._sheet_lines(spark, SF_DIR).select("file").distinct().count() >= 8


def test_pending_cells(spark, tmp_path):
    root = str(tmp_path)
    assert pending.pending(spark, root) is None
    places = spark.createDataFrame([(1, c, v) for c in range(3) for v in ([200] * 150 + [10] * c)] + [(2, 0, None), (2, 1, 3)], "scan_id long, cell int, v int")
    cells = pending.dark_shares(places, ["scan_id", "cell"], F.col("v") < 150)
    assert {(x["scan_id"], x["cell"]): round(x["share"], 4) for x in cells.collect()} == {(1, 0): 0.0, (1, 1): 0.0066, (1, 2): 0.0132, (2, 0): 0.0, (2, 1): 1.0}
    sidecars = spark.createDataFrame([(1, "[[[1, null], [3]]]"), (2, "{not json"), (4, "[]")], "scan_id long, auto string")
    for _ in range(2):
        pending.save_pending(cells, sidecars, root, "0")
    pending.save_pending(cells.withColumn("scan_id", F.lit(3).cast("long")), sidecars.limit(0), root, "1")
    found = {(x["scan_id"], x["cell"]): x["auto"] for x in pending.pending(spark, root).collect()}
    assert found == {(1, 2): [[[1, None], [3]]], (2, 1): None, (3, 2): None, (3, 1): None}
    gone, kept = pending.confirmed(pending.pending(spark, root), spark.createDataFrame([(1,), (1,), (9,)], "scan_id long"))
    assert {x["scan_id"] for x in gone.collect()} == {1} and {x["scan_id"] for x in kept.collect()} == {2, 3}


def test_sidecars_that_say_nothing(spark):
    texts = ["[[[1]]]", None, "", "{}", "[1", '{"a": [1]}', "7", "null", " [[[2]]] ", "[[[1]]], 3"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(pending.readings(F.col("t"))).collect()
    assert [x[0] for x in rows] == [[[[1]]], None, None, None, None, None, None, None, [[[2]]], None]


def test_winner_rows_equal_the_lists(spark):
    r = random.Random(4)
    cards = spark.createDataFrame([(g, c, f"p{c % 7}", r.randint(0, 14)) for g in (1, 2, None) for c in range(20)], "game long, card long, player string, won long")
    calls = [5, 9, 5, 1, 7, 9, 2, 3, 11, 13]
    rows, counts = replay.winner_rows(cards, calls)
    told = replay.winner_lists(cards, calls).where("game is not null").collect()
    assert {(x["game"], x["call"], x["number"], x["fresh"], x["winners"]) for x in counts.where("game is not null").collect()} == {(x["game"], x["call"], x["number"], len(x["fresh"]), x["winners"]) for x in told}
    won = {(x["game"], x["card"]): (x["call"], x["player"]) for x in rows.where("game is not null").collect()}
    assert won == {(x["game"], x["card"]): (x["won"], x["player"]) for x in cards.collect() if x["game"] is not None and x["won"] <= len(calls)}
    assert all(x["number"] == (calls[x["call"] - 1] if x["call"] else None) for x in rows.collect())
