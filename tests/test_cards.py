"""Decoded cards, grids, series and quantiles against plain versions, on rows that the tables lack."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tilewright.functions import grids
from tilewright.operators import decode, islands, metrics, nearest, quantiles, readers, replay, signals
from tilewright.sources import store


def _best(table):
    """The largest total, and of equal ones the first choices in order."""
    rows = sorted(table)
    found = []
    for path in itertools.permutations(range(6), len(rows)):
        scores = [table[r].get(c) for r, c in zip(rows, path, strict=True)]
        if None not in scores:
            found.append((-sum(scores), path))
    return min(found) if found else None


def test_assignment_of_missing_rows_and_ties(spark):
    r = random.Random(1)
    groups = {g: {i: {c: r.randint(-3, 3) for c in range(6) if r.random() < 0.9} for i in r.sample(range(5), r.randint(1, 5))} for g in range(120)}
    groups[200] = {0: {1: 5}, 3: {1: 7}}  # both want the only choice
    rows = [(g, i, c, s) for g, t in groups.items() for i, cs in t.items() for c, s in cs.items()] + [(0, 4, 5, None), (300, 0, 0, None)]
    found = {x["g"]: x for x in decode.assigned(spark.createDataFrame(rows, "g long, i int, c int, s long"), ["g"], "i", "c", "s", 6).collect()}
    for g, table in groups.items():
        table = {i: cs for i, cs in table.items() if cs}
        told = _best(table) if table else None
        if not table:
            assert g not in found
        elif told is None:
            assert found[g]["total"] is None and found[g]["picks"] is None
        else:
            assert found[g]["total"] == -told[0] and [p["choice"] for p in found[g]["picks"]] == list(told[1])
            assert [p["row"] for p in found[g]["picks"]] == sorted(table)
            for p in found[g]["picks"]:
                odds = {c: math.exp(s) for c, s in table[p["row"]].items()}
                assert abs(p["conf"] - odds[p["choice"]] / sum(odds.values())) < 1e-9
    assert 300 not in found


def test_cards_of_half_read_sheets(spark):
    rows = spark.createDataFrame([(1, c, i, n, 9 if n == i else 0) for c in range(4) for i in range(5) if (c, i) not in ((2, 2), (3, 4)) for n in range(15)], "g long, c int, i int, n int, s long")
    card = decode.read_cards(decode.assigned(rows, ["g", "c"], "i", "n", "s"), ["g"], "c")
    cells = card.select(decode.card_cells(F.col("value"), F.col("conf")).alias("x"), decode.needs_review(F.col("value"), F.col("conf"))).first()
    assert [x["value"] for x in cells["x"]][:5] == [1, 16, 31, 46, None] and cells["x"][12]["raw"] == "FREE" and cells["x"][12]["confidence"] == 100.0
    assert [i for i, x in enumerate(cells["x"]) if not x["valid"]] == [4, 9, 14, 19, 23, 24] and cells[1] is True
    sure = spark.range(1).select(F.array(*[F.lit(0.9)] * 25).alias("c"), F.array(*[F.lit(1)] * 12, F.lit(None), *[F.lit(1)] * 12).alias("v"))
    blur = [None, 499.0, 500.0]
    assert [sure.select(decode.needs_review(F.col("v"), F.col("c"), F.lit(b).cast("double"))).first()[0] for b in blur] == [False, True, False]


def test_grids(spark):
    good = [[i + 15 * c for c in range(5)] for i in range(1, 6)]
    short, hole, high = good[:4], [list(x) for x in good], [list(x) for x in good]
    hole[0][1], hole[2][2], high[4][4] = None, None, 76
    rows = spark.createDataFrame([(i, g) for i, g in enumerate([good, short, hole, high, None, [[1], None, [], [1], [1]]])], "i int, g array<array<int>>")
    found = {r["i"]: r for r in rows.select("i", grids.is_square(F.col("g")).alias("ok"), grids.labelled(F.col("g")).alias("l"), grids.violations(F.col("g")).alias("v")).collect()}
    assert [found[i]["ok"] for i in range(6)] == [True, False, True, True, False, False]
    assert found[0]["l"][:5] == ["B1", "I16", "N31", "G46", "O61"] and found[0]["l"][12] == "FREE" and all(found[i]["l"] is None for i in range(1, 6))
    assert [tuple(x) for x in found[2]["v"]] == [(0, 1, None, "missing")] and [tuple(x) for x in found[3]["v"]] == [(4, 4, 76, "out of range")]
    turned = spark.range(1).select(grids.by_columns(F.sequence(F.lit(1), F.lit(24))), grids.by_columns(F.array(F.lit(1)))).first()
    assert turned[0][:5] == [1, 6, 11, 15, 20] and turned[0][12] is None and turned[0][24] == 24 and turned[1] is None


def test_quantiles(spark):
    r = random.Random(3)
    groups = {"a": [r.gauss(0, 1) for _ in range(500)], "b": [7.0], "c": [1.0, 1.0, 2.0], "d": [r.choice([0.0, 1e9]) for _ in range(99)], "e": [None]}
    rows = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, x double").repartition(5)
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    found = {(x["k"], x["i"]): x["value"] for x in quantiles.exact(rows, ["k"], "x", shares).collect()}
    for k in "abcd":
        assert np.allclose([found[k, i] for i in range(5)], np.quantile(groups[k], shares))
    assert len(found) == 20 and quantiles.exact(rows.limit(0), ["k"], "x", shares).isEmpty()


def test_runs_and_chains(spark):
    flags = [([], 0), ([True, None, True, True, False, True], 2), ([False], 0), ([True] * 4, 4)]
    rows = spark.createDataFrame(flags, "f array<boolean>, n int").select("n", islands.longest_run(F.col("f"))).collect()
    assert all(a == b for a, b in rows)
    days = spark.createDataFrame([(1, d) for d in (1, 2, 5, 6, 8, 10, 11, 30, 31)], "k int, d int")
    found = sorted(tuple(x) for x in islands.merged_runs(days, ["k"], "d", 2, 5).collect())
    assert found == [(1, 1, 6), (1, 10, 11), (1, 30, 31)]  # the lone day 8 lies between
    lines = [(1, y) for y in (10, 30, 50, 70, 92, 200, 220, 225, 240, 260, 280, 400)] + [(2, 5), (3, 1), (3, 9)]
    found = sorted(tuple(x) for x in islands.even_chains(spark.createDataFrame(lines, "k int, y int"), ["k"], "y").collect())
    assert found == [(1, 10.0, 92.0, 5), (1, 225.0, 280.0, 4), (3, 1.0, 9.0, 2)]
    bands = lambda *x: F.array(*[F.struct(F.lit(a).alias("top"), F.lit(b).alias("bottom")) for a, b in x])
    row = spark.range(1).select(
        islands.sheet_structure(bands((0, 10), (100, 110), (200, 208))), islands.sheet_structure(bands((0, 10), (100, 110), (300, 310))),
        islands.sheet_structure(bands((0, 60)), F.lit(100)), islands.sheet_structure(bands((0, 50)), F.lit(100)), islands.sheet_structure(bands((0, 1), (5, 6))),
    ).first()
    assert [tuple(x) for x in row] == [(1000.8, True), (3.0, False), (0.0, False), (10.0, True), (2.0, False)]


def test_series(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.0, 0.5, 0.4, 0.5, 0.6, 0.1, 0.1, 0.9])], "k int, i int, s double")
    found = [(x["i"], x["improved"], x["stale"]) for x in signals.stopped_early(rows, ["k"], "i", "s", 2).orderBy("i").collect()]
    assert found == [(0, False, 1), (1, True, 0), (2, False, 1), (3, False, 2)]
    bounds = spark.createDataFrame([(1, 3, 0, 7), (1, 40, 0, 7), (2, 3, 0, 7)], "k int, bound int, lo int, hi int")
    found = {(x["k"], x["bound"]): x["snapped"] for x in signals.strongest_near(rows, bounds, ["k"], "i", "s", 2).collect()}
    assert found == {(1, 3): 4, (1, 40): 40, (2, 3): 3}
    rows = spark.createDataFrame([(1, 10, 1, 5.0), (1, 20, 2, None), (1, 30, 3, 7.0), (1, 30, 4, 8.0), (2, 1, 5, None)], "k int, x long, t int, v double")
    found = {x["t"]: (x["v"], x["_shift"]) for x in nearest.inherited(rows, ["k"], "x", "t", ["v"], F.col("v").isNull(), 5).collect()}
    assert found == {2: (5.0, 0), 5: (None, None)}


def test_reports(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, None), (2, 1), (1, 1)], "t int, p int")
    found = {x["label"]: tuple(x)[1:] for x in metrics.label_report(rows, "t", "p").collect()}
    assert found["3"] == (0.0, 0.0, 0.0, 1) and found["1"] == (2 / 3, 2 / 3, 2 / 3, 3) and found["2"] == (0.5, 0.5, 0.5, 2)
    assert found["accuracy"][2:] == (0.5, 6) and abs(found["weighted avg"][2] - 0.5) < 1e-9 and abs(found["macro avg"][0] - (2 / 3 + 0.5) / 3) < 1e-9
    row = spark.range(1).select(
        metrics.mean_confidence(F.array(F.lit(50.0), F.lit(-1.0), F.lit(90.0)), F.array(F.lit("5"), F.lit("6"), F.lit(" "))), metrics.mean_confidence(F.array(F.lit(1.0)), F.array(F.lit(""))),
        metrics.digit_reading(F.lit(4), F.lit(2), F.lit(0.5), F.lit(0.7)), metrics.class_of(F.lit(10)), metrics.class_of(F.lit(76)), metrics.split_of(F.lit(None).cast("int")),
    ).first()
    assert row[:2] == (50.0, 0.0) and tuple(row[2]) == (42, 0.6) and row[3:] == (1, None, "valid")


def test_supplied_readers_and_figures(spark):
    rows = spark.createDataFrame([("words", "a b"), ("digits", "a1 22"), ("none", "x"), (None, "x"), ("words", None)], "reader string, text string")
    more = readers.READERS | {"none": lambda text: F.lit(7).cast("long")}
    assert [r["value"] for r in readers.read_by(rows, "reader", "text", readers.READERS).collect()] == [2, 3, None, None, 0]
    seen_rows, seen = readers.watched(readers.read_by(rows, "reader", "text", more), "figures", n=F.count(F.lit(1)), unread=F.count_if(F.col("value").isNull()))
    assert [r["value"] for r in seen_rows.collect()] == [2, 3, 7, None, 0] and seen.get == {"n": 5, "unread": 1}
    found = spark.range(6).select(readers.predicate(lambda x: x % 2 == 0, "id")).collect()
    assert [r[0] for r in found] == [True, False] * 3
    kept, gone = store.without_keys(spark.range(5), spark.createDataFrame([(3,), (9,)], "id long"), ["id"])
    assert {r["id"] for r in kept.collect()} == {0, 1, 2, 4} and [r["id"] for r in gone.collect()] == [3]


def test_winners_of_a_game_with_early_and_no_winners(spark):
    """Winners before any call count on, cards that never win are in no list, repeated calls announce nothing."""
    cards = spark.createDataFrame([(1, 10, 0), (1, 11, 2), (1, 12, 1 << 40), (1, 9, 4), (1, 13, 4), (2, 20, 1 << 40), (3, 30, 5)], "game long, card long, won long")
    found = {(r["game"], r["call"]): (r["number"], r["fresh"], r["winners"]) for r in replay.winner_lists(cards, [7, 8, 7, 9, 1]).collect()}
    assert found == {
        (1, 1): (7, [], 1), (1, 2): (8, [11], 2), (1, 4): (9, [9, 13], 4), (1, 5): (1, [], 4), (3, 5): (1, [30], 1),
    }
