"""Lines that fit a pitch and projected points, against plain Python."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tilewright.functions.geometry import completed_lines, line_at, projected
from tilewright.operators.signals import fitting_lines


def _plain(lines):
    kept = sorted(x for x in lines if x is not None)

    def misfit(xs):
        gaps = [b - a for a, b in zip(xs, xs[1:], strict=False)]
        return max(abs(g - median(gaps)) for g in gaps), median(gaps)

    while len(kept) >= 4:
        far, pitch = misfit(kept)
        if far <= 0.12 * pitch:
            break
        kept = min((misfit(kept[:j] + kept[j + 1 :])[0], j, kept[:j] + kept[j + 1 :]) for j in range(len(kept)))[2]
    return kept


def test_fitting_lines(spark):
    r = random.Random(8)
    rows = [(i, sorted([100.0 * k + r.randint(-4, 4) for k in range(r.randint(2, 6))] + [float(r.randint(0, 600)) for _ in range(r.randint(0, 3))])) for i in range(60)]
    rows += [(100, []), (101, [5.0]), (102, [1.0, None, 3.0, 2.0]), (103, [7.0] * 6), (104, None), (105, [300.0, 0.0, 200.0, 100.0, 130.0])]
    found = spark.createDataFrame(rows, "id int, lines array<double>").select("id", fitting_lines(F.col("lines")).alias("kept")).collect()
    assert {x["id"]: x["kept"] for x in found} == {i: None if lines is None else _plain(lines) for i, lines in rows}
    assert _plain(rows[-1][1]) == [0.0, 100.0, 200.0, 300.0]


def test_projected(spark):
    h = [2.0, 0.0, 1.0, 0.0, 3.0, -1.0, 0.5, 0.0, 1.0]
    rows = spark.createDataFrame([(1.0, 2.0), (-2.0, 5.0), (None, 1.0)], "x double, y double")
    found = [tuple(r["at"]) for r in rows.select(projected(F.array(*map(F.lit, h)), F.col("x"), F.col("y")).alias("at")).collect()]
    assert found == [pytest.approx((2.0, 5 / 1.5)), (0.0, 0.0), (None, None)]


def test_completed_lines(spark):
    rows = [(0, [10.0, 110.0, 209.0]), (1, [80.0, 100.0, 200.0, 300.0]), (2, [0.0, 5.0]), (3, [float(i) for i in range(9)]), (4, [1.0]), (5, []), (6, None), (7, [4.0, 4.0]), (8, [1.0, None, 3.0])]
    found = {r["id"]: r["l"] for r in spark.createDataFrame(rows, "id int, l array<double>").select("id", completed_lines(F.col("l")).alias("l")).collect()}
    assert found[0] == [10.0, 110.0, 209.0, 309.0, 409.0, 509.0]
    assert found[1] == [100.0, 200.0, 300.0, 400.0, 500.0, 600.0]
    assert found[2] == [0.0, 5.0, 10.0, 15.0, 20.0, 25.0] and found[3] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert [found[i] for i in (4, 5, 6, 7, 8)] == [None] * 5


def test_line_at(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 2.0, 3.0, 5.0), (1.0, 1.0, 9.0, 1.0, 5.0), (None, 1.0, 2.0, 3.0, 5.0)], "a double, b double, c double, d double, e double")
    found = [r[0] for r in rows.select(line_at(*map(F.col, "abcde"))).collect()]
    assert found == [3.0, 1.0, None]
