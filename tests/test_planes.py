"""Components, second differences, lattices and valleys against plain loops on random planes and profiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions.grids import cropped
from tilewright.operators import lattices, planes
from tilewright.plans import lattices as _lattice_queries  # noqa: F401  (adds its queries)
from tilewright.plans.queries import ORACLE_SQL, QUERIES


def _plain_components(cells):
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        part = list(todo)
        while todo:
            y, x = todo.pop()
            for n in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    todo.append(n)
                    part.append(n)
        ys, xs = zip(*part, strict=True)
        out.append((*min(part), len(part), min(ys), max(ys), min(xs), max(xs)))
    return sorted(out)


def test_components(spark):
    r = random.Random(1)
    held = {k: {(r.randint(0, 14), r.randint(0, 20)) for _ in range(n)} for k, n in (("a", 40), ("b", 120), ("c", 220))}
    held["spiral"] = {(0, x) for x in range(9)} | {(y, 8) for y in range(9)} | {(8, x) for x in range(9)} | {(y, 0) for y in range(3, 9)} | {(3, x) for x in range(6)} | {(20, 20)}
    held["comb"] = {(0, x) for x in range(31)} | {(y, x) for y in range(1, 6) for x in range(0, 31, 2)}
    rows = [(k, y, x) for k, cells in held.items() for y, x in cells]
    rows += rows[:5] + [("a", None, 1), (None, 1, 1)]
    found = planes.components(spark.createDataFrame(rows, "k string, y int, x int"), ["k"])
    told = {k: _plain_components(c) for k, c in held.items()}
    for k, parts in told.items():
        assert sorted(tuple(x)[1:] for x in found.where(F.col("k") == k).collect()) == parts
    top = {x["k"]: tuple(x)[1:] for x in planes.largest(found, ["k"]).collect()}
    assert top == {k: min(p, key=lambda c: (-c[2], c[0], c[1])) for k, p in told.items()}
    assert planes.components(spark.createDataFrame([], "k string, y int, x int"), ["k"]).count() == 0


def test_long_ways_are_linked_in_few_rounds(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    r = random.Random(2)
    r.shuffle(links)
    found = {x["node"]: x["root"] for x in planes.linked(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)}


@pytest.mark.parametrize("tile", [3, 16])
def test_second_differences(spark, tile):
    r = np.random.RandomState(3)
    held = {"a": r.rand(7, 10), "b": r.randint(0, 255, (5, 3)).astype(float), "line": r.rand(1, 6), "two": r.rand(2, 2), "dot": np.ones((1, 1)), "far": 1e6 + r.rand(6, 6)}
    rows = [(k, y, x, float(p[y, x])) for k, p in held.items() for y in range(p.shape[0]) for x in range(p.shape[1])] + [(None, 0, 0, 1.0)]
    found = planes.second_difference_variance(spark.createDataFrame(rows, "k string, y int, x int, v double"), ["k"], tile=tile)
    got = {x["k"]: x["variance"] for x in found.collect()}
    for k, p in held.items():
        pad = [np.pad(p, ((1, 1), (0, 0)), "reflect" if p.shape[0] > 1 else "edge"), np.pad(p, ((0, 0), (1, 1)), "reflect" if p.shape[1] > 1 else "edge")]
        d = pad[0][:-2] + pad[0][2:] + pad[1][:, :-2] + pad[1][:, 2:] - 4 * p
        assert got.pop(k) == pytest.approx(d.var(), abs=1e-6)
    assert not got


def test_dependent_dividers(spark):
    r = random.Random(4)
    cards = [(i, r.randint(50, 400)) for i in range(60)] + [(99, 0)]
    lines = [(i, r.randint(0, n)) for i, n in cards for _ in range(r.randint(0, 12))] + [(None, 5)]
    told = {}
    for i, total in cards:
        bounds, step = [0], total / 5
        for _ in range(4):
            guess = bounds[-1] + step
            near = sorted(x for k, x in lines if k == i and abs(x - guess) <= step * 0.4)
            bounds.append(min(near, key=lambda x: abs(x - guess)) if near else round(guess))
        told[i] = [*bounds, total]
    found = lattices.divided(spark.createDataFrame(cards, "k long, total long"), spark.createDataFrame(lines, "k long, x int"), ["k"], "total", "x")
    assert {x["k"]: x["bounds"] for x in found.collect()} == told
    # the second guess starts at the line that was taken for the first
    one = lattices.divided(spark.createDataFrame([(1, 100)], "k long, total long"), spark.createDataFrame([(1, 26), (1, 40), (1, 47)], "k long, x long"), ["k"], "total", "x").first()
    assert one["bounds"] == [0, 26, 47, 67, 87, 100]


def _plain_valley(profile):
    most, best, score = max(profile), None, max(profile)
    if most <= 0:
        return None
    for v in range(int(0.25 * len(profile)) + 1, int(0.75 * len(profile))):
        left = sum(profile[v - 5 : v]) if v >= 5 else 0
        right = sum(profile[v + 1 : v + 6])
        if profile[v] <= 0.06 * most and (left >= 0.3 * most or right >= 0.3 * most) and profile[v] < score:
            best, score = v, profile[v]
    return best


def test_valleys(spark):
    r = random.Random(5)
    profiles = [[r.choice([0, 0, 1, 2, r.randint(0, 60)]) for _ in range(r.randint(1, 40))] for _ in range(80)] + [[0] * 10, [5]]
    rows = [(i, p, v) for i, profile in enumerate(profiles) for p, v in enumerate(profile)]
    found = lattices.valleys(spark.createDataFrame(rows, "k int, p int, v int"), ["k"], "p", "v")
    told = {i: _plain_valley(p) for i, p in enumerate(profiles)}
    assert {x["k"]: x["valley"] for x in found.collect()} == {i: v for i, v in told.items() if v is not None}
    assert any(told.values())


def _plain_search(profile, top, bottom, own, base):
    def score(b):
        if any(not 0 <= x < len(profile) for x in b):
            return None
        return sum(profile[x] for x in b) / len(b)

    def best(family, rate):
        rated = [(rate(b), b) for b in family if b[-1] <= bottom + 8]
        rated = [x for x in rated if x[0] is not None]
        return max(rated, key=lambda x: x[0]) if rated else (None, None)

    lattice = lambda s, p: [s + round(p * k) for k in range(6)]
    pitch = max(40.0, (bottom - top) / 5.0)
    family = [lattice(s, p) for p in sorted({round(pitch * f) for f in (0.72, 0.8, 0.85, 0.9, 1.0, 1.1, 1.22)}) for s in sorted({round(top + o * pitch) for o in (-0.35, -0.2, -0.05, 0.1, 0.25)})]
    _, probe = best(family, lambda b: score([b[0], b[1], b[4], b[5]]))
    if probe is None:
        return None
    s, p = probe[0], probe[1] - probe[0]
    near = [lattice(b, a) for a in sorted({p, max(p - 3, round(p * 0.94)), min(p + 3, round(p * 1.06))}) for b in (s - 6, s, s + 6)]
    found, lines = best([own, *near], score)
    return lines if lines is not None and found >= 0.85 and found > base + 0.10 else None


def test_lattice_search(spark):
    r = random.Random(6)
    cards = []
    for i in range(60):
        top, bottom = r.randint(10, 60), r.randint(250, 380)
        cards.append((i, top, bottom, [top + j * ((bottom - top) // 5) for j in range(6)], r.choice([0.2, 0.6, 0.95]), [r.choice([0.0, 0.5, 1.0, 1.0]) for _ in range(r.choice([300, 420]))]))
    rows = spark.createDataFrame(cards, "k int, top int, bottom int, own array<int>, base double, profile array<double>")

    def rate(b):
        values = F.transform(b, lambda x: F.when(x >= 0, F.get("profile", x.cast("int"))))
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(b)

    probe = lambda b: rate(F.concat(F.slice(b, 1, 2), F.slice(b, 5, 2)))
    found = {x["k"]: x["found"] for x in lattices.better_lattice(rows, "top", "bottom", "own", "base", probe, rate).collect()}
    told = {c[0]: _plain_search(c[5], c[1], c[2], c[3], c[4]) for c in cards}
    assert found == told and any(told.values()) and not all(told.values())


def test_crops(spark):
    plane = [[r * 10 + c for c in range(6)] for r in range(5)]
    rows = spark.createDataFrame([(plane, 0, 5, 0, 6), (plane, 1, 4, 2, 9), (plane, 2, 4, 0, 6), (plane, 3, 9, 1, 6), (None, 0, 5, 0, 6)], "p array<array<int>>, a int, b int, c int, d int")
    found = [x[0] for x in rows.select(cropped(F.col("p"), *map(F.col, "abcd"), 1)).collect()]
    assert found == [[x[1:5] for x in plane[1:4]], [plane[2][3:6]], None, [plane[4][2:5]], None]


def test_cell_crops_round_single_precision(spark, tmp_path):
    import duckdb

    half = float(np.float32(0.0025))  # times 1000: 2.5 in single precision, less than that in double
    rows = [(i, [half, -half, 0.1, 0.5] * 16, 0) for i in range(420)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    told = con.sql(ORACLE_SQL["cell_crops"]).fetchall()
    assert sorted(map(tuple, QUERIES["cell_crops"](spark, str(tmp_path)).collect())) == sorted(told)
    assert any(c and "3" in c.split() for _, c in told)
