import datetime as dt
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tilewright.functions import cards, numbers
from tilewright.operators import metrics, nearest, signals
from tilewright.sources import files, manifests, store, text
from tilewright.streaming import pending

TRUTH = """#blue_sheet_003:
#card1
[8, 21, 33, 50, 66]
[2, FREE, 40]

#card2
[14, 16]
#blue_sheet_020:
[4, 4]
#card1
[7]
"""
DICTATED = "y/shot_7.jpg:\nCard two:\nthree, 12, 6, fourteen, 8,\n16, 30, 21, 27, nineteen, 31, 44, 38, 36, 60, 46, 55, 49, 52, 62, 75, 70, 64, what\n"


def test_truth_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TRUTH)
    rows = text.truth_cells(text.numbered_lines(spark, str(tmp_path))).collect()
    found = {(r["sheet"], r["card"], r["r"], r["c"]): r["value"] for r in rows}
    assert len(found) == len(rows) == 11  # numbers before a card are left out
    assert found[3, 1, 0, 4] == 66 and found[3, 1, 1, 1] is None and found[3, 2, 0, 1] == 16 and found[20, 1, 0, 0] == 7


def test_dictated_cards(spark, tmp_path):
    (tmp_path / "a.txt").write_text(DICTATED)
    rows = text.dictated_cells(text.numbered_lines(spark, str(tmp_path))).collect()
    found = {(r["r"], r["c"]): r["value"] for r in rows}
    assert len(rows) == 24 and (2, 2) not in found and {(r["image"], r["card"]) for r in rows} == {("y/shot_7.jpg", 2)}
    assert found[0, 0] == 3 and found[3, 0] == 14 and found[4, 1] == 19 and found[1, 2] == 44 and found[3, 2] == 38 and found[0, 3] == 60 and found[0, 4] == 62
    assert [(r["r"], r["c"]) for r in rows if r["bad"]] == [(4, 4)]


def test_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in (" seven,", "FREE", "Nineteen", "015", "twenty", "", None, "99999999999")], "t string")
    found = rows.select(numbers.number_of(F.col("t")), numbers.is_free(F.col("t"))).collect()
    assert [r[0] for r in found] == [7, None, 19, 15, None, None, None, 99999999999] and [r[1] for r in found][1] is True
    waits = spark.range(7).select(numbers.backoff_ms(F.col("id"), F.lit(0.5)), numbers.digit_pair(F.col("id"), F.lit(3))).collect()
    assert [r[0] for r in waits] == [1150.0 * min(2**i, 30) for i in range(7)] and waits[4][1] == 43


def test_snapping(spark):
    r = random.Random(2)
    marks = [(r.randint(0, 3), r.randint(0, 60)) for _ in range(60)]
    goals = [(r.randint(0, 4), r.randint(0, 60), i) for i in range(80)]
    rows = nearest.snapped(spark.createDataFrame(goals, "k int, x long, id int"), spark.createDataFrame(marks, "k int, x long"), ["k"], "x", 3)
    told = {}
    for k, x, i in goals:
        near = sorted((abs(m - x), m) for q, m in marks if q == k and abs(m - x) <= 3)
        told[i] = near[0][1] if near else None
    assert {q["id"]: q["snapped_to"] for q in rows.collect()} == told


def test_nearest_vectors(spark):
    r = random.Random(3)
    held = [(i, [float(r.randint(0, 3)) for _ in range(4)]) for i in range(150)] + [(150, None)]
    rows = spark.createDataFrame(held, "id long, v array<float>").repartition(3)
    found = {(q["query"], q["rank"]): q["neighbour"] for q in nearest.k_nearest(rows.where("id % 10 = 0"), rows, "id", "v", 3).collect()}
    for q in range(0, 150, 10):
        order = sorted((round(sum((a - b) ** 2 for a, b in zip(held[q][1], v, strict=True)) ** 0.5, 4), i) for i, v in held if v and i != q)
        assert [found[q, k] for k in (1, 2, 3)] == [i for _, i in order[:3]]
    assert len(found) == 45 and nearest.k_nearest(rows.limit(0), rows, "id", "v").isEmpty()


def test_indexed_neighbours(spark):
    """Recall against brute force on the table, exactness with all cells probed, a common vector, nulls and empty tables."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    asked = rows.where("vec_id % 100 = 0")
    pairs = lambda df: {(r["query"], r["rank"]): r["neighbour"] for r in df.collect()}
    told, found = pairs(nearest.k_nearest(asked, rows, "vec_id", "embedding")), pairs(nearest.indexed_nearest(asked, rows, "vec_id", "embedding"))
    recall = sum((q, n) in {(a, m) for (a, _), m in told.items()} for (q, _), n in found.items()) / len(told)
    assert recall >= 0.9
    r = random.Random(6)
    held = [(i, [float(r.randint(0, 9)) for _ in range(3)]) for i in range(200)] + [(200 + i, [1.0, 2.0, 3.0]) for i in range(150)] + [(999, None)]
    small = spark.createDataFrame(held, "id long, v array<float>").repartition(4)
    exact = nearest.indexed_nearest(small, small, "id", "v", 3, share=1.0)
    assert pairs(exact) == pairs(nearest.k_nearest(small, small, "id", "v", 3))
    assert nearest.indexed_nearest(small.limit(0), small.limit(0), "id", "v").isEmpty()


def test_spaced_peaks(spark):
    r = random.Random(4)
    series = [(k, p, r.randint(0, 9)) for k in range(5) for p in range(20 * k)]
    found = signals.spaced_peaks(spark.createDataFrame(series, "k int, pos int, v int"), ["k"], "pos", "v", 5).collect()
    told = set()
    for k in range(5):
        kept = []
        for _, p in sorted((-v, p) for q, p, v in series if q == k):
            if len(kept) < 3 and all(abs(p - x) >= 5 for x in kept):
                kept.append(p)
        told |= {(k, p) for p in kept}
    assert {(x["k"], x["pos"]) for x in found} == told


def test_label_metrics(spark):
    share = lambda rows: spark.createDataFrame(rows, "c int, correct long, total long")
    found = metrics.worst_classes(share([(1, 9, 10), (2, 5, 10), (3, 1, 1)]), share([(1, 8, 10), (2, 5, 10), (4, 1, 1)]), "c").collect()
    assert [(r["c"], r["was"], r["now"]) for r in found] == [(3, 1.0, 0.0), (1, 0.9, 0.8)]
    rows = spark.createDataFrame([("a", 5, 5), ("a", 5, 7), ("a", 5, None), ("b", None, None)], "k string, t int, p int")
    assert {tuple(r) for r in metrics.group_errors(rows, ["k"], "t", "p").collect()} == {("a", 1, 2, 500.5), ("b", 1, 0, None)}


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, "train", 5), (2, "valid", 6)], "id long, split string, label int")
    for _ in range(4):
        store.save_snapshot(rows, root)
    last = store.load_snapshot(spark, root).count()
    assert store.keep_last(spark, root, 2) == 2 and store.keep_last(spark, root, 2) == 0
    assert store.load_snapshot(spark, root).count() == last == 2
    text.write_manifest(rows, str(tmp_path / "m"), "split")
    assert spark.read.csv(str(tmp_path / "m" / "split=train"), header=True).collect()[0]["label"] == "5"
    aged = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9)), (3, None)], "id long, ts timestamp")
    kept, gone = store.aged_out(aged, "ts", F.lit(dt.datetime(2024, 1, 10)), 7)
    assert {r["id"] for r in kept.collect()} == {2, 3} and {r["id"] for r in gone.collect()} == {1}
    assert store.aged_out(aged, "ts", F.lit(dt.datetime(2024, 1, 10)), 0)[1].count() == 3


def test_pending_scans_of_a_stream(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    scans = spark.createDataFrame([("a", at(1)), ("b", at(1)), ("c", at(1)), ("z", at(40))], "scan_id string, scan_ts timestamp")
    ends = spark.createDataFrame([("a", at(2), "confirmed"), ("b", at(3), "rejected"), ("c", at(9), "confirmed"), ("y", at(40), "confirmed")], "scan_id string, end_ts timestamp, kind string")
    scans.write.parquet(str(tmp_path / "s"))
    ends.write.parquet(str(tmp_path / "e"))
    batch = {r["scan_id"]: r["outcome"] for r in pending.scan_outcomes(scans, ends).collect()}
    assert batch == {"a": "confirmed", "b": "rejected", "c": "expired", "z": "expired"}
    read = lambda df, name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    out = pending.scan_outcomes(read(scans, "s"), read(ends, "e"))
    run = out.writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = {r["scan_id"]: r["outcome"] for r in spark.table("outcomes").collect()}
    assert found == {k: batch[k] for k in "abc"}  # z is still open


def test_random_grids(spark):
    rows = spark.range(200).select("id", cards.random_grid(F.col("id"), "s").alias("g"), cards.random_grid(F.col("id"), "s").alias("h"), cards.random_grid(F.col("id"), "t").alias("o"))
    found = rows.select("g", cards.mismatches(F.col("g"), F.col("h")), cards.mismatches(F.col("g"), F.col("o"))).collect()
    for g, same, other in found:
        assert len(g) == 25 and g[12] == 0 and len({*g}) == 25 and same == 0 and other > 5
        assert all(n == 0 or i % 5 * 15 < n <= i % 5 * 15 + 15 for i, n in enumerate(g))
    called = spark.range(1).select(*cards.call_positions(F.array(*map(F.lit, found[0][0])), [found[0][0][3], 75, found[0][0][3]])).first()
    assert called[3] == 1 and called[12] == 0 and called[0] > 1000


def test_files(spark, tmp_path):
    for name in ("17/170_ab12cd_c1_r2c3_x.jpg", "17/171_c2_r0c4.PNG", "17/.hid.jpg", "17/a.txt", "x/9.jpg", "b/5/abc_c1.jpeg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    rows = files.labelled_files(spark, str(tmp_path))
    parts = files.cell_name(F.col("name"))
    found = {r["name"]: tuple(r)[1:] for r in rows.select("name", "label", "length", *[c.alias(k) for k, c in parts.items()]).collect()}
    assert found == {
        "170_ab12cd_c1_r2c3_x.jpg": (17, 3, 170, "ab12cd", 1, 2, 3, True), "171_c2_r0c4.PNG": (17, 3, 171, None, 2, 0, 4, False),
        "abc_c1.jpeg": (5, 3, None, None, None, None, None, False),
    }
    without = spark.createDataFrame([(171,)], "sheet long")
    assert {r["name"] for r in files.labelled_files(spark, str(tmp_path), without=without).collect()} == {"170_ab12cd_c1_r2c3_x.jpg", "abc_c1.jpeg"}


def test_names_and_writes(spark, tmp_path):
    name = files.format_name(F.lit(170), F.lit("ab12cd"), F.lit(1), F.lit(2), F.lit(3), F.col("id") == 1)
    found = spark.range(2).select(name.alias("n"), *[c.alias(k) for k, c in files.cell_name(name).items()]).collect()
    assert [tuple(r) for r in found] == [("170_ab12cd_c1_r2c3.jpg", 170, "ab12cd", 1, 2, 3, False), ("170_ab12cd_c1_r2c3_x.jpg", 170, "ab12cd", 1, 2, 3, True)]
    rows, root = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (2, 7, "c")], "id long, label int, image string"), str(tmp_path / "l")
    assert files.new_by_label(rows, None, ["id"], root, "label").count() == 2
    files.new_by_label(rows.union(spark.createDataFrame([(3, 6, "d")], rows.schema)), spark.read.parquet(root), ["id"], root, "label")
    assert sorted((r["id"], r["label"]) for r in spark.read.parquet(root).collect()) == [(1, 5), (2, 6), (3, 6)]
    lines, text_root = spark.createDataFrame([("x",)], "value string"), str(tmp_path / "t")
    assert files.append_text(lines, text_root, str(tmp_path / "b")) is None
    copy = files.append_text(lines, text_root, str(tmp_path / "b"))
    assert spark.read.text(copy).count() == 1 and spark.read.text(text_root).count() == 2
    ids = spark.createDataFrame([(None, "a"), (1, "a")], "k long, t string").select(files.stable_id("k", "t"), files.digits_of(F.lit("a-1b2")), files.digits_of(F.lit("x"))).collect()
    assert ids[0][0] != ids[1][0] and len(ids[0][0]) == 32 and ids[0][1:] == ("12", None)


def test_manifest_file(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"10": {"cards": 3, "note": null}, "9": {"cards": 1, "note": "n"}, "b": {"cards": 2}}')
    rows = manifests.read_cases(spark, str(tmp_path / "m.json"), "cards int, note string").orderBy("place").collect()
    assert [(r["key"], r["case"]["cards"], r["place"]) for r in rows] == [("9", 1, 1), ("10", 3, 2), ("b", 2, 3)]


def test_many_queries_use_the_index_alike(spark, monkeypatch):
    r = random.Random(6)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(999, None)], "id long, v array<float>")
    centres, asked = nearest.fit_centres(rows, "id", "v"), rows.where("id % 10 = 0 or id = 999")
    sent = nearest.indexed_nearest(asked, rows, "id", "v", 3, 0.3, centres).collect()
    monkeypatch.setattr(nearest, "MOST_SENT", 5)
    joined = nearest.indexed_nearest(asked, rows, "id", "v", 3, 0.3, centres).collect()
    assert sorted(map(tuple, sent)) == sorted(map(tuple, joined)) and len(sent) == 90


def test_neighbours_in_bounded_memory():
    """Tables of distances are made in parts: a batch of rows by all centres, and by all queries, whatever their number."""
    r = np.random.default_rng(1)
    v, centres, rows = r.random((3_000, 4)), r.random((2_500, 4)), r.random((3_000, 4)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3_000)), pa.FixedSizeListArray.from_arrays(rows.ravel(), 4).cast(pa.list_(pa.float32()))], names=["id", "v"])
    tracemalloc.start()
    cells = nearest._cells(v, centres, 1)
    told = list(nearest._probe(np.arange(9_000, 12_000), v.astype(np.float32), 2)(iter([batch])))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # 3,000 by 2,500 distances and their order take 120 MB
    far = ((v[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cells[:, 0] == far.argmin(axis=1)).all()
    assert told.num_rows == 6_000
    first = ((v[:50].astype(np.float32).astype(float)[:, None] - rows.astype(float)[None]) ** 2).sum(axis=2).min(axis=1) ** 0.5
    assert np.allclose(told.column("distance").to_numpy()[:100:2], first, atol=1e-4)


def test_few_and_many_queries_have_the_same_neighbours(spark, monkeypatch):
    r = random.Random(8)
    held = [(i, [float(r.randint(0, 2)) for _ in range(3)]) for i in range(200)] + [(7, [0.0, 0.0, 0.0]), (500, None)]
    rows = spark.createDataFrame(held, "id long, v array<float>").repartition(3)
    asked = rows.where("id % 10 = 0 or id = 500")
    sent = nearest.k_nearest(asked, rows, "id", "v", 4)
    assert "NestedLoop" not in sent._jdf.queryExecution().toString()  # no pairs of blocks
    few = sorted(map(tuple, sent.collect()))
    monkeypatch.setattr(nearest, "MOST_SENT", 3)
    assert few == sorted(map(tuple, nearest.k_nearest(asked, rows, "id", "v", 4).collect())) and len(few) == 80
    monkeypatch.setattr(nearest, "PAIRS", 50)
    monkeypatch.setattr(nearest, "MOST_SENT", 300)
    assert few == sorted(map(tuple, nearest.k_nearest(asked, rows, "id", "v", 4).collect()))


def test_many_queries_meet_the_rows_in_lots(spark, monkeypatch):
    """No pairs of blocks are copied; lots and parts that share a task, and batches that end within them, change nothing."""
    r = random.Random(9)
    held = [(i, [float(r.randint(0, 3)) for _ in range(4)]) for i in range(300)] + [(7, [0.0, 0.0, 0.0, 0.0]), (500, None)]
    rows = spark.createDataFrame(held, "id long, v array<float>").repartition(3)
    asked = rows.where("id % 5 = 0 or id = 500")
    few = sorted(map(tuple, nearest.k_nearest(asked, rows, "id", "v", 3).collect()))
    monkeypatch.setattr(nearest, "MOST_SENT", 25)
    monkeypatch.setattr(nearest, "ROWS_MET", 70, raising=False)
    many = nearest.k_nearest(asked, rows, "id", "v", 3)
    plan = many._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert few == sorted(map(tuple, many.collect())) and len(few) == 180
    met = nearest._meetings(*(nearest._vectors(x, "id", "v") for x in (asked, rows))).coalesce(1).sortWithinPartitions("meeting", "row")
    assert met.select("meeting").distinct().count() == 15
    whole = met.toArrow().combine_chunks().to_batches()[0]
    for size in (1, 7, 1_000):
        told = pa.Table.from_batches(nearest._met(3)(whole.slice(at, size) for at in range(0, whole.num_rows, size))).to_pylist()
        best = {}
        for x in sorted(told, key=lambda x: (x["query"], x["distance"], x["neighbour"])):
            best.setdefault(x["query"], []).append((x["neighbour"], x["distance"]))
        assert few == sorted((q, n, d, i + 1) for q, near in best.items() for i, (n, d) in enumerate(near[:3]))
