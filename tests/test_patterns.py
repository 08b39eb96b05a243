import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import labels, patterns as p
from tilewright.operators import replay
from tilewright.sources import store
from tilewright.streaming import games

TEXT = """
# masks
MASK top
XXXXX
-----
-----
-----
-----
MASK left
x----
x----
x----
x----
x----
PATTERN both
AND
    top
    left
PATTERN some
OR
    AtLeast(top, 3)
    AND
        left
        AtMost(top, 1)
"""


def test_parser():
    found = p.parse(TEXT)
    assert found["both"] == p.All((p.Mask(31), p.Mask(p.col_mask(0))))
    assert found["some"] == p.Any((p.AtLeast(31, 3), p.All((p.Mask(p.col_mask(0)), p.AtMost(31, 1)))))


_MASK = "MASK {}\nXXXXX\n-----\n-----\n-----\n-----\n"


@pytest.mark.parametrize(
    "text",
    [
        "MASK a\nXXXX\n-----\n-----\n-----\n-----", "MASK a\nXXXXY\n-----\n-----\n-----\n-----", "MASK a\nXXXXX", _MASK.format("a") * 2,
        "PATTERN x\nnone", "PATTERN x", "PATTERN x\nPATTERN y\nOR", TEXT + "PATTERN both\nOR\n top", TEXT + _MASK.format("more"),
        TEXT + "PATTERN q\ntop", TEXT + "PATTERN q\nand\n  top", TEXT + "PATTERN q\nAND\n  top\n  nothing", TEXT + "PATTERN q\nOR\n  and",
        *[TEXT + f"PATTERN q\nOR\n  {rule}" for rule in ("AtLeast(top, 26)", "AtLeast(top, -1)", "AtLeast(top)", "AtMost(no, 1)", "atleast(top, 1)", "AtLeast(top, 1) x")],
    ],
)
def test_parser_refuses(text):
    with pytest.raises(p.PatternError):
        p.parse(text)


def test_parser_accepts():
    """Parts indented as they like, operators without parts, lines that belong to nothing, names with odd characters."""
    text = "title\n" + _MASK.format("a\\b c") + "# note\nPATTERN q\n  AND\n     a\\b c\n    OR\n          AND\n       AtMost(x-1, 0)\n   AtLeast(x-1,25)\nstray\n     more\n\nPATTERN r\nOR\nrest\nPATTERN s\nAND\n a\\b c"
    found = p.parse(_MASK.format("x-1") + text)
    m = p.Mask(31)
    assert found == {"q": p.All((m, p.Any((p.All(()), p.AtMost(31, 0))), p.AtLeast(31, 25))), "r": p.Any(()), "s": p.All((m,))}
    assert p.parse("") == {} and p.parse("MASK\nPATTERN\n MASK a\n") == {}


def test_named_patterns():
    assert len(p.PATTERNS["six_pack"].parts) == 24
    assert p.row_mask(0) == 31 and p.col_mask(0) == 1082401 and p.DIAGONALS == (17043521, 1118480)
    assert p.holds_for(p.Mask(0), 0) and p.holds_for(p.All(()), 0) and not p.holds_for(p.Any(()), 0)


def _tree(r, depth=0):
    kind = r.choice("maao" if depth < 2 else "ml")
    if kind in "ml" or depth > 2:
        bits = r.getrandbits(25) & r.getrandbits(25) & r.getrandbits(25)
        return p.Mask(bits) if kind == "m" else p.AtLeast(bits, r.randint(0, 5))
    return (p.All if kind == "a" else p.Any)(tuple(_tree(r, depth + 1) for _ in range(r.randint(0, 3))))


def test_closed_form_equals_replay(spark):
    r = random.Random(5)
    order = [b for b in r.sample(range(25), 25) if b != p.FREE_BIT][:18]
    positions = [F.lit(0 if b == p.FREE_BIT else order.index(b) + 1 if b in order else p.NEVER).cast("long") for b in range(25)]
    trees = [_tree(r) for _ in range(60)]
    row = spark.range(1).select(*[p.first_win(t, positions).alias(f"t{i}") for i, t in enumerate(trees)]).first()
    for i, tree in enumerate(trees):
        marked, first = 1 << p.FREE_BIT, 0 if p.holds_for(tree, 1 << p.FREE_BIT) else p.NEVER
        for k, b in enumerate(order, 1):
            marked |= 1 << b
            if first == p.NEVER and p.holds_for(tree, marked):
                first = k
        assert row[i] == first


def test_holds_column(spark):
    r = random.Random(6)
    trees = [_tree(r) for _ in range(30)] + [p.AtMost(31, 2)]
    marks = [r.getrandbits(25) for _ in range(20)]
    rows = spark.createDataFrame([(m,) for m in marks], "m int").select("m", *[p.holds(t, F.col("m")).alias(f"t{i}") for i, t in enumerate(trees)])
    for row in rows.collect():
        assert [*row[1:]] == [p.holds_for(t, row["m"]) for t in trees]


def _tree_that_stops(r, depth=0):
    kind = r.choice("ao" if depth < 1 else "aomlx" if depth < 3 else "mlxx")
    bits = r.getrandbits(25) & (r.getrandbits(25) | r.getrandbits(25))
    if kind in "mlx":
        return p.Mask(bits & r.getrandbits(25)) if kind == "m" else (p.AtLeast if kind == "l" else p.AtMost)(bits, r.randint(0, 6))
    return (p.All if kind == "a" else p.Any)(tuple(_tree_that_stops(r, depth + 1) for _ in range(r.randint(0, 3))))


def _spans(tree, order):
    """Where a pattern holds, by marking one call after the other."""
    marked, out = 1 << p.FREE_BIT, []
    for at, bit in enumerate([None, *order]):
        marked |= 0 if bit is None else 1 << bit
        out.append(p.holds_for(tree, marked))
    found, since = [], None
    for at, ok in enumerate([*out, False]):
        if ok and since is None:
            since = at
        elif not ok and since is not None:
            found.append((since, at if at < len(out) else p.NEVER))
            since = None
    return found, next((at for at, ok in enumerate(out) if ok and at > 0), p.NEVER)


def test_spans_of_patterns_that_stop_holding(spark):
    """Random trees with AtMost, on calls of all or some cells, against a replay."""
    r = random.Random(12)
    trees = [_tree_that_stops(r) for _ in range(28)] + [p.AtMost(31, -1), p.AtMost(31, 0), p.AtMost(31, 9), p.All((p.AtMost(31, 9), p.Any(()))), p.AtLeast(31, 0)]
    assert sum(map(p._has_at_most, trees)) > 15
    for _ in range(2):
        order = r.sample(range(25), r.randint(1, 25))
        at = {bit: i for i, bit in enumerate(order, 1)} | {p.FREE_BIT: 0}
        places = [F.lit(at.get(i, p.NEVER)).cast("long") for i in range(25)]
        spans = [p.holding(t, places).alias(f"s{i}") for i, t in enumerate(trees)]
        wins = [p.first_hold(t, places, F.lit(1).cast("long")).alias(f"w{i}") for i, t in enumerate(trees)]
        row = spark.range(1).select(*spans, *wins).first()
        for i, t in enumerate(trees):
            assert ([tuple(x) for x in row[f"s{i}"]], row[f"w{i}"]) == _spans(t, order), (t, order)


def test_win_sequence_with_at_most_equals_the_replay(spark):
    r = random.Random(13)
    rows = [(c, s, r.randint(0, 24)) for c in range(40) for s in range(1, r.randint(2, 60))]
    calls = spark.createDataFrame(rows, "card long, seq long, bit int")
    trees = [t for t in (_tree_that_stops(r) for _ in range(40)) if p._has_at_most(t)][:6]
    for tree in trees:
        told = replay.replayed(calls, "card", F.col("bit"), F.col("seq"), tree).where("won").groupBy("card").agg(F.min("seq").alias("win_seq"))
        found = replay.win_sequence(calls, "card", F.col("bit"), ["seq"], tree)
        assert {tuple(x) for x in found.collect()} == {tuple(x) for x in told.collect()}


def test_labels(spark):
    rows = spark.createDataFrame([("52",), (" g52 ",), ("B52",), ("0",), ("76",), ("x",), (None,), ("99999999999999999999",), ("007",)], "t string")
    found = rows.select(labels.lenient_label(F.col("t")), labels.strict_label(F.col("t"))).collect()
    assert [tuple(r) for r in found] == [
        ("G52", "G52"), ("G52", "G52"), ("B52", None), ("O0", None), ("O76", None), ("X", None), (None, None),
        ("O99999999999999999999", None), ("B7", "B7"),
    ]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(u, s, (s * (u + 3)) % 25) for u in range(6) for s in range(1, 40)], "user_id long, seq long, bit int")
    path = str(tmp_path / "in")
    rows.where("seq < 20").write.parquet(path)
    rows.where("seq >= 20").write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(path)
    wins = games.running_wins(stream, "user_id", p.PATTERNS["standard"])
    run = wins.writeStream.format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = {r["user_id"]: r["seq"] for r in spark.table("wins").collect()}
    told = replay.win_sequence(rows, "user_id", F.col("bit"), ["seq"], p.PATTERNS["standard"]).collect()
    assert found == {r["user_id"]: r["win_seq"] for r in told}


def test_repeated_calls_announce_nothing(spark, tmp_path):
    """A stream of calls, with repeats and calls off the card: the calls that mark a new cell and leave the pattern holding."""
    r = random.Random(8)
    rows = [(u, s, r.choice([None, *range(25)])) for u in range(4) for s in range(1, 120)]
    told, pattern = [], p.PATTERNS["standard"]
    for u in range(4):
        marked = 1 << p.FREE_BIT
        for _, s, bit in (x for x in rows if x[0] == u):
            if bit is not None and not marked >> bit & 1:
                marked |= 1 << bit
                if p.holds_for(pattern, marked):
                    told.append((u, s, marked))
    table, path = spark.createDataFrame(rows, "user_id long, seq long, bit int"), str(tmp_path / "in")
    for a, b in ((1, 40), (40, 41), (41, 200)):
        table.where(f"seq >= {a} and seq < {b}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 100).parquet(path)
    wins = games.running_wins(stream, "user_id", pattern, once=False)
    run = wins.writeStream.format("memory").queryName("again").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(tuple(x) for x in spark.table("again").collect()) == sorted(told)
    first = {u: min(s for v, s, _ in told if v == u) for u, _, _ in told}
    found = replay.win_sequence(table, "user_id", F.col("bit"), ["seq"], pattern).collect()
    assert {x["user_id"]: x["win_seq"] for x in found} == first


def test_unique_calls(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, f"2024-01-01 00:0{i}:00") for i in range(3)] + [(1, 6, "2024-01-01 00:05:00")], "game long, number int, ts string")
    rows = rows.withColumn("ts", F.to_timestamp_ntz("ts"))
    assert games.unique_calls(rows, ["game", "number"], "ts").count() == 2
    rows.write.parquet(str(tmp_path / "u"))
    stream = games.unique_calls(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "u")), ["game", "number"], "ts")
    run = stream.writeStream.format("memory").queryName("unique").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("unique").count() == 2


def test_store(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, '{"a": 5}'), (2, "{not json"), (3, "{}"), (4, None)], "id long, blob string")
    assert not store.save_snapshot(rows.limit(0), root)
    assert store.save_snapshot(rows.limit(1), root) and store.save_snapshot(rows, root)
    good, broken = store.restored(store.load_snapshot(spark, root), "blob", spark.createDataFrame([], "a int").schema, {"a": -1})
    assert {r["id"]: r["a"] for r in good.collect()} == {1: 5, 3: -1}
    assert {r["id"] for r in broken.collect()} == {2, 4}
