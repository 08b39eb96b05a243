"""Running sums and last values against a loop, with plain windows and with keys that lie in many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import running


@pytest.mark.parametrize("most", [1_000_000, 3])
@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("falling", [False, True])
def test_running(spark, monkeypatch, most, before, falling):
    monkeypatch.setattr(running, "MOST_IN_ONE", most)
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([1, None]), i, r.choice([None, r.randint(0, 9)])) for i in range(300)]
    told, state = {}, {}
    for k, j, i, v in sorted(rows, key=lambda x: x[2], reverse=falling):
        total, last = state.get((k, j), (0, None))
        after = (total + (v or 0), last if v is None or v < 5 else v)
        told[i] = (total, last) if before else after
        state[k, j] = after
    table = spark.createDataFrame(rows, "k string, j int, i int, v int").repartition(5)
    order = [F.col("i").desc() if falling else "i"]
    found = running.running(table, ["k", "j"], order, {"total": F.col("v")}, {"last": F.when(F.col("v") >= 5, F.col("v"))}, before)
    assert found.columns == ["k", "j", "i", "v", "total", "last"]
    assert {x["i"]: (x["total"], x["last"]) for x in found.collect()} == told
    assert running.running(table.limit(0), ["k", "j"], order, {"total": F.col("v")}).count() == 0
