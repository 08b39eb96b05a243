"""Exact quantiles against numpy: outliers, ties, null groups, huge ranges, and ranges cut again and again."""

import random

import numpy as np
import pytest

from tilewright.operators import quantiles

SHARES = [0.0, 0.02, 0.25, 0.5, 0.98, 1.0]


def told(rows, shares):
    groups = {}
    for k, x in rows:
        if x is not None and x == x:
            groups.setdefault(k, []).append(x)
    return {(k, i): float(np.quantile(v, s)) for k, v in groups.items() for i, s in enumerate(shares)}


def found(spark, rows, shares, keys=("k",)):
    df = spark.createDataFrame(rows, "k string, x double")
    return {(r["k"] if keys else None, r["i"]): r["value"] for r in quantiles.exact(df, list(keys), "x", shares).collect()}


@pytest.mark.parametrize("few, parts", [(50_000, 4096), (3, 4), (1, 2)])
def test_quantiles_of_groups(spark, monkeypatch, few, parts):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "PARTS", parts)
    r = random.Random(5)
    rows = [(k, r.choice([r.random(), float(r.randint(0, 3)), 1e12 * r.random()])) for k in ("a", "b", None) for _ in range(60)]
    rows += [("ties", 2.0)] * 30 + [("one", -3.5), ("nulls", None), ("a", None), ("a", float("nan")), (None, 1e12), ("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.0)]
    assert found(spark, rows, SHARES[1:5]) == pytest.approx(told([x for x in rows if x[0] != "wide"], SHARES[1:5]) | {("wide", i): v for i, v in enumerate(_wide())}, rel=1e-9)


def _wide():
    return [float(np.quantile([-1.7, 0.0, 1.7], s)) * 1e308 for s in SHARES[1:5]]


def test_an_outlier_costs_a_step_only(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 500)
    values = [i / 7 for i in range(20_000)] + [1e12, -1e300]
    assert found(spark, [(None, v) for v in values], [0.5, 0.9]) == pytest.approx(told([(None, v) for v in values], [0.5, 0.9]))


def test_no_keys_infinite_values_and_empty_tables(spark):
    rows = [("x", 1.0), ("y", 5.0), ("z", 2.0)]
    assert found(spark, rows, [0.5], keys=()) == {(None, 0): 2.0}
    assert found(spark, [("x", float("inf")), ("x", 1.0), ("x", 0.0)], [0.5, 1.0]) == {("x", 0): 1.0, ("x", 1): 1.7976931348623157e308}
    assert found(spark, [("x", None)], [0.5]) == {}
