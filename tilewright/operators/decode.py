"""One-to-one decoding of score tables: the largest total score with every choice used once, and cards made of it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import WIDTH
from ..functions.patterns import CELLS, FREE_BIT, SIDE

#: Groups that are solved together; a step then holds some 120 MB.
GROUPS_AT_ONCE = 1_000
#: A choice without a score; no sum of scores comes near it.
_NONE = -(1 << 40)


@lru_cache(maxsize=64)
def _steps(n_choices: int, n_rows: int) -> list[np.ndarray]:
    """For each number of rows the sets of choices in order; for each set and each of its choices the place of the set without it."""
    sets = [list(combinations(range(n_choices), r)) for r in range(n_rows + 1)]
    out = []
    for r in range(1, n_rows + 1):
        place = {s: i for i, s in enumerate(sets[r - 1])}
        out.append(np.array([[(place[s[:j] + s[j + 1 :]], s[j]) for j in range(r)] for s in sets[r]]))
    return out


def solve(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, choices) of many score tables (group, row, choice) of integers; of equal totals the first in the order of choices.

    A dynamic programme over the sets of used choices, for all groups at once. A set's value is its best
    total, and below that in the same number the complement of its choices, so that one maximum finds both.
    """
    groups, rows, n = scores.shape
    bits = 4 * rows
    low = (1 << bits) - 1
    held = np.full((groups, 1), low, np.int64)
    for r, steps in enumerate(_steps(n, rows)):
        best = np.full((groups, len(steps)), np.iinfo(np.int64).min)
        for j in range(steps.shape[1]):
            before, choice = steps[:, j, 0], steps[:, j, 1]
            value = held[:, before] + (scores[:, r][:, choice] << bits) - (choice << (4 * (rows - 1 - r)))
            np.maximum(best, value, out=best)
        held = best
    top = held.max(axis=1)
    path = low - (top & low)
    return top >> bits, np.stack([path >> (4 * (rows - 1 - r)) & 15 for r in range(rows)], axis=1)


def assigned(
    scores: DataFrame, keys: list[str], row: str, choice: str, score: str, n_choices: int = WIDTH, unit: float = 1.0
) -> DataFrame:
    """(keys, total, picks): for each group the choices of its rows, no choice twice, of the largest total score.

    ``score`` is a whole number (scale and round it before), so totals are exact and ties are settled: the
    lower choice of the first row, then of the second, and so on. picks is an array of (row, choice, score,
    conf) in the order of rows; conf is the pick's share of the softmax over its row's scores times ``unit``.
    Only rows that have a score take part, at most five; a null score, or a pair that
    is missing, can't be chosen. A group in which the rows can't all have a choice has null total and picks.
    One shuffle brings a group's scores, at most 5 x 15, together; batches of groups are solved in numpy.
    """
    held = scores.where(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.collect_list(F.struct(F.col(row).cast("int").alias("r"), F.col(choice).cast("int").alias("c"), F.col(score).cast("long").alias("s"))).alias("_all")
    )
    pick = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("choice", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("conf", T.DoubleType())])
    schema = T.StructType([*held.select(*keys).schema.fields, T.StructField("total", T.LongType()), T.StructField("picks", T.ArrayType(pick))])
    picks_type = pa.list_(pa.struct([("row", pa.int32()), ("choice", pa.int32()), ("score", pa.int64()), ("conf", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, GROUPS_AT_ONCE):
                batch = whole.slice(at, GROUPS_AT_ONCE)
                totals: list = [None] * batch.num_rows
                picks: list = [None] * batch.num_rows
                by_size: dict[int, list[tuple[int, list[int], np.ndarray]]] = {}
                for i, cells in enumerate(batch.column("_all").to_pylist()):
                    rows = sorted({x["r"] for x in cells})
                    table, place = np.full((len(rows), n_choices), _NONE, np.int64), {r: k for k, r in enumerate(rows)}
                    for x in cells:
                        table[place[x["r"]], x["c"]] = max(table[place[x["r"]], x["c"]], x["s"])
                    by_size.setdefault(len(rows), []).append((i, rows, table))
                for some in by_size.values():
                    found, chosen = solve(np.stack([t for _, _, t in some]))
                    for (i, rows, table), total, path in zip(some, found.tolist(), chosen.tolist(), strict=True):
                        scores_of = [int(table[k, c]) for k, c in enumerate(path)]
                        if min(scores_of) > _NONE:
                            totals[i] = total
                            odds = np.exp((table - table.max(axis=1, keepdims=True)) * unit)
                            conf = (odds[np.arange(len(rows)), path] / odds.sum(axis=1)).tolist()
                            picks[i] = [dict(zip(("row", "choice", "score", "conf"), x, strict=True)) for x in zip(rows, path, scores_of, conf, strict=True)]
                kept = [batch.column(k) for k in keys]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(totals, pa.int64()), pa.array(picks, picks_type)], names=[*keys, "total", "picks"])

    return held.select(*keys, "_all").mapInArrow(run, schema)


def card_cells(value: Column, conf: Column) -> Column:
    """25 structs (value, is_free_space, valid, raw, confidence) of arrays of 25 values and their confidences from 0 to 1.

    The free cell is valid and certain; another cell is valid if it has a value. Confidences are in percent to one place.
    """

    def cell(v: Column, i: Column) -> Column:
        free = i == FREE_BIT
        percent = F.when(free, 100.0).otherwise(F.round(F.coalesce(F.get(conf, i), F.lit(0.0)) * 100, 1))
        return F.struct(
            F.when(~free, v).alias("value"), free.alias("is_free_space"), (free | v.isNotNull()).alias("valid"),
            F.when(free, F.lit("FREE")).otherwise(v.cast("string")).alias("raw"), percent.alias("confidence"),
        )

    return F.transform(value, cell)


def read_cards(decoded: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, value, conf): arrays of 25 from the decoded columns (``assigned``) of each card; cells without a pick are null and 0.

    ``column`` is the column's place, 0 to 4.
    """
    rows = decoded.select(*keys, F.col(column).alias("_c"), F.explode("picks").alias("p"))
    cell = F.struct((F.col("_c") * WIDTH + F.col("p.choice") + 1).alias("v"), F.col("p.conf").alias("c"))
    found = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("p.row") * SIDE + F.col("_c"), cell))).alias("m"))
    of = lambda name: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.try_element_at("m", i)[name])
    return found.select(*keys, of("v").alias("value"), F.transform(of("c"), lambda c: F.coalesce(c, F.lit(0.0))).alias("conf"))


def needs_review(value: Column, conf: Column, blur: Column | None = None, mean: float = 0.55, least: float = 0.08, sharp: float = 500.0) -> Column:
    """Whether a card should be looked at: a cell without a value, low mean or least confidence, or a blurred image.

    The free cell does not count; a null blur is none.
    """
    others = F.filter(conf, lambda _, i: i != FREE_BIT)
    total = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
    missing = F.exists(F.transform(value, lambda v, i: v.isNull() & (i != FREE_BIT)), lambda x: x)
    unsure = (total / F.size(others) < mean) | (F.array_min(others) < least)
    return missing | unsure | (F.coalesce(blur < sharp, F.lit(False)) if blur is not None else F.lit(False))
