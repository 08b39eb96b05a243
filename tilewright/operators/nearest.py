"""Nearest-neighbour joins: on a line within a tolerance, and between vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of a cell; a pair of blocks of 64 dimensions takes 16 KB, and Spark sends at most 10,000 rows at once.
BLOCK = 32
#: Queries that are sent to the tasks at most; more of them meet the rows in lots of as many.
MOST_SENT = 20_000
#: Rows that a lot of queries meets at once, in one task.
ROWS_MET = 10_000
#: Pairs of vectors, or of vectors and centres, that are compared at once; a table of their distances takes 8 MB.
PAIRS = 1_000_000


def snapped(targets: DataFrame, lines: DataFrame, keys: list[str], x: str, tolerance: float) -> DataFrame:
    """``targets`` with snapped_to: the nearest line of the same keys within the tolerance, the lower of two as near; else null.

    No range join: both tables are sorted once together, and each target looks at the last line before and
    the first line after it.
    """
    rows = targets.withColumn("_line", F.lit(None).cast(lines.schema[x].dataType)).unionByName(
        lines.select(*keys, x, F.col(x).alias("_line")), allowMissingColumns=True
    ).withColumn("_target", F.col("_line").isNull())
    upto = Window.partitionBy(*keys).orderBy(x).rangeBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy(*keys).orderBy(F.desc(x)).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_low", F.max("_line").over(upto)).withColumn("_high", F.min("_line").over(onward))
    down, up = F.col(x) - F.col("_low"), F.col("_high") - F.col(x)
    near = F.when(up.isNull() | (down <= up), F.col("_low")).otherwise(F.col("_high"))
    found = F.when(F.abs(near - F.col(x)) <= tolerance, near)
    return rows.where("_target").select(*targets.columns, found.alias("snapped_to"))


def inherited(rows: DataFrame, keys: list[str], x: str, tie: str, values: list[str], lacking: Column, far: float = float("inf")) -> DataFrame:
    """The rows that lack values, with those of the nearest row of their keys that has them, and with _shift.

    Of rows as near the lower one counts, of those at one place the one with the least ``tie``. _shift is
    how far the row is from that one, 0 if that is more than ``far``. Without any such row values are null.
    """
    own = rows.where(~lacking).groupBy(*keys, x).agg(F.min(F.struct(tie, *values)).alias("_from"))
    kept = [c for c in rows.columns if c not in values]
    found = snapped(rows.where(lacking).select(*kept), own.select(*keys, x), keys, x, float("inf"))
    at = own.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(x).alias("_x"), "_from")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = found.join(at, [*on, F.col("snapped_to") == F.col("_x")], "left")
    step = F.col(x) - F.col("snapped_to")
    shift = F.when(F.abs(step) > far, F.lit(0)).otherwise(step)
    return both.select(*kept, *[F.col(f"_from.{v}").alias(v) for v in values], shift.alias("_shift"))


def _compare(k: int):
    """Of each pair of blocks the k nearest rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for q_ids, q_flat, r_ids, r_flat in zip(*(batch.column(i) for i in range(4)), strict=True):
                qi, ri = q_ids.values.to_numpy(), r_ids.values.to_numpy()
                q = q_flat.values.to_numpy().astype(float).reshape(len(qi), -1)
                r = r_flat.values.to_numpy().astype(float).reshape(len(ri), -1)
                square = (q * q).sum(axis=1)[:, None] + (r * r).sum(axis=1)[None] - 2 * q @ r.T
                far = np.round(np.sqrt(np.maximum(square, 0)), 4)
                far[qi[:, None] == ri[None]] = np.inf
                order = np.lexsort((np.broadcast_to(ri, far.shape), far), axis=1)[:, :k]
                found.append((np.repeat(qi, order.shape[1]), ri[order].ravel(), np.take_along_axis(far, order, 1).ravel()))
            q, n, d = (np.concatenate(x) if found else np.empty(0) for x in (list(zip(*found, strict=True)) or [()] * 3))
            kept = np.isfinite(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[kept], pa.int64()), pa.array(n[kept], pa.int64()), pa.array(d[kept], pa.float64())],
                names=["query", "neighbour", "distance"],
            )

    return run


def k_nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int = 2) -> DataFrame:
    """(query, neighbour, distance, rank): each query's k nearest rows by L2 distance, itself left out.

    Distances are rounded to four places and ties go to the lower id. MOST_SENT queries at most are sent to the tasks
    once, rows stay where they are, and each task hands on k rows a query. More queries are dealt into lots and rows into
    parts; each lot meets each part in a task, which hands on k rows a query. The rest is a ranking that Spark cuts before its
    shuffle. Rows without a vector have no neighbours and are none. All vectors must have the same length.
    """
    sent, held = _sent(queries, id_col, vector_col), _vectors(rows, id_col, vector_col)
    if sent is not None:
        return _first(held.mapInArrow(_probe(*sent, k), "query long, neighbour long, distance double"), k)
    return _first(_meetings(_vectors(queries, id_col, vector_col), held).mapInArrow(_met(k), "query long, neighbour long, distance double"), k)


def _meetings(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(meeting, row, id, v): each lot of some MOST_SENT queries (row = 0) before each part of some ROWS_MET rows (row = 1)."""
    lots, parts = -(-queries.count() // MOST_SENT), max(1, -(-rows.count() // ROWS_MET))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(dealt(lots).alias("lot"), every(parts).alias("part"), F.lit(0).alias("row"), "id", "v")
    held = rows.select(every(lots).alias("lot"), dealt(parts).alias("part"), F.lit(1).alias("row"), "id", "v")
    both = asked.unionByName(held).select((F.col("lot") * parts + F.col("part")).cast("long").alias("meeting"), "row", "id", "v")
    return both.repartition(lots * parts, "meeting").sortWithinPartitions("meeting", "row")


def _met(k: int):
    """Of each meeting the k nearest rows of each query; the queries are held, rows pass by."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            code = batch.column("meeting").to_numpy() * 2 + batch.column("row").to_numpy()
            cuts = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(code[a]), batch.slice(int(a), int(b - a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, ids, v = -1, np.empty(0, np.int64), np.empty((0, 0), np.float32)
        for code, of in groupby(pieces(batches), key=lambda x: x[0]):
            if code % 2 == 0:
                lot = pa.Table.from_batches([piece for _, piece in of]).combine_chunks()
                meeting, ids = code // 2, lot.column("id").to_numpy()
                v = lot.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            elif code // 2 == meeting:
                yield from _probe(ids, v, k)(piece for _, piece in of)

    return run


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).dropna()


def _sent(queries: DataFrame, id_col: str, vector_col: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of MOST_SENT queries at most, None if there are more."""
    some = _vectors(queries, id_col, vector_col).limit(MOST_SENT + 1).toArrow()
    if some.num_rows > MOST_SENT:
        return None
    flat = some.column("v").combine_chunks().flatten().to_numpy()
    return some.column("id").to_numpy(), flat.reshape(some.num_rows, -1) if some.num_rows else np.empty((0, 0), np.float32)


def _first(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    return _first(pairs.mapInArrow(_compare(k), "query long, neighbour long, distance double"), k)


#: Vectors that centres are fitted on at most, and centres at most; both bound what the driver holds and sends.
MOST_FITTED, MOST_CENTRES = 20_000, 4_096
#: Parts that a cell's vectors are dealt into, so that a common vector's cell is no one task's.
DEALT = 8


def fit_centres(rows: DataFrame, id_col: str, vector_col: str, rounds: int = 10) -> np.ndarray:
    """Centres of k-means on the MOST_FITTED vectors of the least id hashes, one for each eight of these, MOST_CENTRES at most."""
    held = _vectors(rows, id_col, vector_col)
    some = held.orderBy(F.xxhash64("id"), "id").limit(MOST_FITTED).collect()
    if not some:
        return np.empty((0, 0))
    v = np.array([r["v"] for r in some], float)
    centres = v[: max(1, min(MOST_CENTRES, len(v) // 8))].copy()
    for _ in range(rounds):
        cell = _cells(v, centres, 1)[:, 0]
        size = np.bincount(cell, minlength=len(centres))
        total = np.stack([np.bincount(cell, x, len(centres)) for x in v.T], axis=1)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _cells(v: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The nearest centres of each vector, the nearest first; PAIRS distances are held at once."""
    found, square = np.empty((len(v), most), np.int32), (centres * centres).sum(axis=1)
    step = max(1, PAIRS // len(centres))
    for at in range(0, len(v), step):
        far = square[None] - 2 * v[at : at + step] @ centres.T
        found[at : at + step] = far.argmin(axis=1)[:, None] if most == 1 else np.argsort(far, axis=1, kind="stable")[:, :most]
    return found


def _in_cells(rows: DataFrame, id_col: str, vector_col: str, centres: np.ndarray, most: int, names: tuple[str, str]) -> DataFrame:
    """(cell, ids, flat): blocks of the vectors in each cell, a vector being in its ``most`` nearest ones."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // most)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                v = batch.column("v").flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
                cells = pa.ListArray.from_arrays(np.arange(0, len(v) * most + 1, most, dtype=np.int32), _cells(v, centres, most).ravel().astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), cells], names=["id", "v", "cells"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                for at in range(int(a), int(b), BLOCK):
                    part = batch.slice(at, min(BLOCK, int(b) - at))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("cell").slice(0, 1), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("v").flatten().to_numpy()], pa.list_(pa.float32()))],
                        names=["cell", "ids", "flat"],
                    )

    held = _vectors(rows, id_col, vector_col)
    placed = held.mapInArrow(place, "id long, v array<float>, cells array<long>").select("id", "v", F.explode("cells").alias("cell"))
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(DEALT))).sortWithinPartitions("cell", "id")
    return dealt.mapInArrow(pack, "cell long, ids array<long>, flat array<float>").toDF("cell", *names)


def _asked(v: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """For each cell a bit for each vector: whether the cell is among the vector's ``most`` nearest ones."""
    held = np.zeros((len(centres), len(v)), bool)
    step = max(1, PAIRS // len(centres))
    for at in range(0, len(v), step):
        cells = _cells(v[at : at + step].astype(float), centres, most)
        held[cells, np.arange(at, at + len(cells))[:, None]] = True
    return np.packbits(held, axis=1)


def _improve(far: np.ndarray, near: np.ndarray, who: np.ndarray, ids: np.ndarray, v: np.ndarray, r_ids: np.ndarray, r: np.ndarray) -> None:
    """Puts rows into the lists (distances ``far``, ids ``near``) of the queries ``who`` for which they are near enough; PAIRS of them at once."""
    k, last, square = far.shape[1], min(far.shape[1], len(r)) - 1, (r * r).sum(axis=1)
    step = max(1, PAIRS // len(r))
    for at in range(0, len(who), step):
        q = who[at : at + step]
        x = v[q].astype(float)
        d = x @ r.T
        d *= -2
        d += (x * x).sum(axis=1)[:, None]
        d += square[None]
        bound = far[q, -1]
        free = np.isinf(bound)
        if free.any():  # the list is not full: all rows up to the k-th nearest of these
            own = d[free]
            own[ids[q[free], None] == r_ids[None]] = np.inf
            own.partition(last, axis=1)
            bound[free] = np.sqrt(np.maximum(own[:, last], 0))
        i, j = np.nonzero(d <= np.square(bound + 2e-4)[:, None])  # somewhat more, as distances are compared rounded
        other = ids[q[i]] != r_ids[j]
        i, j = i[other], j[other]
        hit, i_hit = np.unique(i, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(hit)), k), i_hit])
        all_d = np.concatenate([far[q[hit]].ravel(), np.round(np.sqrt(np.maximum(d[i, j], 0)), 4)])
        all_i = np.concatenate([near[q[hit]].ravel(), r_ids[j]])
        order = np.lexsort((all_i, all_d, of))
        best = order[np.searchsorted(of[order], np.arange(len(hit)))[:, None] + np.arange(k)]
        far[q[hit]], near[q[hit]] = all_d[best], all_i[best]


def _probe(ids: np.ndarray, v: np.ndarray, k: int, centres: np.ndarray | None = None, asked: np.ndarray | None = None):
    """Of each task's rows the k nearest of each query, of those in the cells that it has ``asked``, or of all; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, near = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
        every = np.arange(len(ids))
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            r_ids, r = batch.column("id").to_numpy(), batch.column("v").flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
            if centres is None:
                _improve(far, near, every, ids, v, r_ids, r)
                continue
            cell = _cells(r, centres, 1)[:, 0]
            order = np.argsort(cell, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                those = np.flatnonzero(np.unpackbits(asked[cell[rows[0]]], count=len(ids)))
                _improve(far, near, those, ids, v, r_ids[rows], r[rows])
        kept = np.isfinite(far)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.broadcast_to(ids[:, None], far.shape)[kept], pa.int64()), pa.array(near[kept], pa.int64()), pa.array(far[kept], pa.float64())],
            names=["query", "neighbour", "distance"],
        )

    return run


def indexed_nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int = 2, share: float = 0.4, centres: np.ndarray | None = None) -> DataFrame:
    """As ``k_nearest``, but a query meets the rows of its nearest cells alone, a share of all; some neighbours may be missed.

    The centres are fitted on a bounded sample; every row is in the index. With a share of 1 the answer is
    exact. Vectors without clusters need a large share: of random ones in 64 dimensions 0.4 finds 0.94. MOST_SENT queries
    at most are sent to the tasks once, with a bit for each cell, and neither they nor the rows are
    copied or shuffled; each task hands on k rows a query. More queries are dealt to their cells, a cell's rows
    over DEALT parts, and joined in blocks.
    """
    centres = fit_centres(rows, id_col, vector_col) if centres is None else centres
    if not len(centres):
        return k_nearest(queries, rows, id_col, vector_col, k)
    most, sent = math.ceil(len(centres) * share), _sent(queries, id_col, vector_col)
    if sent is not None:
        probe = _probe(*sent, k, centres, _asked(sent[1], centres, most)) if len(sent[0]) else _probe(*sent, k)
        return _first(_vectors(rows, id_col, vector_col).mapInArrow(probe, "query long, neighbour long, distance double"), k)
    asked = _in_cells(queries, id_col, vector_col, centres, most, ("q_ids", "q_flat"))
    held = _in_cells(rows, id_col, vector_col, centres, 1, ("r_ids", "r_flat"))
    return _ranked(held.join(asked, "cell").select("q_ids", "q_flat", "r_ids", "r_flat"), k)
