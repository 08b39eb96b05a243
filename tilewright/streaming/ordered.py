"""Keyed stream state over rows in the order of their times, whatever order and batches they arrive in.

A row is held in its key's state until the watermark has passed it; then rows are handed on in ascending (time, seq).
The results therefore equal those of the same rows as a sorted table, as long as none comes later than the
watermark's delay (such rows are left out by Spark). The state store has to be RocksDB (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Lets the queries that this session starts from now on keep their state in RocksDB, as these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class InOrder(StatefulProcessor):
    """Hands each key's rows to ``fold`` in ascending (time, seq), once the watermark has passed them.

    Rows are (us, seq, ...) with the time in microseconds. A key's rows of one instant that the watermark has
    not passed are its buffer; it is read and written once a micro-batch. ``idle`` is asked after each
    release, with the watermark, and may give rows and the time at which it wants to be asked again.
    """

    def __init__(self, row_type: str, columns: list[str]):
        self.row_type, self.columns = row_type, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row_type)
        self.open()

    def open(self) -> None:
        """Gets the states that ``fold`` uses."""

    def fold(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        """The rows that these rows of a key give, in order."""
        raise NotImplementedError

    def idle(self, key: tuple, watermark: int) -> tuple[list[tuple], int | None]:
        return [], None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(x) else x for x in r) for frame in rows for r in frame[self.names()].astype(object).itertuples(index=False)]
        yield self._release(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key, timerValues.getCurrentWatermarkInMs(), [])

    def names(self) -> list[str]:
        return [f.split()[0] for f in self.row_type.split(", ")]

    def _release(self, key: tuple, watermark: int, new: list[tuple]) -> pd.DataFrame:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        ready = sorted((r for r in held + new if r[0] <= watermark * 1000), key=lambda r: r[:2])
        rest = [r for r in held + new if r[0] > watermark * 1000]
        if ready or new:
            self.held.put(rest) if rest else self.held.clear()
        out = self.fold(key, ready) if ready else []
        more, ask_at = self.idle(key, watermark)
        wanted = [ask_at] if ask_at is not None else []
        if rest:
            wanted.append(-(-min(r[0] for r in rest) // 1000))
        if wanted:
            self.handle.registerTimer(min(wanted))
        return pd.DataFrame([(*key, *r) for r in out + more], columns=self.columns).astype(object)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, ts: str, seq: str, extra: list, processor: InOrder, out: str, delay: str) -> DataFrame:
    """The processor over a stream's (key, time, seq, extra columns); rows without a key, time or seq are left out."""
    timed = rows.select(F.col(key).cast("long").alias(key), F.col(ts).cast("timestamp").alias("_ts"), F.col(seq).cast("long").alias("seq"), *extra)
    timed = timed.where(F.col(key).isNotNull() & F.col("_ts").isNotNull() & F.col("seq").isNotNull()).withWatermark("_ts", delay)
    return timed.withColumn("us", F.unix_micros("_ts")).groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")
