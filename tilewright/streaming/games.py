"""Streams of game messages: de-duplicated calls, and running marks per key kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.patterns import FREE_BIT, holds_for


def unique_calls(calls: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Calls without repeats of the same keys within the watermark; works on streams and tables."""
    timed = calls.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if timed.isStreaming else timed.dropDuplicates(keys)


def running_wins(calls: DataFrame, key: str, pattern, once: bool = True) -> DataFrame:
    """(key, seq, marked) for each new call after which the pattern holds; only the first with ``once``.

    ``calls`` needs key (long), seq (long, ascending per key) and bit (int; null: not on the card). A call
    of a cell that is marked already announces nothing. The state per key is its marks and whether it has
    won, and of a micro-batch's rows only the first call of each cell is held, so that neither the stream
    nor a hot key fills a task.
    """

    def fold(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        marked, won = state.get if state.exists else (1 << FREE_BIT, False)
        first: dict[int, int] = {}
        for rows in batches:
            for bit, seq in rows.dropna(subset=["bit"]).groupby("bit")["seq"].min().items():
                first[int(bit)] = min(int(seq), first.get(int(bit), int(seq)))
        out = []
        for bit, seq in sorted(first.items(), key=lambda x: x[1]):
            if marked >> bit & 1:
                continue
            marked |= 1 << bit
            if holds_for(pattern, marked) and not (won and once):
                out.append((of[0], seq, marked))
                won = True
        state.update((marked, won))
        yield pd.DataFrame(out, columns=[key, "seq", "marked"])

    return calls.groupBy(key).applyInPandasWithState(
        fold, f"{key} long, seq long, marked int", "marked int, won boolean", "append", GroupStateTimeout.NoTimeout
    )
