"""Readers and predicates that a user supplies: column expressions by name, Python over batches, and figures on the way."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Reader to what it reads of a text, as a column; more may be added.
READERS: dict[str, Callable[[Column], Column]] = {
    "digits": lambda text: F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")).cast("long"),
    "words": lambda text: F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
}


def read_by(rows: DataFrame, reader: str, text: str, readers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Adds value: what the reader that a row names reads of its text; null for a name that is not among ``readers``, or none."""
    value = F.lit(None).cast("long")
    for name, read in readers.items():
        value = F.when(F.col(reader) == name, read(F.col(text))).otherwise(value)
    return rows.withColumn("value", value)


def predicate(holds: Callable[..., pd.Series], *columns: str) -> Column:
    """A condition in Python over whole batches of columns: ``holds`` takes a series of each and returns one of booleans."""

    def run(*batch: pd.Series) -> pd.Series:
        return holds(*batch).astype(bool)

    return F.pandas_udf(run, "boolean")(*[F.col(c) for c in columns])


def watched(rows: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and the figures (aggregates) that are taken while some action reads them: get them after it."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(k) for k, c in figures.items()]), seen
