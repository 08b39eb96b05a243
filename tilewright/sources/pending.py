"""Pending cells of scans, kept until they are confirmed, and beside them what the reader made of each scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .deltas import names

#: Fixed value: a cell with a smaller share of dark places is blank.
LEAST_DARK = 0.01


def dark_shares(places: DataFrame, keys: list[str], dark: Column) -> DataFrame:
    """(keys, share): which part of a cell's places is dark; places that are not known count as light."""
    return places.groupBy(*keys).agg(F.avg(F.coalesce(dark, F.lit(False)).cast("int")).alias("share"))


def filled(cells: DataFrame, share: Column) -> DataFrame:
    """The cells that are not blank."""
    return cells.where(share >= LEAST_DARK)


def readings(text: Column, kind: str = "array<array<int>>") -> Column:
    """What a sidecar's text says, as an array of ``kind``'s entries, one for each card; null if it is missing, broken, or no list."""
    # from_json takes a struct's text, so the list is made a field of one
    wrapped = F.from_json(F.concat(F.lit('{"_r": '), text, F.lit("}")), f"_r array<{kind}>, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(F.ltrim(text).startswith("["), F.when(wrapped["_corrupt_record"].isNull(), wrapped["_r"]))


def save_pending(cells: DataFrame, sidecars: DataFrame, root: str, batch: str) -> None:
    """Writes a batch's cells (scan_id, cell, ...), those that are not blank by their ``share``, and its sidecars (scan_id, auto) beside them.

    The same batch again replaces itself. The sidecars are written first, so that cells never lack theirs.
    """
    sidecars.select("scan_id", "auto").write.mode("overwrite").parquet(f"{root}/auto/batch={batch}")
    filled(cells, F.col("share")).write.mode("overwrite").parquet(f"{root}/cells/batch={batch}")


def pending(spark: SparkSession, root: str, kind: str = "array<array<int>>") -> DataFrame | None:
    """All pending cells with auto, what was read at the scan: null where the scan has no usable sidecar; None if nothing is pending.

    A scan has one sidecar; of several batches' the last one counts.
    """
    if not names(spark, f"{root}/cells"):
        return None
    cells = spark.read.parquet(f"{root}/cells").drop("batch")
    autos = spark.read.parquet(f"{root}/auto").groupBy("scan_id").agg(F.max_by("auto", F.col("batch").cast("string")).alias("auto"))
    return cells.join(autos, "scan_id", "left").withColumn("auto", readings(F.col("auto"), kind))


def confirmed(held: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the pending cells those of the confirmed scans (scan_id), and those that go on waiting."""
    gone = scans.select("scan_id").distinct()
    return held.join(gone, "scan_id", "left_semi"), held.join(gone, "scan_id", "left_anti")
