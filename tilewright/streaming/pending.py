"""Pending scans: each is confirmed, rejected, or runs out of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_outcomes(scans: DataFrame, ends: DataFrame, age: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """(scan_id, scan_ts, end_ts, outcome) of scans (scan_id, scan_ts) and their ends (scan_id, end_ts, kind).

    An outer join within the age; scans without an end in time are ``expired``. On streams the watermarks of both
    sides bound the state, and an expired scan comes out once the watermark has passed its age. A scan that ends
    more than once gives a row for each end.
    """
    s = scans.select("scan_id", F.col("scan_ts").cast("timestamp").alias("scan_ts"))
    e = ends.select(F.col("scan_id").alias("_of"), F.col("end_ts").cast("timestamp").alias("end_ts"), "kind")
    if s.isStreaming:
        s, e = s.withWatermark("scan_ts", delay), e.withWatermark("end_ts", delay)
    on = (F.col("scan_id") == F.col("_of")) & (F.col("end_ts") >= F.col("scan_ts"))
    both = s.join(e, on & (F.col("end_ts") <= F.col("scan_ts") + F.expr(f"interval {age}")), "left_outer")
    return both.select("scan_id", "scan_ts", "end_ts", F.coalesce("kind", F.lit("expired")).alias("outcome"))
