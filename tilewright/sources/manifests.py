"""Stored results as a JSON object with a key for each case: reading, order, and comparison with new results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_cases(spark: SparkSession, path: str, case: str) -> DataFrame:
    """``cases`` of manifest files with their file; each file is read as one value, so it must fit in a task."""
    return cases(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), "value", case, ["file"])


def cases(texts: DataFrame, text: str, case: str, of: list[str]) -> DataFrame:
    """(of, key, case, place): the entries of each manifest's object, in the order of the keys as whole numbers; other keys come last, as text.

    ``case`` is the DDL of an entry; ``of`` names the manifest, and places are counted within it. A text that is no
    object gives no rows.
    """
    rows = texts.select(*of, F.explode(F.from_json(text, f"map<string, struct<{_fields(case)}>>")).alias("key", "case"))
    number = F.col("key").try_cast("long")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy(number.asc_nulls_last(), "key")))


def _fields(case: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().split(" ", 1) for part in case.split(", ")))


def mismatched(golden: DataFrame, actual: DataFrame) -> DataFrame:
    """(key, off, extra, lost) of the keys whose cells differ. Both have key, cell and value; nulls equal nulls.

    off counts the cells with another value, those that one side lacks included unless the other's is null; extra are
    cells that only ``actual`` has, lost those that only ``golden`` has.
    """
    g = golden.select("key", "cell", F.col("value").alias("_g"), F.lit(True).alias("_in_g"))
    a = actual.select("key", "cell", F.col("value").alias("_a"), F.lit(True).alias("_in_a"))
    both = g.join(a, ["key", "cell"], "full")
    found = both.groupBy("key").agg(
        F.count_if(~F.col("_g").eqNullSafe(F.col("_a"))).alias("off"), F.count_if(F.col("_in_g").isNull()).alias("extra"), F.count_if(F.col("_in_a").isNull()).alias("lost")
    )
    return found.where("off + extra + lost > 0")
