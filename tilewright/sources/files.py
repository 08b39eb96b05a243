"""Files labelled by their folders, and what the names of confirmed cells say."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def format_name(epoch: Column, sha: Column, card: Column, row: Column, col: Column, corrected: Column) -> Column:
    """A cell's file name, as ``cell_name`` reads it."""
    return F.format_string("%d_%s_c%d_r%dc%d%s.jpg", epoch, sha, card, row, col, F.when(corrected, "_x").otherwise(""))


def stable_id(*parts: Column | str) -> Column:
    """32 hex digits that depend on the parts alone, where a random id would differ between runs; nulls are empty."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("-", *texts), 256), 1, 32)


def iso_text(ts: Column) -> Column:
    """A time as ISO text to the second, the rest cut off."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def iso_time(text: Column) -> Column:
    """The time of an ISO text; null for any other text."""
    return text.try_cast("timestamp_ntz")


def digits_of(text: Column) -> Column:
    """The digits of an id; null if it has none."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit(""))


def new_by_label(rows: DataFrame, held: DataFrame | None, keys: list[str], root: str, label: str) -> DataFrame:
    """Appends the rows whose keys are not among ``held`` to a folder for each label; returns them. Writing them again adds nothing.

    ``held`` is what the folder holds (None: nothing). Of rows with one key the first by label is written.
    """
    order = Window.partitionBy(*keys).orderBy(label)
    fresh = rows if held is None else rows.join(held.select(*keys), keys, "left_anti")
    fresh = fresh.withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")
    fresh.write.mode("append").partitionBy(label).parquet(root)
    return fresh


def append_text(lines: DataFrame, path: str, backups: str) -> str | None:
    """Appends lines of text to a folder, after a copy of what it holds under ``backups``, named by time; returns the copy's path."""
    spark, copy = lines.sparkSession, None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        copy = f"{backups}/{time.strftime('%Y%m%d-%H%M%S')}-{uuid.uuid4().hex[:8]}"
        spark.read.text(path).write.text(copy)
    lines.write.mode("append").text(path)
    return copy


def labelled_files(
    spark: SparkSession, root: str, ends: tuple[str, ...] = ("jpg", "jpeg", "png"), without: DataFrame | None = None, sheet: str = "sheet"
) -> DataFrame:
    """(path, name, label, length) of files below ``root`` in folders that are numbers; the label is the folder.

    Contents are not read. Names that begin with a dot and other endings are left out, and so are files whose
    name's first number is among ``without`` (one column, ``sheet``). Order the rows by path where order matters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name, label = F.regexp_extract("path", "([^/]+)$", 1), F.regexp_extract("path", "/([0-9]+)/[^/]+$", 1)
    rows = files.select("path", name.alias("name"), label.try_cast("int").alias("label"), "length")
    if without is not None:
        number = F.regexp_extract("name", "([0-9]+)", 1).try_cast("long")
        rows = rows.join(without.select(F.col(sheet).cast("long").alias("_gone")), number == F.col("_gone"), "left_anti")
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return rows.where(ending.isin(*ends) & ~F.col("name").startswith(".") & F.col("label").isNotNull())


def cell_name(name: Column) -> dict[str, Column]:
    """epoch, sha, card, row, col and corrected of names like ``170_ab12cd_c1_r2c3_x.jpg``; what a name lacks is null."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(stem, pattern, 1), F.lit(""))

    return {
        "epoch": part("^([0-9]+)_").try_cast("long"),
        "sha": part("^[0-9]+_([0-9a-f]+)_c[0-9]"),
        "card": part("_c([0-9]+)_r[0-9]").try_cast("int"),
        "row": part("_r([0-9]+)c[0-9]").try_cast("int"),
        "col": part("_r[0-9]+c([0-9]+)(?:_|$)").try_cast("int"),
        "corrected": stem.endswith("_x"),
    }
