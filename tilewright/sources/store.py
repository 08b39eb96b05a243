"""A keyed store of JSON states on Parquet: snapshots, upserts, restore with defaults and quarantine."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.running import running
from .deltas import names


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def upserted(held: DataFrame, more: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """Both tables' rows, the last updated of each key. The maximum is taken before rows are shuffled, and nothing is sorted by key."""
    rest = [c for c in held.columns if c not in keys]
    last = held.unionByName(more).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(updated)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.`{c}`").alias(c) for c in held.columns])


def save_snapshot(df: DataFrame, root: str) -> bool:
    """Writes a new snapshot folder; nothing, and False, for an empty table. Readers take the newest."""
    if df.isEmpty():
        return False
    df.write.parquet(f"{root}/snapshot={_stamp()}")
    return True


def _stamp() -> str:
    """A name that sorts after earlier ones."""
    import time

    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def load_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole snapshot, found by listing the folder."""
    newest = max(n for n in names(spark, root) if n.startswith("snapshot="))
    return spark.read.parquet(f"{root}/{newest}")


def keep_last(spark: SparkSession, root: str, n: int = 20) -> int:
    """Deletes all snapshots but the newest ``n``; returns how many went."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = sorted((x.getPath() for x in files.listStatus(path) if x.getPath().getName().startswith("snapshot=")), key=lambda p: p.getName())
    gone = held[: max(0, len(held) - n)]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)


def aged_out(rows: DataFrame, ts: str, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and those at least so many days old (0: all); writing only the second is a dry run."""
    old = F.lit(True) if days <= 0 else F.coalesce(F.col(ts) <= now - F.make_interval(days=F.lit(days)), F.lit(False))
    return rows.where(~old), rows.where(old)


def without_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and those whose keys are among ``gone``; writing only the second is a dry run."""
    return rows.join(gone, keys, "left_anti"), rows.join(gone, keys, "left_semi")


def restored(rows: DataFrame, blob: str, schema: StructType, defaults: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """Rows with the fields of a JSON column (defaults where missing), and the rows whose JSON is broken."""
    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    read = rows.withColumn("_j", F.from_json(blob, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull()
    fields = [
        (F.coalesce(F.col(f"_j.{f.name}"), F.lit(defaults[f.name])) if f.name in defaults else F.col(f"_j.{f.name}")).alias(f.name)
        for f in schema.fields
    ]
    return read.where(~broken).select(*rows.columns, *fields), read.where(broken).select(*rows.columns)


# The states that a stored game may be in; any other is the first.
STATES = ("setup", "in_progress", "game_over")
_GAME = StructType().add("game_id", "string").add("status", "string").add("winning_pattern_name", "string").add("last_activity", "string")


def restored_games(rows: DataFrame, blob: str, patterns: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """Games from JSON (game_id, status, winning_pattern_name, last_activity, wins), and the rows whose JSON is broken.

    A missing or unknown status is the first of STATES, a missing or unreadable last activity is ``now``, a
    missing game_id is empty. A pattern that is not among ``patterns`` keeps its name, but wins is false.
    """
    good, broken = restored(rows, blob, _GAME, {"game_id": ""})
    status = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise(STATES[0])
    wins = F.coalesce(F.col("winning_pattern_name").isin(*patterns), F.lit(False))
    seen = F.coalesce(F.col("last_activity").try_cast("timestamp_ntz"), now)
    return good.withColumns({"status": status, "last_activity": seen, "wins": wins}), broken


def filled_down(rows: DataFrame, keys: list[str], order: str, header: Column, name: str) -> DataFrame:
    """Adds the last header at or above each line."""
    return running(rows, keys, [order], lasts={name: header})
