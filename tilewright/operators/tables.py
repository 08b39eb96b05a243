"""Written intermediate tables, and joins with few rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and holds no more rows than this.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a session in local mode may leave that out. It goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    folder = f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


#: Rows of a task that are meant where rows are dealt for costly work.
ROWS_DEALT = 10_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, dealt by their keys: for costly work on rows that fit into few blocks of a file, which few tasks would read.

    There are as many tasks as the session has partitions of a shuffle, and more if a count shows more than ROWS_DEALT rows for each.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_DEALT))
    return rows.repartition(tasks, *keys)


def written(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: it is computed once, and its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The table, computed once: as rows of this session if they are few, else written to the shared folder."""
    rows = df.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return written(df)
    few = df.sparkSession.createDataFrame(rows, df.schema)
    few._few_rows = rows
    return few


def are_few(df: DataFrame, of: DataFrame) -> DataFrame:
    """Marks a table that has no more rows than ``of`` as few, if that was settled as few rows, else computes it once."""
    if not hasattr(of, "_few_rows"):
        return settled(df)
    df._few_rows = None
    return df


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys, null with null, with a broadcast of ``few`` if a count shows few rows, else as Spark plans it.

    ``few`` is counted if it isn't a settled table of few rows, so it should be a written one. Its key columns are left
    out of the result.
    """
    if hasattr(few, "_few_rows") or few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    renamed = few.withColumnsRenamed({k: f"_few_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_few_{k}")) for k in keys] or [F.lit(True)]
    return rows.join(renamed, on, how).drop(*[f"_few_{k}" for k in keys])
