"""Shards of a growing table: small immutable files, size-tiered compaction, versioned manifests.

All work is by Spark's readers and writers. Shards are written in runs: the files that one arrival, or
one merge, has written to one folder. A manifest is a small Parquet table with a row for each run (path,
files, bytes, rows, tier, packed); a version is a file that names its manifest, put in place by a rename
that fails if the version exists. Readers see one version whole; runs that no version names are never
read. So the driver knows runs, not files or rows, and Spark itself lists what is in them.

Compaction merges the runs of one size tier with each other: Spark packs the tier's files into read
partitions of the target size, and each partition is written as one file, so no row is shuffled.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import _path

TARGET_BYTES = 128 << 20
#: A tier holds mean file sizes up to this many times its least; a tier is merged when it has so many files.
TIER_RATIO, LEAST_RUN = 4, 4
#: Runs that one step of a compaction reads; steps go on until no tier can be merged.
STEP_RUNS = 1_000
ROW_GROUP_BYTES = 16 << 20


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def latest(spark: SparkSession, root: str) -> int:
    """The last committed version; 0 before the first."""
    return max((int(n) for n in _names(spark, f"{root}/versions") if n.isdigit()), default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """path, files, bytes, rows, tier, packed of a version's runs; no rows at version 0."""
    version = latest(spark, root) if version is None else version
    if not version:
        return spark.createDataFrame([], "path string, files long, bytes long, rows long, tier int, packed boolean")
    name = spark.read.text(f"{root}/versions/{version:08d}").first()[0]
    return spark.read.parquet(f"{root}/manifests/{name}")


def commit(spark: SparkSession, root: str, shards: DataFrame, version: int) -> None:
    """Makes ``shards`` the given version; fails if another writer has committed that version."""
    name, jvm = uuid.uuid4().hex, spark.sparkContext._jvm
    shards.coalesce(1).write.parquet(f"{root}/manifests/{name}")
    draft, fs = _path(spark, f"{root}/drafts/{name}")
    stream = fs.create(draft, False)
    stream.write(bytearray(f"{name}\n".encode()))
    stream.close()
    final, _ = _path(spark, f"{root}/versions/{version:08d}")
    fs.mkdirs(final.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(draft, final, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))


def tier_of(size: Column) -> Column:
    """Tier of a shard's size: 0 up to 64 KB, then one more for each factor of TIER_RATIO."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(size, F.lit(1)) / 65536.0) / F.log(F.lit(float(TIER_RATIO))))).cast("int")


def _runs(spark: SparkSession, folder: str, schema: StructType, packed: bool) -> DataFrame:
    """A manifest's rows for the runs that were written to a folder; runs without rows are left out."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    files = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    files = files.agg(F.count(F.lit(1)).alias("rows"))
    runs = files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")
    )
    return runs.withColumn("tier", tier_of(F.col("bytes") / F.col("files"))).withColumn("packed", F.lit(packed))


def append(df: DataFrame, root: str, arrival: Column | None = None) -> int:
    """Writes the rows as a new run of small shards (one for each arrival, if given) and commits; returns the version.

    All appends have the same columns, of any names. Rows are stored as they are: nulls, empty and long
    texts, ties and repeated rows. An empty table makes a version without new runs. A null arrival is one
    more arrival. Two writers at once: one of them fails and its files are named by no version.
    """
    spark = df.sparkSession
    version, folder = latest(spark, root) + 1, f"{root}/data/{uuid.uuid4().hex}"
    if arrival is None:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    else:
        lot = f"lot_{uuid.uuid4().hex}"
        df.withColumn(lot, arrival).write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(lot).parquet(folder)
    before = manifest(spark, root, version - 1)
    commit(spark, root, before.union(_runs(spark, folder, df.schema, False).select(*before.columns)), version)
    return version


@contextmanager
def _packed_reads(spark: SparkSession, target: int) -> Iterator[None]:
    """Reads pack whole files into partitions of the target size meanwhile."""
    wanted = {
        "spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0",
        "spark.sql.files.minPartitionNum": "1",
    }
    held = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _next_step(now: DataFrame, target: int) -> list[str]:
    """The runs of the lowest tier that can be merged, STEP_RUNS at most; none if no tier can.

    A tier of files below half the target size can if two of its runs, or one that no merge has packed,
    have LEAST_RUN files in all. Each step leaves fewer runs, or fewer unpacked ones, so steps end.
    """
    small = now.where(F.col("bytes") < F.col("files") * (target // 2))
    tiers = small.groupBy("tier").agg(
        F.sum("files").alias("files"), F.count(F.lit(1)).alias("runs"), F.bool_or(~F.col("packed")).alias("loose")
    )
    lowest = tiers.where((F.col("files") >= LEAST_RUN) & ((F.col("runs") > 1) | F.col("loose"))).agg(F.min("tier")).first()[0]
    if lowest is None:
        return []
    return [r["path"] for r in small.where(F.col("tier") == lowest).orderBy("packed", "path").limit(STEP_RUNS).collect()]


def compact(spark: SparkSession, root: str, target: int = TARGET_BYTES) -> int:
    """Merges tiers, from the lowest on, until none can be merged; returns the version.

    Each step commits a version of its own, so that a compaction that is broken off loses one step; the
    version stays the same if there is nothing to merge. No row is changed, dropped or shuffled, repeated
    rows and columns of any names included. A table without versions or rows stays as it is.
    """
    version = latest(spark, root)
    while paths := _next_step(now := manifest(spark, root, version), target):
        folder, schema = f"{root}/data/{uuid.uuid4().hex}", spark.read.parquet(paths[0]).schema
        with _packed_reads(spark, target):
            _read(spark, schema, paths).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
        gone = spark.createDataFrame([(p,) for p in paths], "path string")
        stay = now.join(gone, "path", "left_anti")
        commit(spark, root, stay.union(_runs(spark, folder, schema, True).select(*stay.columns)), version + 1)
        version += 1
    return version


def _read(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)


def live(spark: SparkSession, root: str, schema: StructType, version: int | None = None) -> DataFrame:
    """The rows of a version's runs; none if it has none. The driver gets the runs' folders, and Spark lists their files."""
    paths = [r["path"] for r in manifest(spark, root, version).select("path").collect()]
    return _read(spark, schema, paths) if paths else spark.createDataFrame([], schema)


def expire(spark: SparkSession, root: str, grace: float = 0) -> int:
    """Deletes the runs that the last version does not name; returns how many. Run it when no reader needs an older version.

    A run that an ``append`` or ``compact`` elsewhere has written and not yet committed is named by no version
    either: runs younger than ``grace`` seconds are spared, so give more than such a writer can take; 0 is
    for a single writer. Versions and their manifests stay.
    """
    now = time.time() * 1000
    within = lambda path: path.rpartition("/data/")[2].rstrip("/")
    named = {within(r["path"]) for r in manifest(spark, root).select("path").collect()}
    roots, gone = {x.partition("/")[0] for x in named}, 0
    for name in _names(spark, f"{root}/data"):
        inside = [f"{name}/{x}" for x in _names(spark, f"{root}/data/{name}") if "=" in x] if name in roots else [name]
        for run in inside or [name]:
            if run not in named:
                p, fs = _path(spark, f"{root}/data/{run}")
                if fs.getFileStatus(p).getModificationTime() <= now - grace * 1000:
                    gone += bool(fs.delete(p, True))
    return gone
