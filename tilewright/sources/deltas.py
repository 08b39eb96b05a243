"""A keyed store on Parquet that is merged when it is read.

Each batch of changes becomes a delta, a folder named by its writer's generation and the batch's number, so a batch that
is repeated takes its own place. A read takes the last of each key over the base and the deltas after it.
``merge`` writes a new base from time to time and puts it in force by one small file that only one writer can create.
Nothing rewrites the whole table for a change, and a broken writer leaves folders that no version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

_GONE, _AT = "_deleted", "_at"


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, in order; nothing if there is no such folder."""
    path, files = _files(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []


def _read_text(spark: SparkSession, path: str) -> str:
    p, files = _files(spark, path)
    stream = files.open(p)
    try:
        return bytes(b & 255 for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless it is there; of several writers one gets True."""
    p, files = _files(spark, path)
    draft, _ = _files(spark, f"{path.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not files.exists(p) and files.rename(draft, p):
        return True
    files.delete(draft, False)
    return False


def generation(spark: SparkSession, root: str, writer: str) -> int:
    """The number of a writer (a checkpoint's path, say): the same each time, and above those of all writers before it."""
    while True:
        held = {n: _read_text(spark, f"{root}/writers/{n}") for n in names(spark, f"{root}/writers") if not n.startswith(".")}
        mine = [int(n) for n, of in held.items() if of == writer]
        if mine:
            return mine[0]
        new = max(map(int, held), default=0) + 1
        if created(spark, f"{root}/writers/{new:010d}", writer):
            return new


def append_delta(changes: DataFrame, root: str, writer: int, number: int, keys: list[str], order: str, deleted: str | None = None) -> None:
    """Writes one batch's last change of each key; the same batch again replaces itself.

    ``order`` ranks the changes of a key within the batch (a later batch outranks an earlier one whatever its order);
    ``deleted`` is a boolean column, true where the key goes. Of equal ranks a deletion wins, then any one.
    """
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    rest = [c for c in changes.columns if c not in keys and c != deleted]
    last = F.max_by(F.struct(*rest, gone.alias(_GONE)), F.struct(order, gone.alias(_GONE))).alias("_last")
    rows = changes.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in [*rest, _GONE]])
    rows.write.mode("overwrite").parquet(f"{root}/delta/{writer:010d}-{number:020d}")


def save(changes: DataFrame, root: str, keys: list[str], order: str, deleted: str | None = None) -> None:
    """Writes changes through at once, as a batch of its own after all that is there."""
    append_delta(changes, root, generation(changes.sparkSession, root, uuid.uuid4().hex), 0, keys, order, deleted)


def autosave(stream: DataFrame, root: str, checkpoint: str, keys: list[str], order: str, deleted: str | None = None, every: str = "5 seconds") -> DataStreamWriter:
    """A writer that saves each micro-batch's changes every so often; start it, or give it another trigger.

    A micro-batch that a restart repeats takes the place of its first try, and keys that it does not name keep
    what earlier ones said. An empty micro-batch changes nothing.
    """
    writer = generation(stream.sparkSession, root, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        append_delta(batch, root, writer, number, keys, order, deleted)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def _version(spark: SparkSession, root: str) -> tuple[int, str | None, dict[str, str]]:
    """The number of the version in force, its base, and each writer's last batch in that."""
    held = [n for n in names(spark, f"{root}/versions") if not n.startswith(".")]
    if not held:
        return 0, None, {}
    said = json.loads(_read_text(spark, f"{root}/versions/{held[-1]}"))
    return int(held[-1]), said["base"], said["upto"]


def _is_merged(delta: str, upto: dict[str, str]) -> bool:
    writer, _, number = delta.partition("-")
    return number <= upto.get(writer, "")


def _merged(spark: SparkSession, root: str, keys: list[str], base: str | None, deltas: list[str]) -> DataFrame:
    rows = None
    if base:
        rows = spark.read.parquet(f"{root}/base/{base}").withColumn(_GONE, F.lit(False)).withColumn(_AT, F.lit(""))
    if deltas:
        name = F.regexp_extract(F.input_file_name(), "/delta/([0-9]+-[0-9]+)/", 1)
        more = spark.read.option("mergeSchema", "true").parquet(*[f"{root}/delta/{d}" for d in deltas]).withColumn(_AT, name)
        rows = more if rows is None else rows.unionByName(more, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(_AT)).alias("_last"))
    return last.where(~F.col(f"_last.{_GONE}")).select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest if c not in (_GONE, _AT)])


def live(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    """The store's rows: the last of each key, without those that were deleted; None if nothing was ever saved."""
    _, base, upto = _version(spark, root)
    deltas = [n for n in names(spark, f"{root}/delta") if not _is_merged(n, upto)]
    return _merged(spark, root, keys, base, deltas) if base or deltas else None


def merge(spark: SparkSession, root: str, keys: list[str]) -> bool:
    """Makes a new base of the base and the finished deltas; False if there is nothing to merge or another merge came first.

    A delta without Spark's mark of success is still being written and ends what is merged of its writer, as a version
    counts each writer's batches up to one. A merged batch that is repeated changes nothing. What is merged is older than any delta
    that is not.
    """
    number, base, upto = _version(spark, root)
    deltas, last, ended = [], dict(upto), set()
    for name in names(spark, f"{root}/delta"):
        writer, _, batch = name.partition("-")
        if _is_merged(name, upto) or writer in ended:
            continue
        if "_SUCCESS" not in names(spark, f"{root}/delta/{name}"):
            ended.add(writer)
            continue
        deltas.append(name)
        last[writer] = batch
    if not deltas:
        return False
    new = uuid.uuid4().hex
    _merged(spark, root, keys, base, deltas).write.parquet(f"{root}/base/{new}")
    return created(spark, f"{root}/versions/{number + 1:020d}", json.dumps({"base": new, "upto": last}))


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes bases and deltas that the version in force does not need; returns how many. Run it when no reader is at work."""
    _, base, upto = _version(spark, root)
    gone = [f"base/{n}" for n in names(spark, f"{root}/base") if base and n != base] + [f"delta/{n}" for n in names(spark, f"{root}/delta") if _is_merged(n, upto)]
    for name in gone:
        path, files = _files(spark, f"{root}/{name}")
        files.delete(path, True)
    return len(gone)
