"""Helpers that the training-data operators share: tables, checkpoints, size-checked joins, token rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a run of anything else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only when it was counted and holds no more rows than this.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; ``sf_dir`` may be any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWNED: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    It lies in a folder of this Spark application, which owns it: the driver's file system deletes that
    folder when the driver ends. Only a session in local mode, where the driver's disk is everyone's, may
    leave the setting out.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif re.match(r"local(\[|$)", context.master):
            base = f"{tempfile.gettempdir()}/checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    owned = f"{base.rstrip('/')}/run-{context.applicationId}"
    if (context.applicationId, owned) not in _OWNED:
        p, fs = _path(spark, owned)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _OWNED.add((context.applicationId, owned))
    return f"{owned}/{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours on the file system that it is on."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing reads any more: every later table was written, so no lineage leads back to them."""
    for df in tables:
        remove(df.sparkSession, df._cut_path.rpartition("/")[0])


def join_small(big: DataFrame, small: DataFrame, on: Column, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with a broadcast of ``small`` if a count shows at most ``rows`` rows, else as Spark plans it.

    ``small`` should be cheap to count (a ``cut`` table). Beyond the bound the join shuffles both sides,
    and adaptive execution splits its skewed partitions.
    """
    if small.limit(rows + 1).count() <= rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


#: A key is hot if it holds more than one in so many of all rows; so there are fewer hot keys than this.
HOT_PART = 1_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins rows with ``groups``, which has one row for each key and in ``n`` the key's number of rows.

    Hot keys are fewer than HOT_PART by arithmetic, so they are broadcast, and their rows are shuffled
    nowhere; what is shuffled has no key with more than 1 / HOT_PART of all rows. ``groups`` is read several
    times and should be a ``cut`` table.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_PART > total
    hot = F.broadcast(groups.where(is_hot).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(~is_hot).drop("n"), key, how)
    return rows.join(hot, key).unionByName(cold)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an expression's ASCII text, bit by bit."""
    steps = f"flatten(list_transform(regexp_extract_all({text}, '.'), lambda c: [-1 - ascii(c)::bigint, 1, 1, 1, 1, 1, 1, 1, 1]))"
    step = "case when x < 0 then xor(crc, -1 - x) else xor(crc >> 1, 3988292384 * (crc & 1)) end"
    return f"(4294967295 - list_reduce(list_prepend(4294967295::bigint, {steps}), lambda crc, x: {step}))"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """As ``words_of``, with A-Z (and nothing else) in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def n_words(text: Column) -> Column:
    """Number of words, by built-in functions: null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def slices(batches: Iterator[pa.RecordBatch], column: str, bytes_each: int) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that one column holds about ``bytes_each`` bytes in each; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(lengths):
            if i > at and total + n > bytes_each:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        yield batch.slice(at)
