"""Best-fit packing of documents into sequences of a fixed capacity, with conflicts.

Documents are dealt into shards of a bounded number of rows, each packed on its own: longest first, into
the tightest open bin that is compatible. Bins are ordered by residual; each carries a bitmap of the
sources and one of the duplicate clusters in it, and the search moves from the tightest bin that has
room to its successors until the bitmaps allow one.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ROWS = 8192
_OUT = "_id long, piece long, piece_start long, piece_len long, bin_id long"


def pack(sizes: list[int], sources: list, clusters: list, capacity: int, apart: bool = True) -> list[list[tuple[int, int, int]]]:
    """For each item its pieces as (start, length, bin); items longer than the capacity fill bins of their own first.

    No bin holds two pieces of one cluster, nor, with ``apart``, of one source. Null sources and
    clusters conflict with nothing.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    bit_of: dict = {}
    bins = 0
    rest: list[tuple[int, int, int]] = []
    for i, size in enumerate(sizes):
        full = size // capacity
        for j in range(full):
            out[i].append((j * capacity, capacity, bins))
            bins += 1
        if size % capacity:
            rest.append((-(size % capacity), i, full * capacity))
    rest.sort()
    seen: dict = {}
    for _, i, _ in rest:
        seen[clusters[i]] = seen.get(clusters[i], 0) + 1
    open_bins: list[tuple[int, int]] = []  # (residual, bin)
    source_bits: dict[int, int] = {}
    cluster_bits: dict[int, int] = {}
    for negative, i, start in rest:
        size, source, cluster = -negative, sources[i], clusters[i]
        s = 1 << bit_of.setdefault(("s", source), len(bit_of)) if apart and source is not None else 0
        c = 1 << bit_of.setdefault(("c", cluster), len(bit_of)) if cluster is not None and seen[cluster] > 1 else 0
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (source_bits[open_bins[at][1]] & s or cluster_bits[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, bins
            bins += 1
            source_bits[b] = cluster_bits[b] = 0
        out[i].append((start, size, b))
        source_bits[b] |= s
        cluster_bits[b] |= c
        if residual > size:
            insort(open_bins, (residual - size, b))
    return out


def _pack_shard(capacity: int, apart: bool):
    """Packs one shard as an Arrow table, in which ids and clusters beside a null stay whole numbers."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["_id", "_size", "_from", "_cluster"]).to_pylist()
        rows.sort(key=lambda r: (r["_id"] is None, r["_id"] or 0, r["_size"], repr(r["_from"]), repr(r["_cluster"])))
        shard = table.column("_shard")[0].as_py()
        found = pack([r["_size"] for r in rows], [r["_from"] for r in rows], [r["_cluster"] for r in rows], capacity, apart)
        out = [(r["_id"], k, a, n, (shard << 32) + b) for r, pieces in zip(rows, found, strict=True) for k, (a, n, b) in enumerate(pieces)]
        names = [c.split()[0] for c in _OUT.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def best_fit(
    items: DataFrame, id_col: str, size_col: str, source_col: str, cluster_col: str,
    capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, apart: bool = True,
) -> DataFrame:
    """One row per piece: id_col, piece, piece_start, piece_len, bin_id.

    An item of size 0 (or null) takes no room: it has one piece of length 0 and a null bin. Repeated rows
    are items of their own; if they share a cluster they never share a bin. Null ids, sources and clusters
    are allowed and conflict with nothing. Of equally long items the one of the lower id is packed first, of
    equally tight bins the one opened first is taken. An item longer than the capacity, however long, fills
    whole bins and leaves a rest. An empty table gives no rows; other columns are not looked at. Rows are
    dealt by a hash of the id and the row's place in the input, so that neither a hot source nor a repeated
    id fills one shard; a shard of some ``shard_rows`` items is packed in one task.
    """
    rows = items.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_size"),
        F.col(source_col).alias("_from"), F.col(cluster_col).alias("_cluster"),
    )
    shards = max(1, -(-rows.count() // shard_rows))
    place = F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(shards))
    dealt = rows.where("_size > 0").withColumn("_shard", place)
    packed = dealt.groupBy("_shard").applyInArrow(_pack_shard(capacity, apart), _OUT)
    none = rows.where("_size = 0").select(
        "_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("piece_start"),
        F.lit(0).cast("long").alias("piece_len"), F.lit(None).cast("long").alias("bin_id"),
    )
    return packed.union(none).withColumnRenamed("_id", id_col)
