"""Near-duplicate detection by min-max hashing.

Each of 80 permutations gives two signature values, its minimum and its maximum over a document's
shingles, so 160 values cost 80 hash evaluations. They form 32 bands of 5 values, each band of minima
only or maxima only (its values come from five different permutations). Two sets of Jaccard similarity
0.8 share no band with probability (1 - 0.8 ** 5) ** 32, about 3e-6.

Equal sets are first merged into classes, so copies never meet in a bucket. In a bucket every class is
compared with two pivots (its least id and one drawn by hash), which is linear in the bucket, however
large. What these links leave in different components is then enumerated: rows outside a bucket's
largest component against the others, or, where that would be many tests, those rows of the bucket that
share one of their rarest shingles. Candidates pass a size test and a 128-bit sketch test (a pair of
similarity 0.8 fails it with a probability of 4e-9), and are confirmed on their full shingle sets. So the
banding's 3e-6 is what a link at the threshold is missed by; all other bounds are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, join_groups, join_small, lower_words_of, slices
from .components import components

BANDS, ROWS = 32, 5
PERMUTATIONS = BANDS * ROWS // 2
SKETCH_BITS = 128
MOST_BITS_APART = 36
SEGMENTS = 128
#: Pairs of one bucket that are tested one by one at most; the rows of larger ones meet by rare shingles.
MOST_TESTS = 1_000_000

_RNG = np.random.RandomState(20240229)
_MUL = _RNG.randint(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.randint(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_ODD = _RNG.randint(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """Word to 64-bit hash, emptied when it holds 200,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def hashed_words(words: list[list[bytes]]) -> np.ndarray:
    """64-bit hashes of the words of many texts, one after the other."""
    return np.fromiter((_HASHES[w] for ws in words for w in ws), np.uint64, sum(map(len, words)))


def window_hashes(flat: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k hashed words."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run = flat[:n] * _ODD[0]
    for j in range(1, k):
        run += flat[j : n + j] * _ODD[j]
    return _mixed(run)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles; fewer words make one shingle, none make none."""
    words = [lower_words_of(t) for t in texts]
    sizes = [len(w) for w in words]
    run = window_hashes(hashed_words(words), k)
    out, at = [], 0
    for ws, n in zip(words, sizes, strict=True):
        if n >= k:
            out.append(np.unique(run[at : at + n - k + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=n)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-max signatures of non-empty sets: (sets, 2, permutations), minima first."""
    out = np.empty((len(sets), 2, PERMUTATIONS), np.uint32)
    first, total = 0, 0
    for i, s in enumerate(sets):  # in blocks that stay in cache
        total += len(s)
        if total >= 100_000 or i == len(sets) - 1:
            block = sets[first : i + 1]
            high = (np.concatenate(block) >> np.uint64(32)).astype(np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in block])[:-1]])
            for p in range(PERMUTATIONS):
                v = high * _MUL[p] + _ADD[p]
                out[first : i + 1, 0, p] = np.minimum.reduceat(v, starts)
                out[first : i + 1, 1, p] = np.maximum.reduceat(v, starts)
            first, total = i + 1, 0
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The key of each band, as signed 64-bit numbers; a key also holds its band's number."""
    values = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    keys = (values * _ODD[8 : 8 + ROWS]).sum(axis=2, dtype=np.uint64)
    return _mixed(keys + np.arange(BANDS, dtype=np.uint64) * _ODD[20]).view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """One bit for each of 128 signature values, as two signed 64-bit numbers."""
    values = sig[:, :, : SKETCH_BITS // 2].reshape(len(sig), SKETCH_BITS)
    bits = (values * np.uint32(0x85EBCA6B)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)


_SIGNED = "_id long, n_shingles long, set_key binary, keys array<long>, s0 long, s1 long"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2_000_000):
            sets = shingle_sets(batch.column("_text").to_pylist(), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            s0: list = [None] * len(sets)
            s1: list = [None] * len(sets)
            digest: list = [None] * len(sets)
            if full:
                sig = signatures([sets[i] for i in full])
                for i, key, sketch in zip(full, band_keys(sig), sketches(sig), strict=True):
                    keys[i], s0[i], s1[i] = key, int(sketch[0]), int(sketch[1])
                    digest[i] = xxhash.xxh3_128_digest(sets[i])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(s0, pa.int64()),
                    pa.array(s1, pa.int64()),
                ],
                names=["_id", "n_shingles", "set_key", "keys", "s0", "s1"],
            )

    return run


def _sets(k: int, wide: bool):
    kind = np.int64 if wide else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # a repeated row has its set once in a task
        for batch in slices(batches, "_text", 2_000_000):
            sets = shingle_sets(batch.column("_text").to_pylist(), k)
            names = [(i, xxhash.xxh3_128_digest(s)) for i, s in zip(batch.column("_id").to_pylist(), sets, strict=True)]
            first = [i for i, name in enumerate(names) if name not in seen and not seen.add(name)]
            if len(first) < len(sets):
                batch, sets = batch.take(pa.array(first, pa.int64())), [sets[i] for i in first]
                if not sets:
                    continue
            sizes = np.array([len(s) for s in sets], np.int32)
            if not wide:
                sets = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in sets]
            sets = [s.view(kind) for s in sets]
            lost = sizes - np.array([len(s) for s in sets], np.int32)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))), pa.array(lost)],
                names=["_id", "members", "lost"],
            )

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, k: int, wide: bool) -> DataFrame:
    """(_id, members, lost): the shingle sets of the documents whose ids are asked for, as 64-bit or 32-bit hashes.

    lost: how many of a document's shingles share a 32-bit hash with another of its own.
    """
    kind = T.LongType() if wide else T.IntegerType()
    fields = [T.StructField("_id", T.LongType()), T.StructField("members", T.ArrayType(kind)), T.StructField("lost", T.IntegerType())]
    return join_small(docs, ids, docs["_id"] == ids["want"], "left_semi").mapInArrow(_sets(k, wide), T.StructType(fields))


def _scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds to pairs (a, b) their sets' sizes na and nb, the hashes they share (i), and the most by which i may be wrong.

    Of the shared shingles i misses at most those that share a hash within a set, which are known (the
    lesser ``lost``). It has too many where different shingles of the two sets share a hash: na * nb / 2**32
    are expected; four times that and four more are allowed for.
    """
    of = lambda end: sets.select(
        F.col("_id").alias(end), F.col("members").alias(f"m{end}"), F.col("lost").alias(f"lost{end}"),
        (F.size("members") + F.col("lost")).cast("long").alias(f"n{end}"),
    )
    both = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("ma", "mb")).cast("long")
    wrong = F.least("losta", "lostb") + 4 + F.ceil(F.col("na").cast("double") * F.col("nb") / float(1 << 30))
    return both.select("a", "b", "na", "nb", shared.alias("i"), wrong.cast("long").alias("wrong"))


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("want")).union(pairs.select(F.col("b").alias("want"))).distinct()


def _confirmed(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity.

    Sets of 32-bit hashes decide where their collisions could not; the others are compared on 64 bits.
    """
    gap = F.col("i") * (100 + percent) - (F.col("na") + F.col("nb")) * percent
    rough = cut(_scored(pairs, sets).withColumn("gap", gap))
    margin = F.col("wrong") * (100 + percent)
    sure = rough.where(F.col("gap") > margin)
    near = rough.where(F.abs("gap") <= margin)
    if near.isEmpty():
        return sure.select("a", "b")
    exact = _scored(near, _sets_of(docs, cut(_ids(near)), k, True)).where(gap >= 0)
    return cut(sure.select("a", "b").union(exact.select("a", "b")))


def _may_link(percent: int) -> Column:
    """The size test and the sketch test of a pair with columns na, nb, s0a, ..."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    apart = F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))) + F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b")))
    return (small * 100 >= large * percent) & (apart <= MOST_BITS_APART)


def _side(marks: DataFrame, end: str) -> DataFrame:
    return marks.select(
        F.col("_id").alias(end), F.col("n_shingles").alias(f"n{end}"), F.col("s0").alias(f"s0{end}"),
        F.col("s1").alias(f"s1{end}"),
    )


def _tested(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    apart = F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))) + F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b")))
    return (
        pairs.join(_side(marks, "a"), "a").join(_side(marks, "b"), "b")
        .where(_may_link(percent))
        .select("a", "b", apart.alias("apart"))
    )


def _labelled(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs with the component of each end (its own id if it has no link), where the two differ."""
    ca = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    cb = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    out = pairs.join(ca, "a", "left").join(cb, "b", "left")
    out = out.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
    return out.where("ca != cb")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, most_tests: int = MOST_TESTS
) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (least id reachable by links), kept.

    Links join documents whose sets of k-word shingles have Jaccard similarity of at least percent / 100.
    Words are runs of non-white-space with A-Z in lower case. A text without words (or null) has an empty
    set and no links. Copies, repeated ids and ties: the least id of a component is its kept one; a
    repeated id is one node. A null id links nothing, belongs to the component of its copies if it has
    any, and else has a null component and is kept. An empty table gives no rows. Other columns of
    ``docs`` are not looked at. A text's shingles are held whole in one task: about 100 bytes for each word.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signed = cut(docs.mapInArrow(_sign(k), _SIGNED))

    full = signed.where("set_key is not null")
    classes = cut(full.groupBy("set_key").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    with_rep = join_groups(full.select("_id", "n_shingles", "set_key"), classes, "set_key").select("_id", "n_shingles", "rep")
    without = signed.where("set_key is null").select("_id", "n_shingles", F.lit(None).cast("long").alias("rep"))
    of_doc = cut(with_rep.union(without))
    marks = cut(
        full.select("_id", "set_key", "n_shingles", "keys", "s0", "s1")
        .join(classes.select(F.col("set_key").alias("_set"), "rep"), (F.col("_id") == F.col("rep")) & (F.col("set_key") == F.col("_set")))
        .dropDuplicates(["_id", "set_key"])
        .select("_id", "n_shingles", "keys", "s0", "s1")
    )
    drop(signed, classes)

    rows = marks.select("_id", F.explode("keys").alias("key"))
    pivots = cut(rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("_id").alias("p0"),
        F.min(F.struct(F.xxhash64("_id", "key").alias("h"), F.col("_id").alias("p"))).alias("p1"),
    ).where("n > 1").select("key", "n", "p0", F.col("p1.p").alias("p1")))
    shared = cut(join_groups(rows, pivots, "key"))

    star = shared.select("_id", F.explode(F.array("p0", "p1")).alias("p")).where("_id != p")
    star = star.select(F.least("_id", "p").alias("a"), F.greatest("_id", "p").alias("b")).distinct()
    pairs = cut(_tested(star, marks, percent))
    sets = cut(_sets_of(docs, cut(shared.select(F.col("_id").alias("want")).distinct()), k, False))

    best = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = _confirmed(docs, sets, best, k, percent)
    comps = cut(components(links))
    rest = cut(_labelled(pairs, comps).join(best, ["a", "b"], "left_anti").select("a", "b"))
    more = _confirmed(docs, sets, rest, k, percent)
    comps = cut(_merged(comps, more))

    done = best.union(rest)
    left = cut(_across(shared, marks, sets, comps, percent, most_tests).join(done, ["a", "b"], "left_anti"))
    more = _confirmed(docs, sets, left, k, percent)
    comps = cut(_merged(comps, more))
    drop(marks, pivots, shared, pairs, sets, rest, left)

    return (
        of_doc.join(comps, F.col("rep") == F.col("node"), "left")
        .withColumn("component_id", F.coalesce("comp", "rep", "_id"))
        .select(
            F.col("_id").alias(id_col), "n_shingles", "component_id",
            F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the links between old components are solved on their own, then carried over."""
    if links.isEmpty():
        return comps
    over = cut(components(_labelled(links, comps).select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    lifted = comps.select(F.col("node"), F.col("comp").alias("old")).join(
        over.select(F.col("node").alias("old"), F.col("comp").alias("new")), "old", "left"
    )
    lifted = lifted.select("node", F.coalesce("new", "old").alias("comp"))
    alone = over.join(comps.select("node"), "node", "left_anti")
    return lifted.union(alone.select("node", "comp"))


def _segments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the number of its not lone shingles in each of SEGMENTS parts of the hash range."""
    for batch in rows:
        found = []
        for members, lone in zip(batch.column("members"), batch.column("lone"), strict=True):
            held = members.values.to_numpy()
            if lone.is_valid:
                held = np.setdiff1d(held, lone.values.to_numpy(), assume_unique=True)
            found.append(np.bincount(held.view(np.uint32) % SEGMENTS, minlength=SEGMENTS).astype(np.int32))
        lost = batch.column("lost").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"), pa.array([int(x.sum() + n) for x, n in zip(found, lost, strict=True)], pa.int64()),
                pa.array(lost, pa.int32()), pa.array(found, pa.list_(pa.int32())),
            ],
            names=["_id", "most", "lost", "seg"],
        )


def _bounds(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(_id, most, lost, seg): shingles that some other of these documents has too, in all and by segment.

    A shingle that only one of them has is in no intersection, and two sets share at most
    sum(least(seg of a, seg of b)) shingles, and as many more as share a hash within the set that has fewer such.
    """
    held = sets.join(ids, "_id", "left_semi")
    once = held.select("_id", F.explode("members").alias("m")).groupBy("m")
    once = once.agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("of")).where("n = 1")
    lone = once.groupBy("of").agg(F.collect_list("m").alias("lone"))  # at most a document's own shingles
    return held.join(lone, F.col("_id") == F.col("of"), "left").select("_id", "members", "lost", "lone").mapInArrow(
        _segments, "_id long, most long, lost int, seg array<int>"
    )


def _near_enough(percent: int) -> Column:
    """The tests of a pair with columns na, nb, ia, ib, la, lb, sa, sb, s0a, ... that no link fails but by its sketch."""

    def enough(both: Column) -> Column:
        return both * 100 >= (F.col("na") + F.col("nb") - both) * percent

    lost = F.least("la", "lb")
    both = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), lost, lambda x, y: x + y)
    return _may_link(percent) & enough(F.least("ia", "ib")) & enough(both)


def _end(rows: DataFrame, end: str, *more: Column) -> DataFrame:
    """A document's marks and bounds, as those of one end of a pair."""
    return rows.select(
        F.col("_id").alias(end), F.col("n_shingles").alias(f"n{end}"), F.col("most").alias(f"i{end}"), F.col("lost").alias(f"l{end}"),
        F.col("seg").alias(f"s{end}"), F.col("s0").alias(f"s0{end}"), F.col("s1").alias(f"s1{end}"), *more,
    )


def _across(
    shared: DataFrame, marks: DataFrame, sets: DataFrame, comps: DataFrame, percent: int, most_tests: int
) -> DataFrame:
    """Candidate pairs of one bucket that are in different components.

    Such a pair has at least one row outside the bucket's largest component; those rows meet all others.
    The bounds on intersections (see ``_bounds``) keep documents that are near a large group, but link
    with none of it, from being compared with all of it. They are exact: no link fails them. A bucket in
    which more than ``most_tests`` pairs would meet is joined by rare shingles instead (``_by_rare``).
    """
    named = shared.select("_id", "key").join(
        comps.select(F.col("node").alias("_id"), "comp"), "_id", "left"
    )
    named = named.select("key", "_id", F.coalesce("comp", "_id").alias("comp"))
    groups = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = cut(
        groups.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"))
        .where("c > 1").select("key", "n", F.col("top.comp").alias("main"))
    )
    open_keys = cut(join_groups(named, mixed, "key"))
    bounds = _bounds(sets, open_keys.select("_id").distinct())
    of_doc = marks.join(bounds, "_id")
    of_doc = cut(of_doc.where(F.col("most") * 100 >= F.col("n_shingles") * percent))
    open_rows = cut(open_keys.join(of_doc, "_id"))

    few_of = F.count(F.when(F.col("comp") != F.col("main"), 1))
    sizes = open_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), few_of.alias("few"))
    heavy = cut(sizes.where((F.col("few") * F.col("n") > most_tests)).select("key", "n"))
    light, found = open_rows, []
    if not heavy.isEmpty():
        light = join_small(open_rows, heavy.select(F.col("key").alias("_heavy")), F.col("key") == F.col("_heavy"), "left_anti")
        found.append(_by_rare(join_groups(open_rows.select("key", "_id", "n_shingles", "comp"), heavy, "key"), of_doc, sets, percent))

    few = _end(light.where("comp != main"), "a", F.col("key"), F.col("comp").alias("ca"), F.col("keys").alias("ka"))
    all_rows = _end(light, "b", F.col("key").alias("key_b"), F.col("comp").alias("cb"), F.col("main").alias("mb"), F.col("keys").alias("kb"))
    on = (F.col("key") == F.col("key_b")) & (F.col("ca") != F.col("cb"))
    on = on & ((F.col("cb") == F.col("mb")) | (F.col("a") < F.col("b"))) & _near_enough(percent)
    met = few.join(all_rows, on & (F.array_min(F.array_intersect("ka", "kb")) == F.col("key")))  # once for each pair of documents
    if found:  # a pair whose first bucket is a heavy one may meet in light ones too
        met = few.join(all_rows, on)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for other in found:
        met = met.union(other)
    drop(open_keys, mixed)
    return met.distinct()


def _by_rare(rows: DataFrame, of_doc: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components in the buckets of ``rows`` (key, _id, n_shingles, comp), by prefix filtering.

    With each document's shingles in one order, the rarest among these documents first, two documents
    that share enough have one in common among the first of each: so many of the smaller (or, of equals,
    the one of the lesser id) as it may miss of the other, and the same of the larger. Copies of one
    template that differ too much to link share none of these, as the template's shingles come last.
    """
    rows = cut(rows)
    held = sets.join(rows.select("_id").distinct(), "_id", "left_semi").select("_id", F.explode("members").alias("m"))
    counts = cut(held.groupBy("m").agg(F.count(F.lit(1)).alias("n")))
    ranked = join_groups(held, counts.withColumn("seen", F.col("n")), "m").groupBy("_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seen", "m"))), lambda x: x["m"]).alias("by_rank")
    )  # an array holds no more than one document's shingles
    n, by_id = F.col("n_shingles"), cut(ranked)
    first = F.floor(n * (100 - percent) / (100 + percent)).cast("int") + 1
    last = F.floor(n * (100 - percent) / 100).cast("int") + 1

    def prefixes(length: Column, end: str) -> DataFrame:
        more = F.greatest(F.size("by_rank") - n.cast("int"), F.lit(0))  # the shingles of another text of a repeated id
        some = rows.join(by_id, "_id").select("key", "_id", "n_shingles", "comp", F.explode(F.slice("by_rank", 1, length + more)).alias("m"))
        return some.select("key", "m", F.col("_id").alias(end), F.col("n_shingles").alias(f"n{end}"), F.col("comp").alias(f"c{end}"))

    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = prefixes(first, "a").join(prefixes(last, "b"), ["key", "m"])
    met = met.where(smaller & (F.col("ca") != F.col("cb")) & (F.col("na") * 100 >= F.col("nb") * percent)).select("a", "b").distinct()
    tested = met.join(_end(of_doc, "a"), "a").join(_end(of_doc, "b"), "b").where(_near_enough(percent))
    return tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
