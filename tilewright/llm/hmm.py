"""A hidden Markov language model, trained by Baum-Welch over all training documents.

A document is the sequence of its words (A-Z in lower case) and one end token. Each token has a class:
the end, each of the most frequent words, and, for all others, one of a fixed number of classes by the
crc32 of the word's last bytes. A state emits a class; the class emits the word by its corpus count:

    P(text) = sum over state paths of  prod P(state | state before) P(class | state) P(word | class)

so every word of the corpus, and one unknown word in each class, has its own probability. The count of
every training word comes from all training documents, and Baum-Welch counts are summed over the
partitions of all training documents in each round.

States start from word clusters: documents' occurrences of the commonest words are multiplied into a
co-occurrence table (summed over all partitions), and its leading directions place the states.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, lower_words_of, slices

STATES, ROUNDS = 6, 2
#: Words with a class of their own, and classes of all other words; class 0 is the end.
OWN, SHARED = 8192, 2048
#: Words whose counts are sent to every task; the counts of others are joined.
SENT = 200_000
ANCHORS = 256
_BLOCK = 8_000_000


def shared_class(word: bytes, own: int = OWN, shared: int = SHARED) -> int:
    """The class of a word that has none of its own."""
    return 1 + own + zlib.crc32(word[-3:]) % shared


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    #: (states, classes)
    emit: np.ndarray
    totals: np.ndarray = field(default=None)


def forward(model: Model, docs: list[np.ndarray], counts: bool = False):
    """Natural-log likelihoods of class sequences by the scaled forward recursion; with ``counts`` also
    the expected starts, moves and emissions, by the scaled backward recursion.

    Sequences advance together, longest first, so that step t works on those longer than t.
    """
    order = np.argsort([-len(d) for d in docs], kind="stable")
    lengths = np.array([len(docs[i]) for i in order])
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    bases = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(int(bases[-1]), np.int32)  # step by step
    for place, i in enumerate(order):
        flat[bases[: len(docs[i])] + place] = docs[i]
    emit, states = np.ascontiguousarray(model.emit.T), len(model.start)
    logs = np.zeros(len(docs))
    kept = np.empty((len(flat), states)) if counts else None
    scales = np.empty(len(flat)) if counts else None
    now = np.empty((0, states))
    for t in range(steps):
        n, at = active[t], bases[t]
        seen = emit[flat[at : at + n]]
        now = (model.start * seen) if t == 0 else (now[:n] @ model.move) * seen
        scale = now.sum(axis=1)
        now /= scale[:, None]
        logs[:n] += np.log(scale)
        if counts:
            kept[at : at + n], scales[at : at + n] = now, scale
    out = np.empty(len(docs))
    out[order] = logs
    if not counts:
        return out
    moves, back = np.zeros_like(model.move), np.empty((0, states))
    for t in range(steps - 1, -1, -1):
        n, at = active[t], bases[t]
        if len(back) < n:
            back = np.concatenate([back, np.ones((n - len(back), states))])
        now = kept[at : at + n].copy()
        kept[at : at + n] *= back
        if t:
            back = back * emit[flat[at : at + n]] / scales[at : at + n, None]
            moves += kept[bases[t - 1] : bases[t - 1] + n].T @ back
            back = back @ model.move.T
        del now
    starts = kept[: active[0]].sum(axis=0) if steps else np.zeros(states)
    emits = np.stack([np.bincount(flat, kept[:, s], emit.shape[0]) for s in range(states)])
    return out, starts, moves * model.move, emits


def _grouped(batches: Iterator[pa.RecordBatch], bytes_each: int) -> Iterator[pa.RecordBatch]:
    """Joins small batches and cuts large ones, so that steps are shared by many documents."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, "ids", bytes_each):
        held.append(batch)
        size += int(pa.compute.sum(pa.compute.binary_length(batch.column("ids"))).as_py() or 0)
        if size >= bytes_each:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c): a task's counts, handed on whenever a million words are held."""
    held: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words = list(held)
        for a in range(0, len(words), 50_000):
            some = words[a : a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.binary()), pa.array([held[w] for w in some], pa.int64())], names=["word", "c"]
            )
        held.clear()

    for batch in slices(batches, "_text", _BLOCK):
        for text in batch.column("_text").to_pylist():
            held.update(lower_words_of(text))
        if len(held) > 1_000_000:
            yield from out()
    yield from out()


class _Classes(dict):
    """Word to (class + 1) * 2 ** 40 + its sent count; words not sent have count 0."""

    def __init__(self, sent: list[tuple[bytes, int]]):
        super().__init__()
        self.base = len(sent)
        for i, (word, c) in enumerate(sent):
            k = 1 + i if i < OWN else shared_class(word)
            self[word] = (k << 40) + c

    def __missing__(self, word: bytes) -> int:
        if len(self) < self.base + 500_000:
            self[word] = v = shared_class(word) << 40
            return v
        return shared_class(word) << 40


def _encode(sent, ends: int, train_tokens: int, v_all: int, class_n: np.ndarray, class_v: np.ndarray) -> Callable:
    """Documents to class ids, and all that the sent counts tell of the two scores.

    rare: the words that were not sent, each with its number here; their share of the scores follows by a join.
    """
    table: list[_Classes] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not table:
            table.append(_Classes(sent.value))
        look, size = table[0], 0.5 * (v_all + 1)
        log_all = np.log10(train_tokens + size)
        log_class = np.log10(class_n + 0.5 * (class_v + 1))
        first_shared = 1 + OWN
        for batch in slices(batches, "_text", _BLOCK):
            cols: dict[str, list] = {k: [] for k in ("ids", "n_tokens", "n_known", "base_score", "word_score", "rare")}
            for text in batch.column("_text").to_pylist():
                words = lower_words_of(text)
                both = np.fromiter(map(look.__getitem__, words), np.int64, len(words))
                kinds, c = both >> 40, both & ((1 << 40) - 1)
                known = c > 0
                shared = known & (kinds >= first_shared)
                base = np.log10(c[known] + 0.5).sum() + np.log10(ends + 0.5) - log_all * (len(words) + 1)
                inside = np.log10(c[shared] + 0.5).sum() - log_class[kinds[kinds >= first_shared]].sum()
                rare = Counter(w for w, k in zip(words, known.tolist(), strict=True) if not k) if not known.all() else {}
                cols["ids"].append(np.append(kinds, 0).astype(np.uint16).tobytes())
                cols["n_tokens"].append(len(words) + 1)
                cols["n_known"].append(int(known.sum()) + (ends > 0))
                cols["base_score"].append(float(base))
                cols["word_score"].append(float(inside))
                cols["rare"].append([{"word": w, "n": n} for w, n in rare.items()])
            rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row"), batch.column("_id"), batch.column("held_out"), pa.array(cols["ids"], pa.binary()),
                    pa.array(cols["n_tokens"], pa.int64()), pa.array(cols["n_known"], pa.int64()),
                    pa.array(cols["base_score"], pa.float64()), pa.array(cols["word_score"], pa.float64()),
                    pa.array(cols["rare"], rare_type),
                ],
                names=["_row", "_id", "held_out", *cols],
            )

    return run


_CODED = (
    "_row long, _id long, held_out boolean, ids binary, n_tokens long, n_known long, base_score double, "
    "word_score double, rare array<struct<word: binary, n: int>>"
)


def _co_occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, row): this task's rows of the co-occurrence table of the commonest words."""
    total = np.zeros((ANCHORS, ANCHORS))
    for batch in _grouped(batches, 2_000_000):
        some = [x[(x > 0) & (x <= ANCHORS)].astype(np.int64) - 1 for x in _ids(batch)]
        index = np.concatenate([x + ANCHORS * i for i, x in enumerate(some)])
        table = np.minimum(np.bincount(index, minlength=ANCHORS * len(some)).reshape(-1, ANCHORS), 1).astype(np.float64)
        total += table.T @ table
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(ANCHORS), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"]
    )


def _expect(model_cast) -> Callable:
    """(kind, i, row): this task's Baum-Welch counts; kind 0 starts, 1 moves by state, 2 emissions by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_cast.value
        starts, moves = np.zeros_like(model.start), np.zeros_like(model.move)
        emits = np.zeros_like(model.emit)
        for batch in _grouped(batches, 2_000_000):
            _, s, m, e = forward(model, _ids(batch), counts=True)
            starts += s
            moves += m
            emits += e
        used = np.flatnonzero(emits.sum(axis=0))
        kind = np.concatenate([[0], np.full(len(moves), 1), np.full(len(used), 2)])
        i = np.concatenate([[0], np.arange(len(moves)), used])
        rows = np.concatenate([starts[None], moves, emits[:, used].T])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(i, pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))],
            names=["kind", "i", "row"],
        )

    return run


def _score(model_cast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, 2_000_000):
            logs = forward(model_cast.value, _ids(batch)) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(logs)], names=["_row", "path_score"])

    return run


def _sums(counts: DataFrame, keys: list[str], width: int) -> list:
    """Sums arrays by key; at most one row per key reaches the driver, and keys are a fixed number."""
    parts = [F.sum(F.col("row")[j]).alias(f"s{j}") for j in range(width)]
    return counts.groupBy(*keys).agg(*parts).collect()


def _most_frequent(words: DataFrame, most: int) -> list:
    """At most so many words, by falling counts: all words above a count that a histogram of counts gives."""
    grade = F.floor(F.log2("c") * 16).cast("int")
    kept, least = 0, None
    for r in words.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("g")).collect():
        if kept + r["n"] > most:
            break
        kept, least = kept + r["n"], r["g"]
    found = [] if least is None else words.where(grade >= least).collect()
    return sorted(found, key=lambda r: (-r["c"], bytes(r["word"])))


def _own_and_sent(words: DataFrame, own: int, most: int) -> list:
    """The ``own`` commonest words (exact, ties by their bytes), then other frequent words, some ``most`` in all."""
    first = words.orderBy(F.desc("c"), "word").limit(own).collect()
    held = {bytes(r["word"]) for r in first}
    return first + [r for r in _most_frequent(words, most) if bytes(r["word"]) not in held]


def _first_model(table: np.ndarray, totals: np.ndarray, states: int) -> Model:
    """States from word clusters, each word's share of a state falling with its distance from the state's centre."""
    seen = np.maximum(np.diag(table), 1e-9)
    cosine = table / np.sqrt(np.outer(seen, seen))
    values, vectors = np.linalg.eigh(cosine)
    place = vectors[:, -states:] * np.sqrt(np.maximum(values[-states:], 0))
    place /= np.linalg.norm(place, axis=1, keepdims=True) + 1e-12
    centres = [place[0]]
    while len(centres) < states:  # farthest first
        centres.append(place[np.argmax(np.min([((place - c) ** 2).sum(axis=1) for c in centres], axis=0))])
    centres = np.array(centres)
    for _ in range(20):
        near = ((place[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for s in range(states):
            if (near == s).any():
                centres[s] = place[near == s].mean(axis=0)
    far = ((place[:, None] - centres[None]) ** 2).sum(axis=2)
    share = np.exp(-4 * far) + 0.02
    share /= share.sum(axis=1, keepdims=True)
    emit = np.tile((totals + 0.5) / (totals + 0.5).sum(), (states, 1))
    emit[:, 1 : 1 + len(share)] *= share.T * states
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit, totals)


def _next_model(rows: list, states: int, totals: np.ndarray) -> Model:
    """Baum-Welch's new parameters; counts are smoothed by the corpus' own class shares, worth 200 tokens a state."""
    start, move = np.full(states, 0.5), np.full((states, states), 0.5)
    emit = np.tile(200 * (totals + 0.5) / (totals + 0.5).sum(), (states, 1))
    for r in rows:
        row = np.array(r[2:], float)
        if r["kind"] == 0:
            start += row
        elif r["kind"] == 1:
            move[r["i"]] += row
        else:
            emit[:, r["i"]] += row
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True), totals)


def _word_class(word: Column) -> Column:
    """``shared_class`` by built-in functions."""
    tail = F.substring(word, F.greatest(F.octet_length(word) - 2, F.lit(1)), F.lit(3))
    return (F.crc32(tail) % SHARED + 1 + OWN).cast("int")


@dataclass
class Trained:
    """What training leaves: the model, the counts of words and of classes, and the coded documents."""

    model: Model
    coded: DataFrame
    #: word, c: all words of the training documents
    words: DataFrame
    own: list[bytes]
    train_tokens: int
    class_n: np.ndarray
    class_v: np.ndarray


def train(rows: DataFrame, states: int, rounds: int) -> Trained:
    """Learns from the rows (_id, _text, held_out) that are not held out; codes all of them."""
    spark = rows.sparkSession
    learnt = rows.where("not held_out")
    ends = learnt.select("_id").count()
    words = cut(learnt.select("_text").mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    top = _own_and_sent(words, OWN, SENT)
    sent = spark.sparkContext.broadcast([(bytes(r["word"]), r["c"]) for r in top])
    n_all, v_words = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, v_all = n_all + ends, v_words + (ends > 0)

    class_n, class_v = np.zeros(1 + OWN + SHARED), np.zeros(1 + OWN + SHARED)
    by_class = words.groupBy(_word_class(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    for r in by_class.collect():
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    for r in top[:OWN]:
        k = shared_class(bytes(r["word"]))
        class_n[k] -= r["c"]
        class_v[k] -= 1
    totals = class_n.copy()
    totals[0] = ends
    totals[1 : 1 + len(top[:OWN])] = [r["c"] for r in top[:OWN]]

    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    coder = _encode(sent, ends, train_tokens, v_all, class_n, class_v)
    coded = cut(numbered.select("_row", "_id", "held_out", "_text").mapInArrow(coder, _CODED))

    learn = coded.where("not held_out").select("ids")
    table = np.zeros((ANCHORS, ANCHORS))
    for r in _sums(learn.mapInArrow(_co_occur, "i int, row array<double>"), ["i"], ANCHORS):
        table[r["i"]] = r[1:]
    model = _first_model(table, totals, states)
    for _ in range(rounds):
        found = learn.mapInArrow(_expect(spark.sparkContext.broadcast(model)), "kind int, i int, row array<double>")
        model = _next_model(_sums(found, ["kind", "i"], states), states, totals)
    return Trained(model, coded, words, [bytes(r["word"]) for r in top[:OWN]], train_tokens, class_n, class_v)


def hmm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS
) -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(id as text) mod 5 is not 1 (a null id counts as the empty text).
    base_score is the smoothed unigram log10 probability; score is the model's log10 probability of the
    whole text. A null or empty text is its end token alone. Repeated rows each count and get a row. With
    no training rows all counts are 0 and the scores follow from the smoothing alone; an empty table gives
    no rows. Equally frequent words are ordered by their bytes, so reruns agree but for the order of sums.
    Other columns are not looked at. A text is scored whole in one task: about 100 bytes of memory for
    each of its words while it trains (its states at every place), 16 while it is scored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("held_out", crc_mod(F.col("_id"), 5) == 1)

    held = train(rows, states, rounds)
    coded = held.coded
    paths = coded.select("_row", "ids").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(held.model)), "_row long, path_score double")

    spread = coded.select("_row", F.explode("rare").alias("r")).select("_row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    rare = (
        spread.join(held.words, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        .groupBy("_row").agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("more_score"),
        )
    )
    out = coded.drop("ids", "rare").join(paths, "_row").join(rare, "_row", "left")
    more = F.coalesce("more_score", F.lit(0.0))
    return out.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(held.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("path_score") + F.col("word_score") + more).alias("score"),
    )
