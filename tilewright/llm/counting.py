"""Token counts without token ids: each distinct pre-token is counted once, documents hold frequencies of pre-tokens.

A tokenizer cuts a text into pre-tokens and each of them into pieces by itself, so a text's tokens are the sum of
its pre-tokens' pieces. Texts become, in lots of some megabytes, a list of the lot's distinct pre-tokens and each
document's frequencies by place in that list. The lists are dealt out by hash, so that equal pre-tokens of all
lots meet in one task, which counts each once and sends the numbers of pieces back to the lots. There they meet the
frequencies. A pre-token is shuffled once for each lot, however often it occurs, so common ones make no hot key.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import _by_words

#: Text of one lot (or so many documents), and text whose distinct pre-tokens are one share.
LOT_BYTES, LOT_DOCS, SHARE_BYTES = 16_000_000, 200_000, 64 << 20
#: Words and pre-tokens that a worker remembers; beyond that it forgets all and looks them up again.
REMEMBERED = 500_000

#: A lot's documents stand in a row with share -1, its pre-tokens in one row for each share that has some.
_LOTS = "lot long, share int, first int, words binary, ids array<long>, n_bytes array<long>, others array<long>, counts binary"
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Cutter:
    """Cuts texts into pre-tokens by the tokenizers library.

    Where the tokenizer's settings say that it always cuts before single spaces and around single line breaks
    (see ``tokens``), the library cuts each distinct word once, else whole texts. Strings of added tokens are
    cut out before, as the library does by default; if some have settings of their own (``lstrip`` ...), a text
    that holds one of the strings is counted by the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        settings = json.loads(self.tokenizer.to_str())
        added = settings.get("added_tokens") or []
        strings = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.by_words = _by_words(settings)
        # How this tokenizer writes a space and the letters of Latin script, which it never parts from each other.
        self.space, self.latin = "", {}
        if self.by_words:
            self.space = self.cut(" a")[0][:-1]
            self.latin = {c: self.cut(chr(c))[0] for c in range(0x250) if chr(c).isalpha()}
        self.held: dict[str, tuple[str, ...]] = {}
        self.pieces: dict[bytes, int] = {}

    def cut(self, text: str) -> tuple[str, ...]:
        """Pre-tokens of a text without added tokens, as the model gets them."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.tokenizer.pre_tokenizer is None:
            return (text,) if text else ()
        return tuple(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def _word(self, word: str) -> tuple[str, ...]:
        made = self.held.get(word)
        if made is None:
            if len(self.held) >= REMEMBERED:
                self.held.clear()
            made = self.held[word] = self._latin(word) if self.by_words else self.cut(word)
        return made

    def _latin(self, word: str) -> tuple[str, ...]:
        """As ``cut``, without the library for a word of Latin letters, with or without a space before and a mark after it."""
        bare, space = (word[1:], self.space) if word[:1] == " " else (word, "")
        mark = bare[-1:] if bare[-1:] in (",", ".", ";", ":", "!", "?") else ""
        bare = bare.removesuffix(mark)
        if bare.isalpha() and max(bare) < "\u0250":
            made = space + (bare if bare.isascii() else bare.translate(self.latin))
            return (made, mark) if mark else (made,)
        return self.cut(word)

    def frequencies(self, text: str) -> tuple[dict[str, int], int]:
        """How often each pre-token occurs, and the number of tokens that are no pre-token's pieces."""
        special, texts = 0, [text]
        if self.added is not None and self.added.search(text):
            if not self.plain:
                return {}, len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            texts = self.added.split(text)
            special = len(texts) - 1
        found: dict[str, int] = defaultdict(int)
        for some in filter(None, texts):
            if not self.by_words:
                for piece in self.cut(some):
                    found[piece] += 1
                continue
            # Between non-space characters, a single space opens a pre-token and a single line break is one.
            opening: Counter[str] = Counter()
            spaced: Counter[str] = Counter()
            if len(some.split()) == some.count(" ") + some.count("\n") + 1:  # no other space anywhere
                lines = some.split("\n")
                if len(lines) > 1:
                    for piece in self._word("\n"):
                        found[piece] += len(lines) - 1
                for line in lines:
                    words = line.split(" ")
                    opening[words[0]] += 1
                    spaced.update(words[1:])
            else:
                first, *others = _SINGLE_SPACE.split(some)
                opening[first] += 1
                spaced.update(others)
            for words, space in ((opening, ""), (spaced, " ")):
                for word, n in words.items():
                    for piece in self._word(space + word):
                        found[piece] += n
        return found, special

    def n_pieces(self, word: bytes) -> int:
        n = self.pieces.get(word)
        if n is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            n = self.pieces[word] = len(self.tokenizer.model.tokenize(word.decode()))
        return n


_CUTTERS: dict[str, _Cutter] = {}


def _cutter(path: str) -> _Cutter:
    if path not in _CUTTERS:
        _CUTTERS[path] = _Cutter(path)
    return _CUTTERS[path]


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes: all lowest bytes first, as the high ones are mostly zero."""
    flat = np.concatenate([np.array([len(a) for a in arrays]), *arrays]).astype("<i4")
    return flat.nbytes.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(held: bytes, n: int) -> list[np.ndarray]:
    """The ``n`` arrays of ``_packed``."""
    raw = pa.decompress(held[8:], int.from_bytes(held[:8], "little"), "zstd", asbytes=True)
    flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)
    return np.split(flat[n:], np.cumsum(flat[:n])[:-1])


def _packed_words(words: list[bytes]) -> bytes:
    lengths, text = _packed(np.array([len(w) for w in words])), b"".join(words)
    return len(lengths).to_bytes(8, "little") + lengths + len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def _unpacked_words(held: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(held[:8], "little")
    (lengths,) = _unpacked(held[8:at], 1)
    text = pa.decompress(held[at + 8 :], int.from_bytes(held[at : at + 8], "little"), "zstd", asbytes=True)
    ends = np.cumsum(lengths).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _lot(cutter: _Cutter, lot: int, rows: list[tuple[int | None, str | None]], shares: int) -> pa.RecordBatch:
    """The rows of one lot: pre-tokens are numbered by share, frequencies are packed as (how many, steps, frequencies)."""
    number: dict[str, int] = defaultdict(count().__next__)
    others, places, often = [], [], []
    for _, text in rows:
        found, special = cutter.frequencies(text or "")
        others.append(special)
        places.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
        often.append(np.fromiter(found.values(), np.int32, len(found)))
    words = [w.encode() for w in number]
    share = [zlib.crc32(w) % shares for w in words]
    order = sorted(range(len(words)), key=lambda i: (share[i], words[i]))
    moved = np.empty(len(words), np.int64)
    moved[order] = np.arange(len(words))
    share = np.array(share, np.int64)[order]
    # Each document's pre-tokens in ascending order, as steps from one to the next.
    sizes = np.array([len(p) for p in places])
    pairs = np.repeat(np.arange(len(rows)), sizes) * (len(words) + 1) + moved[np.concatenate(places)]
    by_doc = np.argsort(pairs, kind="stable")
    steps = np.diff(pairs[by_doc] % (len(words) + 1), prepend=0)
    often = np.concatenate(often)[by_doc]
    held, first, n = np.unique(share, return_index=True, return_counts=True)
    one = [None] * len(held)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lot] * (len(held) + 1), pa.int64()), pa.array([-1, *held.tolist()], pa.int32()), pa.array([None, *first.tolist()], pa.int32()),
            pa.array([None, *(_packed_words([words[i] for i in order[a : a + k]]) for a, k in zip(first.tolist(), n.tolist(), strict=True))], pa.binary()),
            pa.array([[i for i, _ in rows], *one], pa.list_(pa.int64())), pa.array([[len((t or "").encode()) for _, t in rows], *one], pa.list_(pa.int64())),
            pa.array([others, *one], pa.list_(pa.int64())), pa.array([_packed(sizes, steps, often), *one], pa.binary()),
        ],
        names=_names(_LOTS),
    )


def _lots(tokenizer: str, shares: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, lot, rows, size = _cutter(tokenizer), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
                rows.append((doc_id, text.as_py()))
                size += len(rows[-1][1] or "")
                if size >= LOT_BYTES or len(rows) >= LOT_DOCS:
                    yield _lot(cutter, lot, rows, shares)
                    lot, rows, size = lot + 1, [], 0
        if rows:
            yield _lot(cutter, lot, rows, shares)

    return run


def _counter(tokenizer: str) -> Callable:
    """Numbers of pieces of each row's pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(tokenizer)
        for batch in batches:
            pieces = [_packed(np.array([cutter.n_pieces(w) for w in _unpacked_words(words.as_py())])) for words in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("lot"), batch.column("first"), pa.array(pieces, pa.binary())], names=["lot", "first", "pieces"])

    return run


_COUNTED = "doc_id long, n_bytes long, n_tokens long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequencies times pieces, summed for each document of a lot."""
    for batch in batches:
        for lot in batch.to_pylist():
            sizes, steps, often = _unpacked(lot["counts"], 3)
            found = sorted(lot["found"] or [], key=lambda p: p["first"])
            pieces = np.concatenate([np.empty(0, np.int64), *(_unpacked(p["pieces"], 1)[0] for p in found)])
            ends = np.cumsum(sizes)
            running = np.concatenate([[0], np.cumsum(pieces[np.cumsum(steps)] * often)]).astype(np.int64)
            tokens = running[ends] - running[ends - sizes] + np.array(lot["others"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lot["ids"], pa.int64()), pa.array(lot["n_bytes"], pa.int64()), pa.array(tokens, pa.int64())], names=_names(_COUNTED))


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row, as the tokenizers library counts them without special tokens of its own.

    Truncation and padding of the file are left out; added tokens whose strings stand in a text count as the
    library takes them by default. A null text is empty and has no tokens; null ids and repeated rows are
    kept, every row gives one. An empty table gives an empty one; other columns are not looked at. A text of
    any length is cut as a whole, in memory of a few times its size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shares = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE_BYTES))
    lots = cut(rows.mapInArrow(_lots(tokenizer, shares), _LOTS))
    words = lots.where("share >= 0").select("share", "lot", "first", "words").repartition(shares, "share")
    pieces = words.drop("share").mapInArrow(_counter(tokenizer), "lot long, first int, pieces binary")
    found = pieces.groupBy("lot").agg(F.collect_list(F.struct("first", "pieces")).alias("found"))
    held = lots.where("share = -1").select("lot", "ids", "n_bytes", "others", "counts")
    return held.join(found, "lot", "left").mapInArrow(_sums, _COUNTED)
