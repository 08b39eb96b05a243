"""Token-id files: flat unsigned integers, 64-bit offsets, and a manifest with the base of each part.

A part holds the documents of one range of ids, in order, in three flat little-endian files:
``.bin`` token ids (unsigned, 16 bits if the vocabulary allows, else 32), ``.idx`` unsigned 64-bit
offsets of the documents' first ids and of the end, ``.doc`` signed 64-bit document ids (the least
value stands for null). ``manifest.json`` lists the parts in order with their bases, the prefix sums of
their lengths, so that any document's place in the whole sequence is base + offset.
"""

from __future__ import annotations

import gc
import json
import mmap
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

NULL_ID = -(2**63)
_PART = "part int, stem string, docs long, tokens long"
#: Text of one part of the files, and ids read at once from them.
PART_BYTES, READ_IDS = 256 << 20, 4_000_000


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _local(path: str) -> str | None:
    """The path for the operating system if the file system is a mounted one."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if path.startswith("/") else None


def _by_words(settings: dict) -> bool:
    """Whether a tokenizer cuts before words as byte-level ones do, and changes nothing before or after that."""
    cuts = settings.get("pre_tokenizer") or {}
    plain = not any(settings.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
    level = cuts.get("type") == "ByteLevel" and not cuts.get("add_prefix_space") and cuts.get("use_regex", True)
    added = settings.get("added_tokens") or []
    return plain and level and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added)


class _Encoder:
    """Encodes texts by the tokenizers library, each distinct word once.

    The byte-level pattern always cuts before a single space, and around a single line break, between two
    non-space characters. So a text is encoded word by word (its space with the word), and a worker
    remembers the ids of words it has met (emptied at two million). A text with other white space beside
    a space or line break, or at its ends, is encoded whole, and so is every text where the tokenizer's
    own settings (see ``_by_words``) don't promise those cuts.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.line = self._whole("\n")
        self.by_words = _by_words(json.loads(self.tokenizer.to_str()))
        #: Word to ids as bytes, or None where the word shows that its text must be encoded whole.
        self.spaced: dict[str, bytes | None] = {}
        self.plain: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, cache: dict[str, bytes | None], words: set[str], prefix: str) -> None:
        """Encodes many new words in one call, parted by line breaks, which are tokens of their own there."""
        if len(cache) + len(words) > 2_000_000:
            cache.clear()
        words = list(words.difference(cache))
        for word in [w for w in words if not w or w[0].isspace() or w[-1].isspace()]:
            cache[word] = None
            words.remove(word)
        line = int(np.frombuffer(self.line, self.dtype)[0])
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            text = prefix + f"\n{prefix}".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(ids == line)
            if len(cuts) != len(some) - 1:  # a word with the break's id in it
                cache.update((w, self._whole(prefix + w)) for w in some)
                continue
            starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            raw, size = ids.tobytes(), self.dtype.itemsize
            cache.update((w, raw[a * size : b * size]) for w, a, b in zip(some, starts, ends, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text with the end id, as bytes of the file's type."""
        gc.disable()  # many short-lived lists, no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return [self._whole(text or "") + self.end for text in texts]
        split = [[line.split(" ") for line in (text or "").split("\n")] for text in texts]
        self._learn(self.plain, {words[0] for lines in split for words in lines}, "")
        later: set[str] = set()
        for lines in split:
            later.update(*[words[1:] for words in lines])
        self._learn(self.spaced, later, " ")
        plain, spaced, out = self.plain, self.spaced.__getitem__, []
        for text, lines in zip(texts, split, strict=True):
            try:
                out.append(self.line.join([plain[w[0]] + b"".join(map(spaced, w[1:])) for w in lines]) + self.end)
            except TypeError:  # a None among the words
                out.append(self._whole(text or "") + self.end)
        return out


_ENCODERS: dict[tuple[str, int], _Encoder] = {}


def _encoder(path: str, end_id: int) -> _Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = _Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _writer(folder: str, tokenizer: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = _encoder(tokenizer, end_id), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        files, at = _open_fs(folder)
        stem = f"part-{part:06d}-{attempt}"  # a lost attempt leaves files that no manifest names
        docs = tokens = 0
        with (
            files.open_output_stream(f"{at}/{stem}.bin") as ids_to,
            files.open_output_stream(f"{at}/{stem}.idx") as offsets_to,
            files.open_output_stream(f"{at}/{stem}.doc") as docs_to,
        ):
            for batch in slices(batches, "_text", 4_000_000):
                coded = encoder.encode(batch.column("_text").to_pylist())
                ends = np.cumsum([len(x) for x in coded]) // encoder.dtype.itemsize
                offsets_to.write((tokens + np.concatenate([[0], ends[:-1]])).astype("<u8").tobytes())
                docs_to.write(
                    pa.compute.fill_null(batch.column("_id"), NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                )
                ids_to.write(b"".join(coded))
                docs, tokens = docs + len(coded), tokens + int(ends[-1])
            offsets_to.write(np.array([tokens], "<u8").tobytes())
        if docs:
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "stem": [stem], "docs": pa.array([docs], pa.int64()), "tokens": pa.array([tokens], pa.int64())}
            )

    return run


def parts_of(docs: DataFrame, text_col: str = "text") -> int:
    """How many parts the files of these texts need: PART_BYTES of text in each, and no fewer than shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None, id_col: str = "doc_id",
    text_col: str = "text",
) -> dict:
    """Encodes every text and writes the files in ascending order of ids; returns the manifest.

    ``folder`` must be one that driver and executors share. A null text is empty, a null id comes first;
    rows of one id are in the order of their texts' hashes, so that they may lie in several parts and
    reruns agree (repeated rows are alike). An empty table gives a manifest without parts. Other columns
    are not looked at. The driver gets one row per part. A text is encoded as a whole or, if long, word by
    word with its words in a list: about 100 bytes of memory for each word.
    """
    from tokenizers import Tokenizer

    files, at = _open_fs(folder)
    files.create_dir(at, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    order = (F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    parts = parts_of(docs, text_col) if parts is None else parts
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = sorted(rows.mapInArrow(_writer(folder, tokenizer, end_id), _PART).collect())
    bases = np.concatenate([[0], np.cumsum([r["tokens"] for r in found], dtype=np.uint64)]).astype(np.uint64)
    small = Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16
    manifest = {
        "version": 1, "dtype": "uint16" if small else "uint32", "end_id": end_id, "tokens": int(bases[-1]),
        "docs": sum(r["docs"] for r in found),
        "parts": [{**r.asDict(), "base": int(b)} for r, b in zip(found, bases, strict=False)],
    }
    with files.open_output_stream(f"{at}/manifest.json") as to:
        to.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    files, at = _open_fs(folder)
    with files.open_input_stream(f"{at}/manifest.json") as f:
        return json.loads(f.read())


class _Flat:
    """A file of numbers: memory-mapped where it is on a mounted file system, else read by ranges."""

    def __init__(self, folder: str, name: str, dtype: str):
        path, self.dtype = _local(f"{folder}/{name}"), np.dtype(dtype)
        self.map = self.file = None
        if path is None:
            files, at = _open_fs(folder)
            self.file = files.open_input_file(f"{at}/{name}")
            self.size = self.file.size() // self.dtype.itemsize
        else:
            self.size = os.path.getsize(path) // self.dtype.itemsize
            if self.size:
                with open(path, "rb") as f:
                    self.map = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), self.dtype)

    def __getitem__(self, span: slice) -> np.ndarray:
        a, b, _ = span.indices(self.size)
        if b <= a:
            return np.empty(0, self.dtype)
        if self.map is not None:
            return self.map[a:b]
        return np.frombuffer(self.file.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


def _reader(folder: str, dtype: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids, offsets, names = (
                    _Flat(folder, f"{part['stem']}.{end}", kind) for end, kind in (("bin", dtype), ("idx", "<u8"), ("doc", "<i8"))
                )
                at = 0
                while at < names.size:  # up to 5,000 documents of READ_IDS ids in all, or one longer document
                    bounds = offsets[at : at + 5001].astype(np.int64)
                    n = max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, side="right")) - 1)
                    some, bounds = names[at : at + n], bounds[: n + 1]
                    held = ids[int(bounds[0]) : int(bounds[-1])]
                    inside = (bounds - bounds[0]).tolist()
                    crcs = [zlib.crc32(held[x:y].astype("<u4").tobytes()) for x, y in zip(inside[:-1], inside[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, pa.int64(), mask=some == NULL_ID),
                            pa.array(bounds[:-1] + part["base"], pa.int64()),
                            pa.array(np.diff(bounds), pa.int64()),
                            pa.array(crcs, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at += n

    return run


def read_digests(spark: SparkSession, folder: str, manifest: dict | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    manifest = manifest or read_manifest(folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)
    parts = spark.createDataFrame([(p["part"], p["stem"], p["base"]) for p in manifest["parts"]], "part int, stem string, base long")
    dtype = "<u2" if manifest["dtype"] == "uint16" else "<u4"
    return parts.repartition(len(manifest["parts"])).mapInArrow(_reader(folder, dtype), schema)


def document_tokens(folder: str, doc: int, manifest: dict | None = None) -> np.ndarray:
    """The ids of the doc-th document of the whole sequence, without reading the rest."""
    manifest = manifest or read_manifest(folder)
    for part in manifest["parts"]:
        if doc < part["docs"]:
            first, end = _Flat(folder, f"{part['stem']}.idx", "<u8")[doc : doc + 2].tolist()
            return _Flat(folder, f"{part['stem']}.bin", "<u2" if manifest["dtype"] == "uint16" else "<u4")[first:end]
        doc -= part["docs"]
    raise IndexError("no such document")
