"""Baseline JPEG: marker parsing, Huffman decoding of scans, and DC-only luminance thumbnails.

The decoder runs many entropy-coded segments (whole scans, or the parts between restart markers) in
step: each numpy operation decodes one Huffman symbol of every segment. Only the luminance DC values are
kept; a block's mean is its DC value times its quantiser, divided by 8, plus 128, which is one pixel of
the thumbnail. AC symbols are decoded to find the next block and dropped.

Bytes are stored losslessly as an image whose format's unit, the quantised DC value of a block, holds one
byte: with a DC quantiser of 8 a block of DC value b - 128 is flat with the luminance b. So the
thumbnail of the stored image is the stored bytes. An image is 72 blocks wide with a restart marker after
each row of blocks; more than 8184 rows (a frame is at most 65,535 lines high) go on in further images.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

UNIT, ACROSS, MOST_ROWS = 576, 72, 8184
_BLOCK = 2_000_000

# The code lengths of the standard's luminance DC table; categories 0 to 11 follow in order.
_DC_BITS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])


def _codes(bits: bytes) -> list[tuple[int, int]]:
    """(code, length) of the canonical Huffman code, in the order of the symbols."""
    out, code = [], 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of a whole block, for each DC difference from -255 to 255: the difference, then end of block."""
    codes, bits, lengths = _codes(_DC_BITS), [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        extra = d if d > 0 else d + (1 << size) - 1
        bits.append(((code << size) | extra) << 1)  # the only AC code is a single 0
        lengths.append(n + size + 1)
    return np.array(bits, np.uint64), np.array(lengths, np.int64)


_BITS, _LENGTHS = _symbol_table()


def _head(rows: int) -> bytes:
    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    return b"".join(
        [
            b"\xff\xd8",
            segment(0xDB, b"\x00" + bytes([8] + [1] * 63)),
            segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * ACROSS, 1, 1, 0x11, 0)),
            segment(0xC4, b"\x00" + _DC_BITS + bytes(range(12))),
            segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00"),
            segment(0xDD, struct.pack(">H", ACROSS)),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Stores each payload (a positive multiple of 576 bytes) as one or more JPEG images, one after the other."""
    frames = []  # (payload, rows)
    for i, p in enumerate(payloads):
        rows = len(p) // ACROSS
        frames += [(i, min(MOST_ROWS, rows - at)) for at in range(0, rows, MOST_ROWS)]
    values = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ACROSS).astype(np.int64) - 128
    total = len(values)
    step = values.copy()
    step[:, 1:] -= values[:, :-1]
    step += 255
    held, n = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    words, at = np.zeros((total, 36), np.uint32), np.zeros(total, np.int64)
    for j in range(ACROSS):
        d = step[:, j]
        size = _LENGTHS[d]
        held = (held << size.astype(np.uint64)) | _BITS[d]
        n += size
        full = np.flatnonzero(n >= 32)
        n[full] -= 32
        words[full, at[full]] = (held[full] >> n[full].astype(np.uint64)).astype(np.uint32)
        at[full] += 1
    pad = (32 - n).astype(np.uint64)
    words[np.arange(total), at] = ((held << pad) | ((np.uint64(1) << pad) - np.uint64(1))).astype(np.uint32)
    lengths = at * 4 + (n + 7) // 8
    raw = np.full((total, 146), 0, np.uint8)
    raw[:, :144] = words.astype(">u4").view(np.uint8).reshape(total, 144)
    place = np.arange(146)
    row_of = np.concatenate([np.arange(rows) for _, rows in frames])
    raw[np.arange(total), lengths] = 0xFF
    raw[np.arange(total), lengths + 1] = 0xD0 + row_of % 8
    inside = place < lengths[:, None]
    used = place < (lengths + 2)[:, None]
    stuffed = (raw == 0xFF) & inside
    copies = (1 + stuffed)[used]
    flat = np.repeat(raw[used], copies)
    ends = np.cumsum(copies)
    flat[ends[stuffed[used]] - 1] = 0
    row_ends = np.cumsum((used.sum(axis=1) + stuffed.sum(axis=1)))
    out: list[list[bytes]] = [[] for _ in payloads]
    data, first = flat.tobytes(), 0
    for i, rows in frames:
        start, end = (int(row_ends[first - 1]) if first else 0), int(row_ends[first + rows - 1])
        out[i] += [_head(rows), data[start : end - 2], b"\xff\xd9"]  # no marker after the last row
        first += rows
    return [b"".join(x) for x in out]


@dataclass
class Frame:
    """One parsed image; ``status`` is ok, or says why it has no thumbnail."""

    status: str = "corrupt"
    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    segments: list[np.ndarray] = field(default_factory=list)
    interval: int = 0
    layout: list[tuple[int, bytes, bytes]] = field(default_factory=list)  # is luminance, DC and AC tables
    quantiser: int = 1
    across: int = 0
    mcus: int = 0
    thumb: np.ndarray | None = None


def _next_marker(data: np.ndarray, at: int, step: int = 1 << 20) -> int:
    """Where the first marker but restarts and stuffing is; the data's length without one. Looks no further than a step beyond it."""
    while at + 1 < len(data):
        part = data[at : at + step + 1]
        ff = np.flatnonzero(part[:-1] == 0xFF)
        after = part[ff + 1]
        found = ff[(after != 0) & ((after & 0xF8) != 0xD0) & (after != 0xFF)]
        if len(found):
            return at + int(found[0])
        at += step
    return len(data)


def _scan_end(data: np.ndarray, at: int) -> tuple[list[np.ndarray], int]:
    """The unstuffed segments of the entropy-coded data from ``at``, and where the next marker is."""
    end = _next_marker(data, at) - at
    body = data[at : at + end]
    ff = np.flatnonzero(body[:-1] == 0xFF)
    after = body[ff + 1]
    restart = (after & 0xF8) == 0xD0
    keep = np.ones(end, bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[restart]
    keep[marks] = False
    keep[np.minimum(marks + 1, end - 1)] = False
    clean = body[:end][keep]
    kept_before = np.cumsum(keep)
    cuts = kept_before[marks].tolist()
    return [clean[a:b] for a, b in zip([0, *cuts], [*cuts, len(clean)], strict=True)], at + end


def parse_frames(data: bytes) -> list[Frame]:
    """Parses the markers of all images in ``data``. Progressive, arithmetic and 12-bit images are told apart, not decoded."""
    view, at, frames = np.frombuffer(data, np.uint8), 0, []
    frame = None
    quantisers: dict[int, int] = {}
    huffman: dict[int, bytes] = {}
    while at + 1 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xFF, 0x00) or 0xD0 <= marker <= 0xD7 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD8:
            frame, quantisers, huffman = Frame(), {}, {}
            frames.append(frame)
            at += 2
            continue
        if marker == 0xD9 or frame is None or at + 4 > len(data):
            at += 2
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        try:
            if marker == 0xDB:
                p = 0
                while p < len(body):
                    wide = body[p] >> 4
                    quantisers[body[p] & 15] = struct.unpack_from(">H", body, p + 1)[0] if wide else body[p + 1]
                    p += 129 if wide else 65
            elif marker == 0xC4:
                p = 0
                while p < len(body):
                    n = sum(body[p + 1 : p + 17])
                    huffman[body[p]] = body[p + 1 : p + 17 + n]
                    p += 17 + n
            elif marker == 0xDD:
                frame.interval = struct.unpack(">H", body[:2])[0]
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                frame.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                frame.status = "corrupt" if marker == 0xC0 and bits == 8 and n and frame.width and frame.height else "not baseline"
            elif marker == 0xDA:
                segments, end = _scan_end(view, at + 2 + length)
                if frame.status == "corrupt" and frame.parts and not frame.segments:
                    n = body[0]
                    scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
                    if scan[0][0] == frame.parts[0][0]:
                        _lay_out(frame, scan, quantisers, huffman)
                        frame.segments, frame.status = segments, "ok"
                at = end
                continue
        except (IndexError, KeyError, struct.error):
            frame.status = "corrupt"
        at += 2 + length
    return frames


def _lay_out(frame: Frame, scan: list, quantisers: dict[int, int], huffman: dict[int, bytes]) -> None:
    """Tables of the blocks of one MCU, in order, and the number of MCUs."""
    parts = {p[0]: p for p in frame.parts}
    most_h, most_v = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
    frame.quantiser = quantisers[frame.parts[0][3]]
    _, h, v, _ = frame.parts[0]
    if len(scan) == 1:
        across, down = -(-frame.width * h // (8 * most_h)), -(-frame.height * v // (8 * most_v))
        tables = scan[0][1]
        frame.layout = [(1, huffman[tables >> 4], huffman[16 + (tables & 15)])]
        frame.parts[0] = (frame.parts[0][0], 1, 1, frame.parts[0][3])
    else:
        across, down = -(-frame.width // (8 * most_h)), -(-frame.height // (8 * most_v))
        for i, (name, tables) in enumerate(scan):
            blocks = parts[name][1] * parts[name][2]
            frame.layout += [(int(i == 0), huffman[tables >> 4], huffman[16 + (tables & 15)])] * blocks
    frame.across, frame.mcus = across, across * down


_TABLES: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """length << 8 | symbol for each 16 bits that may follow; length 0: no code."""
    if table not in _TABLES:
        if len(_TABLES) > 256:
            _TABLES.clear()
        out = np.zeros(1 << 16, np.uint16)
        for (code, length), symbol in zip(_codes(table[:16]), table[16:], strict=False):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
        _TABLES[table] = out
    return _TABLES[table]


def decode_thumbnails(frames: list[Frame]) -> None:
    """Sets the thumbnail of each frame whose status is ok; a scan that can't be decoded makes it corrupt."""
    good = [f for f in frames if f.status == "ok"]
    tables: dict[bytes, int] = {}
    shapes: dict[tuple, int] = {}
    lanes, buffers, dest = [], [], []
    byte_at = block_at = 0
    for f in good:
        shape = shapes.setdefault(tuple(f.layout), len(shapes))
        per = sum(x[0] for x in f.layout)
        interval, mcu = f.interval or f.mcus, 0
        dest.append((block_at, per))
        for s in f.segments:
            n = min(interval, f.mcus - mcu)
            if n <= 0:
                break
            lanes.append((byte_at * 8, (byte_at + len(s)) * 8, n, shape, block_at + mcu * per))
            buffers.append(s)
            byte_at += len(s)
            mcu += n
        if mcu < f.mcus:
            f.status = "corrupt"
        block_at += f.mcus * per
    if not lanes:
        return
    data = np.concatenate([*buffers, np.zeros(16, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(data) - 8, np.uint64)
    for j in range(8):
        window |= data[j : j + len(window)] << np.uint64(56 - 8 * j)
    longest = max(map(len, shapes))
    layout = np.zeros((len(shapes), longest, 3), np.int64)
    blocks_in = np.array([len(s) for s in shapes])
    for shape, i in shapes.items():
        for j, (luma, dc, ac) in enumerate(shape):
            layout[i, j] = luma, tables.setdefault(dc, len(tables)), tables.setdefault(ac, len(tables))
    # the predictor of a block is its component's; components are told apart by their run of blocks
    part_of = np.zeros((len(shapes), longest), np.int64)
    for shape, i in shapes.items():
        part_of[i, : len(shape)] = np.cumsum([0, *(a != b for a, b in zip(shape, shape[1:], strict=False))])
    look = np.concatenate([_lookup(t) for t in tables])

    pos, end, left, shape, out_at = (np.array(x, np.int64) for x in zip(*lanes, strict=True))
    block, k = np.zeros_like(pos), np.zeros_like(pos)
    before = np.zeros((len(pos), int(part_of.max()) + 1), np.int64)
    dcs = np.zeros(block_at, np.int64)
    broken: list[int] = []
    who = np.arange(len(pos))
    one = np.uint64(1)
    while len(pos):
        w = window[np.minimum(pos >> 3, len(window) - 1)] << (pos & 7).astype(np.uint64)
        is_dc = k == 0
        table = np.where(is_dc, layout[shape, block, 1], layout[shape, block, 2])
        e = look[(table << 16) + (w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, symbol = e >> 8, e & 255
        size = np.where(is_dc, symbol & 31, symbol & 15)
        pos += length + size
        dc = np.flatnonzero(is_dc)
        if len(dc):
            n = size[dc]
            extra = ((w[dc] << length[dc].astype(np.uint64)) >> one >> (63 - n).astype(np.uint64)).astype(np.int64)
            diff = np.where((n > 0) & (extra < (1 << np.maximum(n - 1, 0))), extra - (1 << n) + 1, extra)
            part = part_of[shape[dc], block[dc]]
            before[dc, part] += diff
            luma = layout[shape[dc], block[dc], 0] == 1
            at = dc[luma]
            dcs[out_at[at]] = before[at, part[luma]]
            out_at[at] += 1
        k += np.where(is_dc, 1, (symbol >> 4) + 1)
        ended = ((symbol == 0) & ~is_dc) | (k > 63)
        k[ended] = 0
        block += ended
        whole = block == blocks_in[shape]
        block[whole] = 0
        left -= whole
        bad = (length == 0) | (pos > end)
        done = (left == 0) | bad
        if done.any():
            broken += who[bad].tolist()
            go = ~done
            pos, end, left, shape, out_at = pos[go], end[go], left[go], shape[go], out_at[go]
            block, k, before, who = block[go], k[go], before[go], who[go]
    starts = np.array([d[0] for d in dest])
    for lane in broken:
        good[int(np.searchsorted(starts, lanes[lane][4], side="right")) - 1].status = "corrupt"
    for f, (first, per) in zip(good, dest, strict=True):
        if f.status == "ok":
            _, h, v, _ = f.parts[0]
            grid = dcs[first : first + f.mcus * per].reshape(-1, f.across, v, h).transpose(0, 2, 1, 3)
            grid = grid.reshape(-1, f.across * h)
            most_h, most_v = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
            wide, high = -(-f.width * h // (8 * most_h)), -(-f.height * v // (8 * most_v))
            f.thumb = np.clip((grid[:high, :wide] * f.quantiser + 4) // 8 + 128, 0, 255).astype(np.uint8)


class _Areas:
    """Sums of a grid's 8 x 8 areas, from blocks of its rows one after the other."""

    def __init__(self, high: int, wide: int):
        self.down, self.across = np.arange(8) * high // 8, np.arange(8) * wide // 8
        self.sizes = np.outer(self._sizes(self.down, high), self._sizes(self.across, wide))
        self.sums, self.at = np.zeros((8, 8), np.int64), 0

    @staticmethod
    def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
        return np.maximum(np.diff(np.append(starts, n)), 1)

    def add(self, rows: np.ndarray) -> None:
        by_row = np.add.reduceat(rows.astype(np.int64), self.across, axis=1)
        place = np.arange(self.at, self.at + len(rows))
        first = np.maximum(np.diff(np.append(self.down, np.inf)), 1)  # an area of a low grid may be empty: it shares its first row
        for k in range(8):
            inside = (place >= self.down[k]) & (place < self.down[k] + first[k])
            self.sums[k] += by_row[inside].sum(axis=0)
        self.at += len(rows)

    def hash(self) -> str:
        """64 bits as hex: which areas are lighter than their mean."""
        means = self.sums / self.sizes
        return np.packbits(means > means.mean()).tobytes().hex()


def average_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: which of 8 x 8 areas of the thumbnail are lighter than their mean."""
    areas = _Areas(*thumb.shape)
    areas.add(thumb)
    return areas.hash()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 and its number of bytes, with bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


_FIELDS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def _fields(thumbs: list[np.ndarray], media: bytes) -> tuple:
    """_FIELDS of one stored payload."""
    thumb = np.concatenate(thumbs)
    payload = thumb.tobytes()
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media),
        hashlib.sha256(media).hexdigest(), f"{8 * ACROSS}x{8 * len(thumb)}x{len(thumbs)}-{average_hash(thumb)}",
    )


def _long_fields(payload: bytes, images: int = 3) -> tuple:
    """As ``_fields``, stored and read back a few images at a time, so that memory does not grow with the payload."""
    areas, whole, stored = _Areas(len(payload) // ACROSS, ACROSS), hashlib.sha256(), hashlib.sha256()
    n = size = frames_in = 0
    tail = b""
    for at in range(0, len(payload), images * MOST_ROWS * ACROSS):
        (media,) = encode_payloads([payload[at : at + images * MOST_ROWS * ACROSS]])
        frames = parse_frames(media)
        decode_thumbnails(frames)
        thumb = np.concatenate([f.thumb for f in frames])
        back = thumb.tobytes()
        areas.add(thumb)
        whole.update(back)
        stored.update(media)
        n, size, frames_in, tail = n + len(back), size + len(media), frames_in + len(frames), (tail + back)[-32:]
    return n, whole.hexdigest(), zlib.crc32(tail), size, stored.hexdigest(), f"{8 * ACROSS}x{8 * (n // ACROSS)}x{frames_in}-{areas.hash()}"


def _all_fields(payloads: list[bytes]) -> list[tuple]:
    """_FIELDS of payloads that are stored and read back together."""
    media = encode_payloads(payloads)
    per = [parse_frames(m) for m in media]
    decode_thumbnails([f for frames in per for f in frames])
    return [_fields([f.thumb for f in frames], m) for m, frames in zip(media, per, strict=True)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text", _BLOCK):
        sizes: list[int] = []
        rows: list[tuple] = []
        some: list[bytes] = []
        held = 0
        for text in batch.column("_text").to_pylist():
            size, payload = payload_of(text)
            sizes.append(size)
            if some and held + len(payload) > _BLOCK:  # short texts are padded, so blocks are cut again by payload
                rows += _all_fields(some)
                some, held = [], 0
            if len(payload) > _BLOCK:
                rows.append(_long_fields(payload))
            else:
                some.append(payload)
                held += len(payload)
        if some:
            rows += _all_fields(some)
        columns = [pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for v in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), *columns], names=["_id", "n_bytes", *_FIELDS])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as JPEG, decodes the stored bytes, and gives digests of both and the thumbnail's feature.

    A null text is an empty one, of 576 bytes 255. Equal texts have equal values. Repeated rows each get a
    row, a null id too; an empty table gives none. Other columns are not looked at. A text longer than
    _BLOCK is stored and read back three images at a time: beside some 150 MB a task needs about six
    bytes for each byte of its longest text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = (
        "_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string"
    )
    return rows.mapInArrow(_digest, schema).withColumnRenamed("_id", id_col)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_data", _BLOCK):
        per = [parse_frames(d)[:1] if d else [] for d in batch.column("_data").to_pylist()]
        decode_thumbnails([f for frames in per for f in frames])
        found = [
            (f[0].status, f[0].width, f[0].height, len(f[0].parts), f[0].thumb) if f else ("no image", None, None, None, None)
            for f in per
        ]
        thumbs = [x[4] for x in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.int32()),
                pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.int32()),
                pa.array([None if t is None else t.shape[1] for t in thumbs], pa.int32()),
                pa.array([None if t is None else t.shape[0] for t in thumbs], pa.int32()),
                pa.array([None if t is None else t.tobytes() for t in thumbs], pa.binary()),
                pa.array([None if t is None else average_hash(t) for t in thumbs], pa.string()),
            ],
            names=["_id", "status", "width", "height", "n_parts", "thumb_width", "thumb_height", "thumb", "thumb_hash"],
        )


def jpeg_media(rows: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per row with JPEG bytes: id_col, status, dimensions, the luminance thumbnail and its hash.

    status: ok; not baseline; corrupt; no image (null, empty, or no start of an image). Only the first image of a value counts.
    """
    schema = (
        "_id long, status string, width int, height int, n_parts int, thumb_width int, thumb_height int, thumb binary, "
        "thumb_hash string"
    )
    picked = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(data_col).alias("_data"))
    return picked.mapInArrow(_describe, schema).withColumnRenamed("_id", id_col)
