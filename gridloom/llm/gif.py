"""Media columns: animated GIF, read and written in batches.

Reading.  A file's blocks are walked by their lengths.  A frame's LZW codes are
decoded a run at a time, a run being the codes between two clear codes: how wide
the k-th code after a clear code is follows from k alone, so all codes of a run are
cut out of the bits at once.  Entry j of the table is the output of code j and the
byte after it, which makes each code a copy of earlier output; copies of copies
are followed by pointer doubling until every byte points at a literal.  Colours
come from the frame's or the file's palette.  Frames are composed on a canvas:
transparent pixels leave it as it is, and after its time a frame stays (disposal 0, 1),
is cleared (2) or gives way to what was there before (3).  Interlaced rows are put in order.
``frames`` stores one row a frame: its times, place, composed pixels and a
histogram of 64 colours (two bits a channel; pixels that nothing was drawn on are not counted).

Writing.  Bytes become samples of a canvas 192 wide, ``ROWS`` rows a frame, by a palette
of 256 different colours, so that reading the colours back loses nothing.
LZW codes are found by a dictionary and packed together.

All of it maps partitions: no shuffle; what is held is a batch, one file and one
canvas, whatever the number of frames.

Defined results: null text is empty, and stored as one row of blanks; very long
texts become more frames, none is cut; repeated rows are stored alike; an empty table
gives an empty result; columns that aren't named are left out of ``stored`` and may have any name.
Null media have no frames.  Media that are broken off or no GIF have the frames before the
fault, and then one row that says what is wrong in ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WIDTH, ROWS, DELAY_MS, BINS = 192, 128, 100, 64
#: Pixels of a canvas or frame beyond which a file counts as broken (its sizes allow 17 GB); the writer's have 24,576.
MOST_PIXELS = 1 << 25
#: Fixed values of the format: most bits of a code, and its tables' size.
BITS, TABLE = 12, 1 << 12
BLANK = b"\x20"

_index = np.arange(256)
#: The writer's palette: three bits of red and green, two of blue.
COLOURS = np.stack([(_index >> 5) * 255 // 7, (_index >> 2 & 7) * 255 // 7, (_index & 3) * 255 // 3], axis=1).astype(np.uint8)


class Broken(ValueError):
    """What is wrong with a file."""


def places(small: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of the k-th code after a clear code, until the table is full."""
    known = (1 << small) + 2 + np.maximum(np.arange(TABLE + 1) - 1, 0)
    width = np.minimum(BITS, np.floor(np.log2(known)).astype(np.int64) + 1)
    return np.concatenate(([0], np.cumsum(width)[:-1])), width


_places = {small: places(small) for small in range(2, 9)}


def codes_at(data: np.ndarray, bits: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The codes at bit offsets. data: with four bytes more than are used."""
    at = bits >> 3
    window = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8 | data[at + 2].astype(np.int64) << 16
    return window >> (bits & 7) & ((1 << width) - 1)


def run_of(data: np.ndarray, base: int, end: int, small: int) -> tuple[np.ndarray, int, int]:
    """The codes from a bit on up to the next clear or end code, that code (or -1 at the end of the data) and the bit after it."""
    offsets, widths = _places[small]
    clear, found, start = 1 << small, [], 0
    size = 1  # a stream begins with a clear code
    while True:
        size = min(size, max(0, end - base) // (small + 1) + 1)
        if start + size <= TABLE:
            bits, width = base + offsets[start : start + size], widths[start : start + size]
        else:
            k = np.arange(start, start + size)
            low = np.minimum(k, TABLE)
            bits, width = base + offsets[low] + BITS * (k - low), widths[low]
        n = size if int(bits[-1]) + int(width[-1]) <= end else int(np.searchsorted(bits + width, end, "right"))
        codes = codes_at(data, bits[:n], width[:n])
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(stops):
            s = int(stops[0])
            return np.concatenate([*found, codes[:s]]), int(codes[s]), int(bits[s] + width[s])
        found.append(codes)
        if n < size:
            return np.concatenate(found), -1, end
        start, size = start + size, TABLE - 1 if not start else 2 * start


def expanded(codes: np.ndarray, small: int) -> np.ndarray:
    """The bytes that a run of codes stands for."""
    n, clear = len(codes), 1 << small
    if not n:
        return np.empty(0, np.uint8)
    literal = codes < clear
    of = np.where(literal, -1, codes - clear - 2)  # the code whose output, and the byte after it, this one copies
    if (of >= np.arange(n)).any():
        raise Broken("a code before its entry")
    length, up = np.ones(n, np.int64), of.copy()
    while (open_ := np.flatnonzero(up >= 0)).size:
        over = up[open_]
        length[open_] += length[over]
        up[open_] = up[over]
    first = np.cumsum(length) - length
    total = int(first[-1] + length[-1])
    source = np.arange(total) + np.repeat(np.where(literal, 0, first[of] - first), length)
    while True:
        next_ = source[source]
        if (next_ == source).all():
            break
        source = next_
    values = np.empty(total, np.uint8)
    values[first[literal]] = codes[literal]
    return values[source]


def lzw_decoded(packed: bytes, small: int, most: int) -> np.ndarray:
    """The samples of a code stream, ``most`` at most."""
    data = np.frombuffer(packed + bytes(4), np.uint8)
    parts, have, at, end = [np.empty(0, np.uint8)], 0, 0, 8 * len(packed)
    while have < most:
        codes, stop, at = run_of(data, at, end, small)
        part = expanded(codes, small)
        parts.append(part)
        have += len(part)
        if stop != 1 << small:
            break
    if have < most:
        raise Broken(f"{have} of {most} samples")
    return np.concatenate(parts)[:most]


def lzw_codes(data: bytes) -> Iterator[list[int]]:
    """The codes of 8-bit samples, in runs that each fill a new table."""
    known, out, new, w = {}, [], 258, -1
    if data:
        w = data[0]
    for b in memoryview(data)[1:]:
        pair = w << 8 | b
        if pair in known:
            w = known[pair]
            continue
        out.append(w)
        w = b
        known[pair] = new
        new += 1
        if new == TABLE - 1:
            yield out
            known, out, new = {}, [], 258
    if w >= 0:
        out.append(w)
    yield out


def lzw_encoded(data: bytes) -> bytes:
    """The code stream of 8-bit samples."""
    widths, bits = _places[8][1], []
    runs = [[], *lzw_codes(data)]
    for k, run in enumerate(runs):
        run.append(256 if k + 1 < len(runs) else 257)
        each = np.array(run, "<u2").view(np.uint8).reshape(-1, 2)
        each = np.unpackbits(each, axis=1, bitorder="little")
        edges = np.searchsorted(widths[: len(run)], [10, 11, 12]).tolist()
        bits += [each[a:b, :width].ravel() for width, a, b in zip((9, 10, 11, 12), [0, *edges], [*edges, len(run)])]
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def blocks(data: bytes) -> bytes:
    """Data as blocks with their lengths."""
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def written(payload: bytes) -> bytes:
    """A GIF of the payload's bytes, a positive multiple of ``WIDTH``."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), COLOURS.tobytes()]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY_MS // 10, 0), b"\0\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", blocks(lzw_encoded(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    #: The composed canvas, (height, width) of red, green, blue and alpha in the bytes of a number, lowest first.
    canvas: np.ndarray


def palette(data: bytes) -> np.ndarray:
    table = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.uint32)
    return table[:, 0] | table[:, 1] << 8 | table[:, 2] << 16 | np.uint32(0xFF000000)


def interlaced(rows: np.ndarray) -> np.ndarray:
    n = len(rows)
    order = np.concatenate([np.arange(a, n, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


class Reader:
    """The frames of one file, in order. A canvas is used again: look at a frame before the next is asked for."""

    def __init__(self, media: bytes):
        self.media, self.at = media, 0

    def take(self, n: int) -> bytes:
        part = self.media[self.at : self.at + n]
        if len(part) < n:
            raise Broken("it ends too early")
        self.at += n
        return part

    def sub_blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)

    def frames(self) -> Iterator[Frame]:
        if self.take(6) not in (b"GIF87a", b"GIF89a"):
            raise Broken("not a GIF")
        wide, high, flags, _, _ = struct.unpack("<HHBBB", self.take(7))
        if wide * high > MOST_PIXELS:
            raise Broken("too many pixels")
        shared = palette(self.take(3 << (flags & 7) + 1)) if flags & 0x80 else None
        canvas, now = np.zeros((high, wide), np.uint32), 0
        delay, disposal, transparent = 0, 0, None
        while (kind := self.take(1)) != b"\x3b":
            if kind == b"\x21":
                if self.take(1) == b"\xf9":
                    control = self.sub_blocks()
                    if len(control) < 4:
                        raise Broken("a short control block")
                    own, hundredths, index = struct.unpack("<BHB", control[:4])
                    delay, disposal, transparent = 10 * hundredths, own >> 2 & 7, index if own & 1 else None
                else:
                    self.sub_blocks()
                continue
            if kind != b"\x2c":
                raise Broken(f"an unknown block {kind[0]}")
            left, top, width, height, flags = struct.unpack("<HHHHB", self.take(9))
            if width * height > MOST_PIXELS:
                raise Broken("too many pixels")
            colours = palette(self.take(3 << (flags & 7) + 1)) if flags & 0x80 else shared
            if colours is None:
                raise Broken("no palette")
            small = self.take(1)[0]
            if not 2 <= small <= 8:
                raise Broken(f"codes of {small} bits")
            samples = lzw_decoded(self.sub_blocks(), small, width * height).reshape(height, width)
            samples = interlaced(samples) if flags & 0x40 else samples
            if samples.size and int(samples.max()) >= len(colours):
                raise Broken("a sample beyond the palette")
            before = canvas.copy() if disposal == 3 else None
            spot = canvas[top : top + height, left : left + width]  # what lies beside the canvas isn't seen
            seen = samples[: spot.shape[0], : spot.shape[1]]
            spot[...] = colours[seen] if transparent is None else np.where(seen == transparent, spot, colours[seen])
            yield Frame(now, delay, left, top, width, height, disposal, canvas)
            now += delay
            if disposal == 2:
                spot[...] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, transparent = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by colour bin: the two highest bits of red, green and blue."""
    drawn = canvas[canvas >> 24 != 0]
    bins = (drawn >> 2 & 0x30) | (drawn >> 12 & 0x0C) | (drawn >> 22 & 0x03)
    return np.bincount(bins, minlength=BINS)


def samples(frame: Frame) -> np.ndarray:
    """What the writer stored: the palette's number of each colour in the frame's rectangle."""
    drawn = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width]
    level = lambda shift, most: ((drawn >> shift & 255) * most + 254) // 255  # noqa: E731  colours are rounded down
    return (level(0, 7) << 5 | level(8, 7) << 2 | level(16, 3)).astype(np.uint8)


def padded(text: bytes) -> bytes:
    return text + BLANK * (-len(text) % WIDTH if text else WIDTH)


def read_back(media: bytes) -> tuple[bytes, np.ndarray]:
    """The payload that ``written`` stored, and the histogram over all frames."""
    parts, seen = [], np.zeros(BINS, np.int64)
    for frame in Reader(media).frames():
        parts.append(samples(frame).tobytes())
        seen += histogram(frame.canvas)
    return b"".join(parts), seen


def stored(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes and media, the GIF of its text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            columns = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([written(padded(t)) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


FRAME = "frame long, start_ms long, delay_ms long, `left` int, top int, width int, height int, disposal int, canvas_width int, canvas_height int, pixels binary, histogram array<long>, error string"


def frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Per frame: the key, number, times, place, composed pixels (four bytes each: red, green, blue, alpha) and histogram; or what is wrong."""
    bounded_batches(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()
    form = f"`{key}` {kind}, {FRAME}"

    def of(item: object, data: bytes) -> Iterator[tuple]:
        try:
            for k, f in enumerate(Reader(data).frames()):
                high, wide = f.canvas.shape
                yield item, k, f.start_ms, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, wide, high, f.canvas.astype("<u4").tobytes(), histogram(f.canvas).tolist(), None
        except Broken as wrong:
            yield item, *[None] * 12, str(wrong)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_key = batch.schema.field(0)
            types = [of_key.type, *[pa.int64()] * 3, *[pa.int32()] * 7, pa.binary(), pa.list_(pa.int64()), pa.string()]
            names = [key, "frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "canvas_width", "canvas_height", "pixels", "histogram", "error"]
            some, size = [], 0
            out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in of(item, data) if data is not None else ():
                    some.append(row)
                    size += len(row[11] or b"")
                    if size > 1 << 24:
                        yield out(some)
                        some, size = [], 0
            if some:
                yield out(some)

    return media.select(key, column).mapInArrow(run, form)


def media_digests(media: DataFrame) -> DataFrame:
    """Of what ``stored`` made, read back: sizes and digests of payload and media, and the colours of all frames as ``feature``."""
    bounded_batches(media.sparkSession)
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2):
                gif = data.as_py()
                payload, seen = read_back(gif)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), ",".join(map(str, seen.tolist()))))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    form = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, form)
