r"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on whole batches of texts as one array of code points.
A table maps code points to classes (letter, number, space, other white space,
apostrophe, other).  Most boundaries follow from a class and its neighbours;
whether an apostrophe opens a piece (and with it a contraction) depends on what
the automaton did before.  There each code point is a transition function on
states, functions compose associatively, and a prefix scan by doubling yields
the state at every apostrophe.  Code points other than apostrophes reset the
state (their functions are constant), so the scan runs over runs of apostrophes
with the code point before each run, and ends as soon as all are constant.

The pieces are byte slices of the batch's UTF-8 buffer.  A cache of at most
``CACHE`` pieces maps each to its packed ids; a miss merges pairs by rank, with
a heap for long pieces (n log n).  Tokens' byte offsets are retained, and decoding
lays each token's bytes at its offset, for a whole text at once.

The pieces are those of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+

The operator maps partitions: no shuffle, memory bounded by one batch, one long
text and the cache.  The vocabulary (a file named by the caller) is read on the
driver and broadcast; its size is that of the file, about 1 MB.

Defined results: null or empty text has no tokens; bytes that are no UTF-8 are
pieces' bytes like others and come back; very long texts are taken whole; repeated rows are encoded
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

CACHE, CHUNK = 300_000, 1 << 21
OTHER, LETTER, NUMBER, BLANK, WHITE, APOSTROPHE = range(6)
#: The code points of Unicode's White_Space but for the space.
WHITES = [*range(0x9, 0xE), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Ranges of letters and numbers that are newer than Python's Unicode table.
LATER = {
    LETTER: "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0",
    NUMBER: "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}
#: What may follow an apostrophe that opens a piece.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: States after a code point: OPEN (start of a text, or white space that can't be attached), after each class, and OPENED: at an apostrophe that opens a piece.
OPEN, IN_LETTER, IN_NUMBER, IN_BLANK, IN_OTHER, OPENED = range(6)
TRANSITIONS = np.array(
    [
        [IN_OTHER] * 6,
        [IN_LETTER] * 6,
        [IN_NUMBER] * 6,
        [IN_BLANK] * 6,
        [OPEN] * 6,
        [OPENED, OPENED, OPENED, IN_OTHER, IN_OTHER, IN_OTHER],
    ],
    np.uint8,
)


@functools.cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for kind, ranges in LATER.items():
        for a, b in (r.split("-") for r in ranges.split()):
            table[int(a, 16) : int(b, 16) + 1] = kind
    table[WHITES], table[ord(" ")], table[ord("'")] = WHITE, BLANK, APOSTROPHE
    return table


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of transition functions (rows), by doubling; ends early once every row is constant."""
    functions, step = functions.copy(), 1
    while step < len(functions) and (functions != functions[:, :1]).any():
        later = functions[step:]
        functions[step:] = np.take_along_axis(later, functions[:-step], axis=1)
        step *= 2
    return functions


def opened(cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the apostrophes that open a piece. first: whether a text starts at the code point."""
    marks = np.flatnonzero(cls == APOSTROPHE)
    if not len(marks):
        return marks
    # before each run of apostrophes stands what precedes it: a code point's constant function, or the start of a text
    starts = np.ones(len(marks), bool)
    starts[1:] = (np.diff(marks) > 1) | first[marks[1:]]
    slots = np.arange(len(marks)) + np.cumsum(starts)
    rows = np.empty((len(marks) + int(starts.sum()), 6), np.uint8)
    rows[slots] = TRANSITIONS[APOSTROPHE]
    heads = marks[starts]
    before = TRANSITIONS[cls[np.maximum(heads - 1, 0)]]
    before[first[heads]] = OPEN
    rows[slots[starts] - 1] = before
    # an apostrophe before the run belongs to another text only, where `first` has reset the state
    return marks[scan(rows)[slots, OPEN] == OPENED]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point."""
    cls = classes()[points]
    n = len(cls)
    kind = cls.copy()
    kind[kind == APOSTROPHE] = OTHER
    white = (kind == BLANK) | (kind == WHITE)
    ends = np.ones(n, bool)  # the text ends after the code point
    ends[:-1] = first[1:]
    start = first.copy()
    was_white, was_blank = white[:-1], kind[:-1] == BLANK
    now = white[1:]
    last = np.zeros(n, bool)  # the last of a run of white space that another kind follows
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start[1:] |= np.where(now, ~was_white | last[1:], np.where(was_white, ~was_blank, kind[1:] != kind[:-1]))
    at = opened(cls, first)
    for word in CONTRACTIONS:
        size = len(word)
        fits = at[at + size < n]
        for k, c in enumerate(word, 1):
            fits = fits[(points[fits + k] == ord(c)) & ~first[fits + k]]
        start[fits + 1] = False
        after = fits + size + 1
        start[after[after < n]] = True
    return start


class Encoder:
    """The ids of pieces, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], most: int = CACHE):
        self.ranks, self.most, self.known = ranks, most, {}
        self.pack = {k: v.to_bytes(4, "little") for k, v in ranks.items()}
        top = max(ranks.values(), default=-1) + 1
        self.words = [b""] * top
        for k, v in ranks.items():
            self.words[v] = k
        self.lengths = np.fromiter(map(len, self.words), np.int64, top)
        self.blob = np.frombuffer(b"".join(self.words), np.uint8)
        self.word_at = np.cumsum(self.lengths) - self.lengths

    def miss(self, piece: bytes) -> bytes:
        found = self.pack.get(piece)
        if found is None:
            found = b"".join([self.pack[p] for p in (self.merge if len(piece) <= 48 else self.merge_long)(piece)])
        if len(self.known) >= self.most:
            self.known.clear()
        if len(piece) <= 256:
            self.known[piece] = found
        return found

    def merge(self, piece: bytes) -> list[bytes]:
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        far = len(self.words)
        pairs = [get(piece[i : i + 2], far) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < far:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], far)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], far)
        return parts

    def merge_long(self, piece: bytes) -> list[bytes]:
        """The same merges with a heap over a linked list."""
        n, get = len(piece), self.ranks.get
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                back[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := back[i]) >= 0 and (r := get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = end[i]
        return out

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Packed ids of each text; the texts together make one array of code points."""
        buffer = b"".join(texts)
        # a byte that is no UTF-8 becomes a code point of its own, U+DC80 and up
        points = np.frombuffer(buffer.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=text_at[1:])
        if len(points) == len(buffer):
            byte_at = np.arange(len(points))
        else:
            byte_at = np.zeros(len(points), np.int64)
            p = points[:-1]
            np.cumsum(1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000) - 2 * ((p >= 0xDC80) & (p < 0xDD00)), out=byte_at[1:])
        first = np.zeros(len(points), bool)
        first[np.searchsorted(byte_at, text_at[:-1][sizes > 0])] = True
        at = byte_at[piece_starts(points, first)]
        spans = np.searchsorted(at, text_at)
        for k in range(len(texts)):
            own = at[spans[k] : spans[k + 1]].tolist()
            own.append(int(text_at[k + 1]))
            known = self.known
            pieces = [buffer[a:b] for a, b in zip(own, own[1:])]
            try:
                yield b"".join([known[p] for p in pieces])
            except KeyError:
                yield b"".join([known.get(p) or self.miss(p) for p in pieces])

    def offsets(self, packed: bytes) -> np.ndarray:
        """Byte offset of each token in its text, and the text's length at the end."""
        out = np.zeros(len(packed) // 4 + 1, np.int64)
        np.cumsum(self.lengths[np.frombuffer(packed, "<u4")], out=out[1:])
        return out

    def decode(self, packed: bytes, offsets: np.ndarray) -> bytes:
        """The text's bytes: every token's, laid at its offset."""
        ids = np.frombuffer(packed, "<u4")
        back = np.repeat(self.word_at[ids] - offsets[:-1], self.lengths[ids])
        return self.blob[back + np.arange(offsets[-1])].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[list[bytes]]:
    """Whole texts in lists of about ``most`` bytes."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


#: A worker's encoder, kept between its tasks, by the run that it belongs to.
_encoders: dict[str, Encoder] = {}


def encode(docs: DataFrame, vocabulary: str, ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and byte offsets of the tokens."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    kind, of = docs.schema["doc_id"].dataType, uuid.uuid4().hex
    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, offsets array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoders.get(of)
        if coder is None:
            _encoders.clear()
            coder = _encoders[of] = Encoder(shared.value)
        for batch in batches:
            n, sha, back, lists, places = [], [], [], [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for some in chunks(texts):
                for packed in coder.encode(some):
                    n.append(len(packed) // 4)
                    sha.append(hashlib.sha256(packed).hexdigest())
                    offsets = coder.offsets(packed)
                    back.append(hashlib.sha256(coder.decode(packed, offsets)).hexdigest())
                    if ids:
                        lists.append(np.frombuffer(packed, "<i4"))
                        places.append(offsets[:-1].astype("<i4"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))]
                names += ["ids", "offsets"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
