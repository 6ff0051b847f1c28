"""GIF media columns against a decoder that goes code by code and pixel by pixel."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import gif, queries


def decoded_brute(packed, small):
    """One code after the other, with a table of byte strings."""
    bits, n, at, clear = int.from_bytes(packed, "little"), 8 * len(packed), 0, 1 << small
    out, table, width, last = bytearray(), [], small + 1, None
    while at + width <= n:
        code, at = bits >> at & ((1 << width) - 1), at + width
        if code == clear:
            table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], small + 1, None
            continue
        if code == clear + 1:
            break
        said = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + said[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out += said
        last = said
    return bytes(out)


def encoded_brute(data, small, clear_at=4095):
    """Codes of a table that is cleared at a size, or never, packed bit by bit."""
    clear = 1 << small
    table, new, width, bits, at = {bytes([k]): k for k in range(clear)}, clear + 2, small + 1, 0, 0

    def put(code):
        nonlocal bits, at
        bits |= code << at
        at += width

    put(clear)
    w = b""
    for b in data:
        more = w + bytes([b])
        if more in table:
            w = more
            continue
        put(table[w])
        w = bytes([b])
        if new < 4096:
            table[more] = new
            new += 1
            if new > 1 << width and width < 12:
                width += 1
        if new == clear_at:
            put(clear)
            table, new, width = {bytes([k]): k for k in range(clear)}, clear + 2, small + 1
    if w:
        put(table[w])
        if new < 4096 and new + 1 > 1 << width and width < 12:
            width += 1
    put(clear + 1)
    return bits.to_bytes(at + 7 >> 3, "little")


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"the ", b"of ", b"aa", b"\xff"]), max_size=4000).map(b"".join))
def test_encoder(data):
    packed = gif.lzw_encoded(data)
    assert decoded_brute(packed, 8) == data == gif.lzw_decoded(packed, 8, len(data)).tobytes()


@pytest.mark.parametrize("small", [2, 3, 5, 8])
@pytest.mark.parametrize("clear_at", [100, 511, 512, 513, 4095, 1 << 30])
def test_decoder(small, clear_at):
    """Streams of any code size, with tables that are cleared early, when they are full, or never."""
    rng = random.Random(small * clear_at)
    for size in (0, 1, 7, 900, 40000):
        data = bytes(rng.choice([0, 1, (1 << small) - 1, rng.randrange(1 << small)]) for _ in range(size))
        packed = encoded_brute(data, small, clear_at)
        assert decoded_brute(packed, small) == data
        assert gif.lzw_decoded(packed, small, size).tobytes() == data


def test_long_runs_of_one_byte():
    for size in (1, 2, 257, 70_000, 3_000_000):
        assert gif.lzw_decoded(gif.lzw_encoded(b"a" * size), 8, size).tobytes() == b"a" * size


def made(frames, wide=7, high=9, shared=True, loop=True):
    """A file of frames (left, top, width, height, samples, disposal, transparent, hundredths, interlaced, own palette)."""
    colours = bytes(range(24))
    out = [b"GIF89a", struct.pack("<HHBBB", wide, high, 0x82 if shared else 0, 0, 0), colours if shared else b""]
    if loop:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for left, top, width, height, data, disposal, transparent, delay, interlaced, own in frames:
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0), b"\0"]
        out += [b"\x21\xfe\x02hi\0", b"\x2c", struct.pack("<HHHHB", left, top, width, height, interlaced << 6 | (0x82 if own else 0)), own or b""]
        out += [b"\x03", gif.blocks(encoded_brute(data, 3))]
    return b"".join([*out, b"\x3b"])


def composed_brute(frames, wide=7, high=9):
    """Pixel by pixel: (red, green, blue, alpha) of every frame's canvas, in rows."""
    canvas, out = [[(0, 0, 0, 0)] * wide for _ in range(high)], []
    for left, top, width, height, data, disposal, transparent, _, interlaced, own in frames:
        colours = own or bytes(range(24))
        lines = [r for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, height, b)] if interlaced else range(height)
        before = [list(r) for r in canvas]
        for k, y in enumerate(lines):
            for x in range(width):
                c = data[k * width + x]
                if c != transparent and top + y < high and left + x < wide:
                    canvas[top + y][left + x] = (*colours[3 * c : 3 * c + 3], 255)
        out.append([list(r) for r in canvas])
        if disposal == 2:
            for y in range(top, min(top + height, high)):
                for x in range(left, min(left + width, wide)):
                    canvas[y][x] = (0, 0, 0, 0)
        if disposal == 3:
            canvas = before
    return out


def some_frames(seed, n=6):
    rng, out = random.Random(seed), []
    for _ in range(n):
        left, top, width, height = rng.randrange(6), rng.randrange(8), rng.randrange(1, 8), rng.randrange(1, 10)
        data = bytes(rng.randrange(8) for _ in range(width * height))
        own = bytes(rng.randrange(256) for _ in range(24)) if rng.random() < 0.4 else None
        out.append((left, top, width, height, data, rng.choice([0, 1, 2, 2, 3, 3]), rng.choice([None, rng.randrange(8)]), rng.randrange(50), rng.random() < 0.4, own))
    return out


def test_composition(spark):
    """Disposal, transparency, interlaced rows, frames that leave the canvas, own palettes, times."""
    files = {seed: some_frames(seed) for seed in range(40)}
    df = spark.createDataFrame([(k, bytearray(made(f, loop=k % 2 == 0)), "x") for k, f in files.items()], "doc_id long, media binary, error string")
    got = {(r["doc_id"], r["frame"]): r for r in gif.frames(df).collect()}
    assert len(got) == 40 * 6
    for seed, frames in files.items():
        now = 0
        for k, canvas in enumerate(composed_brute(frames)):
            r = got[seed, k]
            assert bytes(r["pixels"]) == bytes(v for row in canvas for p in row for v in p)
            assert (r["start_ms"], r["delay_ms"]) == (now, 10 * frames[k][7]) and r["error"] is None
            seen = [0] * 64
            for red, green, blue, alpha in (p for row in canvas for p in row):
                seen[red // 64 * 16 + green // 64 * 4 + blue // 64] += alpha > 0
            assert r["histogram"] == seen
            now += r["delay_ms"]


def test_broken_media(spark):
    whole = made(some_frames(1, 2))
    bad = made([(0, 0, 2, 2, b"\0\1\2\3", 0, None, 0, False, None)], shared=False)
    cases = [None, b"", b"not a picture", whole[:-1], whole[: len(whole) // 2], bad, whole[:13] + b"\x07" + whole[14:], whole, b"GIF89a\xff\xff\xff\xff\0\0\0"]
    got = gif.frames(spark.createDataFrame([(k, m) for k, m in enumerate(cases)], "doc_id long, media binary")).collect()
    errors = {r["doc_id"]: r["error"] for r in got if r["error"]}
    assert sorted(errors) == [1, 2, 3, 4, 5, 8] and errors[8] == "too many pixels" and errors[2] == "not a GIF" and errors[5] == "no palette"
    assert [sum(r["doc_id"] == k and r["error"] is None for r in got) for k in (0, 3, 7)] == [0, 2, 2]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(0, 400))
def test_any_damage_is_named(noise, at):
    """Damaged files give frames or a fault, never another error."""
    data = bytearray(made(some_frames(3, 2)))
    data[at : at + len(noise)] = noise
    try:
        for frame in gif.Reader(bytes(data[:600])).frames():
            gif.histogram(frame.canvas)
    except gif.Broken:
        pass


def row_brute(text):
    data = (text or "").encode()
    payload = data + b" " * (192 if not data else -len(data) % 192)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_table(spark, sf):
    got = {r["doc_id"]: r for r in queries.op13_gif(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    media = {r["doc_id"]: bytes(r["media"]) for r in gif.stored(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == row_brute(d["text"])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[d["doc_id"]]), hashlib.sha256(media[d["doc_id"]]).hexdigest())


def test_stored_frames_show_the_text(spark):
    """Samples by the palette from the frames table, and colours counted pixel by pixel."""
    texts = [None, "", "é" * 96, "x" * 192, "abc\n" * 20_000, "same", "same"]
    docs = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    stored = gif.stored(docs)
    digests = {r["doc_id"]: r for r in gif.media_digests(stored).collect()}
    by = {}
    for r in sorted(gif.frames(stored).collect(), key=lambda r: (r["doc_id"], r["frame"])):
        by.setdefault(r["doc_id"], []).append(r)
    known = {tuple(c): k for k, c in enumerate(gif.COLOURS.tolist())}
    for k, t in enumerate(texts):
        payload, seen = b"", np.zeros(64, int)
        for r in by[k]:
            pixels = np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(r["canvas_height"], r["canvas_width"], 4)
            payload += bytes(known[tuple(p)] for row in pixels[: r["height"], :, :3].tolist() for p in row)
            seen += np.array(r["histogram"])
        assert hashlib.sha256(payload).hexdigest() == row_brute(t)[2] == digests[k]["payload_sha256"]
        assert digests[k]["feature"] == ",".join(map(str, seen.tolist()))
    assert len(by[4]) == 4 and [r["start_ms"] for r in by[4]] == [0, 100, 200, 300]
    assert tuple(digests[5])[1:] == tuple(digests[6])[1:]
    assert gif.media_digests(gif.stored(docs.limit(0))).count() == 0
