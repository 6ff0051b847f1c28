import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODER = bpe.Encoder(bpe.read_ranks(PATH))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def decoded(packed):
    return CODER.decode(packed, CODER.offsets(packed))


def same(texts):
    got = [ids(p) for p in CODER.encode([t.encode() for t in texts])]
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [decoded(struct.pack(f"<{len(g)}I", *g)).decode() for g in got] == texts


CASES = [
    "", "'s", "''s", "a's b't", " 's", "\n's", "\n\n's x", "don't've'll'd'm're'x", "'sabc's'S", "!'s", "1's2'd", "  a   b \n c  ", "a ", " ", "\n", " \n \n", "x y  z", "\x1c\x1d a\x85b　",
    "'" * 50 + "s", "a" * 5000, "é🎉漢字 12³½ ñ", "1" * 300 + "!" * 300, "'l", "'ll", "'r", "'", "it's", " 's",
]


def test_cases_one_by_one_and_together():
    same(CASES)
    for t in CASES:
        same([t])
    same([CASES[k % len(CASES)] for k in range(500)])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'strevmld S1! \n\t "), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_any_text(texts):
    same(texts)


def test_every_code_point():
    """All code points, assigned or not, after a letter, a number, a sign, a space and an apostrophe."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 40000):
        some = points[start : start + 40000]
        same(["".join(f"{c}a{c}1{c}!{c} {c}'{c}s\n" for c in some)])


def test_bytes_that_are_no_text():
    for data in (b"\xff", b"a\xc3 b", b"\xed\xa0\x80x", b"ok \xf0\x9f\x8e", "é".encode() + b"\x80's"):
        (packed,) = CODER.encode([data])
        assert decoded(packed) == data
    assert [decoded(p) for p in CODER.encode([b"\xfe", b"", "né".encode()])] == [b"\xfe", b"", "né".encode()]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=120))
def test_both_merges_agree(piece):
    assert CODER.merge(piece) == CODER.merge_long(piece)


def test_scan_is_composition():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 6, (200, 6)).astype(np.uint8)
    got, state = bpe.scan(rows), 0
    for k, f in enumerate(rows):
        state = f[state]
        assert got[k, 0] == state


def test_offsets():
    packed = next(CODER.encode([b"some words, and more"]))
    parts = [CODER.words[i] for i in ids(packed)]
    assert bpe.Encoder.offsets(CODER, packed).tolist() == [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]


def test_cache_is_bounded():
    small = bpe.Encoder(bpe.read_ranks(PATH), most=10)
    text = " ".join(f"word{k}x" for k in range(200))
    assert ids(next(small.encode([text.encode()]))) == LIBRARY.encode_ordinary(text) and len(small.known) <= 10


@pytest.mark.parametrize("name", ["op2_bpe"])
def test_table(spark, sf, name):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES[name](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = LIBRARY.encode_ordinary(t)
        assert got[i] == {"doc_id": i, "n_tokens": len(want), "ids_sha256": hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest(), "decoded_sha256": hashlib.sha256(t.encode()).hexdigest()}


def test_frame_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "x"), (1, "a b", "y"), (2, "", "z")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids"], r["offsets"]) for r in bpe.encode(df, PATH).collect()), key=str)
    want = LIBRARY.encode_ordinary("a b")
    assert got == sorted([(1, 0, [], []), (None, 2, want, [0, 1]), (1, 2, want, [0, 1]), (2, 0, [], [])], key=str)
    assert bpe.encode(df.limit(0), PATH).collect() == []
