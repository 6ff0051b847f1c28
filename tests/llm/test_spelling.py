"""Spelling variants against words compared one by one."""

import collections
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import queries, spelling


def edits(w, letters):
    return {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}


def brute(n):
    """Every edit of every word is looked up."""
    letters, out, form = sorted({c for w in n for c in w}), {}, {}
    for w in n:
        near = (edits(w, letters) & n.keys()) - {w}
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [form[w], None, n[w], len(near), n[form[w]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def counted_brute(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: k for w, k in n.items() if k >= 3}


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


WORDS = st.lists(st.text("abé", min_size=1, max_size=7), unique=True, max_size=60)


@settings(max_examples=500, deadline=None)
@given(WORDS, st.integers(1, 9), st.integers(1, 4))
def test_trie(words, base, parts):
    """Each pair that parts in a segment is met once, in the trie of its base and segment."""
    some = sorted(w for w in words if len(w) in (base, base + 1))
    edges = [(base + 1) * k // parts for k in range(parts + 1)]
    got = collections.Counter()
    for a, b in zip(edges, edges[1:]):
        for near in spelling.coinciding(some, base, a, b) if some else ():
            for k, i in enumerate(near):
                for j in near[k + 1 :]:
                    got[frozenset((some[i], some[j]))] += 1
    want = {frozenset((u, v)) for u in some for v in edits(u, "abé") & {*some} - {u} if min(len(u), len(v)) == base}
    assert got == dict.fromkeys(want, 1)


@pytest.mark.parametrize("most", [100_000, 20, 3])
def test_words(spark, most):
    """Dense words, with groups that are cut again and again."""
    rng = random.Random(most)
    n = {}
    for _ in range(1500):
        w = "".join(rng.choice("aab") for _ in range(rng.randrange(5, 11)))
        n[w] = 2 ** rng.randrange(2, 12) + rng.randrange(3)
    n |= {"prefix" * 20 + c + "suffix" * 20: 5 + k for k, c in enumerate(["", "x", "y", "xy", "xyz"])}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows(spelling.variants(df, most=most)) == brute(n)
    pairs = [(r["a"], r["b"]) for r in spelling.near_pairs(df, most).collect()]
    letters = "abprefixsuyz"
    assert sorted(pairs) == sorted((u, v) for u in n for v in edits(u, letters) & n.keys() if u < v)


def test_long_chain_of_forms(spark):
    """Roots over 40 forms, each of twice the occurrences, and many words with one root."""
    n = {"z" * 3 + "a" * k + "b" * (60 - k): 2**k for k in range(2, 42)} | {f"q{c}qqqqq": 3 for c in "bcdefghijklmn"} | {"qqqqqq": 500}
    want = brute(n)
    assert rows(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == want
    assert {want[w][1] for w in n if w[0] == "z" } == {"z" * 3 + "a" * 41 + "b" * 19}


def test_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(counted_brute(docs))
    got = rows(queries.op11_spelling(spark, sf))
    assert got == want and len(got) > 1000 and sum(v[0] is not None for v in got.values()) > 50


def test_odd_rows(spark, monkeypatch):
    texts = [None, "", "123 !?", "Cafés CAFÉS cafés " * 3, "abcde " * 10 + "abcdef×÷ " * 4, "x" * 300 + " ", "abcdf abcdf abcdf", "naïve中文words" * 5]
    docs = [(k, t, t, "n") for k, t in enumerate(texts)] * 3 + [(None, "words without number words words", "", "")] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string, word string, n string")
    monkeypatch.setattr(spelling, "HELD", 3)
    want = brute(counted_brute([(d[0], d[1]) for d in docs]))
    assert rows(spelling.spelling_variants(df)) == want and len(want) > 6
    assert spelling.spelling_variants(df.limit(0)).count() == 0
