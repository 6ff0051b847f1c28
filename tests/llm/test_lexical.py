"""Ranked lexical search against scores of every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from gridloom.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    """docs: (doc_id, text); items: (item_id, text)."""
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df, out = collections.Counter(t for _, c in held for t in c), []
    for item, text in items:
        scored = []
        for i, c in held:
            m, score = 100 - 90 + 90 * sum(c.values()) * n_docs // length, 0
            for t in set(terms(text)):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:10])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_table(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got(queries.op12_lexical(spark, sf)) == brute(docs, items)


ODD = [None, "", " \n-", "Été ÉTÉ été", "a", "A a", "word", "中文 word", "x1 y2", "one two three", "one two three", "ONE", "İstanbul", "K kelvin", "a\x00b\x7fc", "big " * 40_000 + "end"]


@pytest.mark.parametrize("first, step", [(4, 1 << 20), (1, 3)])
def test_odd_rows(spark, monkeypatch, first, step):
    """Ties, repeated rows and items, null ids and texts, few results, several blocks of queries, cuts of batches and of what a task keeps."""
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "MORE", 2)
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(lexical, "LEAF", 2)
    monkeypatch.setattr(lexical, "ITEMS", 5)
    docs = [(k, t, 1, "s") for k, t in enumerate(ODD)] + [(100 - k, "tie of word", 1, "s") for k in range(30)] + [(7, "again", 1, "s"), (7, "again", 1, "s"), (None, "tie of word", 1, "s"), (None, "again", 1, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard int, q string").repartition(3)
    items = [(k, t, 0) for k, t in enumerate(["tie word", "again", None, "", "no such terms", "big end", "été", "K", "中文 istanbul İSTANBUL", "a b c one two", "one one one"])] + [(1, "again", 0), (None, "word", 0)]
    asked = spark.createDataFrame(items, "item_id long, text string, score int")
    assert got(lexical.search(df, asked)) == brute([d[:2] for d in docs], [i[:2] for i in items])
    assert lexical.search(df.limit(0), asked).count() == 0 and lexical.search(df, asked.limit(0)).count() == 0


def topics(seed, n=3000, kinds=8):
    rng = random.Random(seed)
    words = [[f"t{k}w{j}" for j in range(60)] for k in range(kinds)]
    return [(i, " ".join(rng.choices(words[i % kinds], k=rng.randrange(5, 40)) + rng.choices(["the", "of", "and"], k=5))) for i in range(n)]


def test_stops_early_and_exactly(spark):
    """Documents of eight topics: their shards differ, so most are never visited, and the ranks are those of all documents."""
    docs, items = topics(1), [(k, f"the t{k}w1 t{k}w2 t{k}w3") for k in range(8)]
    counts = []
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), counts)
    assert got(found) == brute(docs, items)
    made, all_ = counts[0]
    assert made < all_ / 2


def test_bisection_lowers_the_cost():
    """Log-gap cost of postings within the leaves: lower than that of any order of the mixed documents; leaves are balanced."""
    x = lexical.matrix([np.unique([hash(w) % lexical.FEATURES for w in t.split()]) for _, t in topics(2, 1024)])
    tree = lexical.bisected(x, 3)
    leaf = lexical.leaves(tree, x)

    def cost(of):
        total = 0.0
        for k in range(8):
            d = x[of == k].sum(axis=0)
            total += float((d * np.log2(max(1, (of == k).sum()) / (d + 1))).sum())
        return total

    rng = np.random.default_rng(1)
    assert cost(leaf) < 0.8 * min(cost(rng.permutation(leaf)) for _ in range(5))
    sizes = np.bincount(leaf, minlength=8)
    assert sizes.min() > 64 and sizes.sum() == 1024


def test_swaps_gain():
    """One bisection finds two kinds of documents that stand mixed."""
    x = np.zeros((200, 40), np.float32)
    for k in range(200):
        x[k, (k % 2) * 20 + np.arange(k % 7, k % 7 + 10)] = 1
    same = (lexical.halved(x) == (np.arange(200) % 2 == 1)).mean()
    assert max(same, 1 - same) > 0.95
