import collections
import random
import re

import numpy as np
import xxhash

from gridloom.llm import near as near_copies
from gridloom.llm import components, queries, simhash


def mark_brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_brute(items):
    marks = np.array([m for _, m in items], np.uint64)
    low = list(range(len(items)))

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for i in range(len(items)):
        for j in np.flatnonzero(np.bitwise_count(marks[i + 1 :] ^ marks[i]) <= 3):
            a, b = sorted((root(i), root(i + 1 + int(j))))
            low[b] = a
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(items):
        least[root(k)].append(i)
    return [(i, f"{m:016x}", min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, m) in enumerate(items)]


def check(got, texts):
    want = groups_brute([(i, mark_brute(t)) for i, t in texts])
    assert sorted(got, key=str) == sorted(want, key=str)


def test_table(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check([tuple(r) for r in queries.op10_simhash(spark, sf).collect()], texts)


def test_cases(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, "É x y z"), (7, "É x y z"), (None, "é x y z"), (None, "q"), (None, "q"), (9, "w " * 70000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, fp string, piece int")
    check([tuple(r) for r in simhash.digests(simhash.near_dedup(df)).collect()], texts)
    assert simhash.near_dedup(df.limit(0)).collect() == []


def some_marks(rng, n, spread):
    centres = [rng.getrandbits(64) for _ in range(spread)]
    out = set()
    while len(out) < n:
        m = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            m ^= 1 << rng.randrange(64)
        out.add(m)
    return sorted(out)


def united(pairs, marks):
    low = {m: m for m in marks}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        low[y] = x
    return {m: root(m) for m in marks}


def test_tiles_find_every_link(spark):
    """Small and large tile groups, groups dealt by chunks, and more blocks, against all pairs."""
    rng = random.Random(3)
    for n, spread, most, keep in ((3000, 60, 8192, None), (3000, 2, 500, None), (2500, 30, 8192, 2)):
        marks = some_marks(rng, n, spread)
        array = np.array(marks, np.uint64)
        pairs = [(marks[i], marks[i + 1 + int(j)]) for i in range(n) for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3)]
        nodes = spark.createDataFrame([(int(x),) for x in array.view(np.int64)], "fp long")
        if keep:
            for k in range(len(pairs)):
                x = pairs[k][0] ^ pairs[k][1]
                assert any(not x & m for m in simhash.choices(3 + keep, keep))
        found = simhash.links(simhash.tile_groups(nodes, 3, most), 3).collect()
        got = [(int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))) for a, b in found]
        assert united(got, marks) == united(pairs, marks)
        assert len(got) <= 4 * n * max(1, -(-n // most))


def test_popcount_skip_is_exact():
    rng = random.Random(5)
    marks = np.array(sorted(some_marks(rng, 3000, 5), key=lambda m: (m.bit_count(), m)), np.uint64)
    low = simhash.tile_links(marks, 3, np.arange(len(marks)), 0)
    pairs = [(i, i + 1 + int(j)) for i in range(len(marks)) for j in np.flatnonzero(np.bitwise_count(marks[i + 1 :] ^ marks[i]) <= 3)]
    want = united(pairs, range(len(marks)))
    assert [want[k] for k in range(len(marks))] == low.tolist()


def test_components(spark):
    rng = random.Random(7)
    pairs = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    nodes = {x for p in pairs for x in p}
    got = {r["a"]: r["b"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in nodes} == united(pairs, nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def near(words, share, rng):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


def jaccard(a, b, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_by_five_words_and_four_fifths(spark):
    """Near copies of a long text go, texts that share half of it stay, and of each group the smallest id stays."""
    rng = random.Random(11)
    rows, wanted = [], {}
    for k in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(400)]
        copies = [" ".join(base)] + [" ".join(near(base, 0.004, rng)) for _ in range(3)]
        other = " ".join(base[:200] + [f"v{rng.randrange(4000)}" for _ in range(200)])
        for j, t in enumerate([*copies, other]):
            rows.append((100 * k + j, t, "en", "s", 1))
        wanted[k] = [jaccard(copies[0], c) for c in copies[1:]]
        assert jaccard(copies[0], other) < 0.5
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in near_copies.keep_first(df).collect()}
    assert all(100 * k in kept and 100 * k + 4 in kept for k in range(40))
    close = [100 * k + 1 + j for k in range(40) for j, v in enumerate(wanted[k]) if v >= 0.9]
    assert len(close) > 80 and sum(i in kept for i in close) <= 0.05 * len(close)


def test_wide_fingerprints_estimate_similarity():
    rng = random.Random(12)
    base = [f"w{rng.randrange(4000)}" for _ in range(2000)]
    for share in (0.005, 0.02, 0.05):
        a, b = " ".join(base), " ".join(near(base, share, rng))
        j = jaccard(a, b)
        bits = sum((x ^ y).bit_count() for x, y in zip(near_copies.describe(a.encode())[0], near_copies.describe(b.encode())[0]))
        assert abs(bits - 256 * np.arccos(2 * j / (1 + j)) / np.pi) < 25, (j, bits)
    assert near_copies.wide_limit(1.0) == 0 and 55 < near_copies.wide_limit(0.8) < 65


def test_recall_at_the_threshold(spark):
    """Single pairs of similarity 0.8 and just above are linked, those just below are not: exact but for the keys' small chance."""
    rng, rows, js = random.Random(21), [], {}
    while len(js) < 500:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 400))]
        other = near(base, rng.choice([0.015, 0.02, 0.025, 0.03]), rng)
        j = jaccard(" ".join(base), " ".join(other))
        if 0.7 <= j <= 0.9:
            js[2 * len(js)] = j
            rows += [(2 * len(js) - 2, " ".join(base)), (2 * len(js) - 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in near_copies.keep_first(df).collect()}
    above = [i for i, j in js.items() if j >= 0.8]
    assert len(above) > 150 and sum(i + 1 not in kept for i in above) >= 0.99 * len(above)
    assert all(i + 1 in kept for i, j in js.items() if j < 0.8) and all(i in kept for i in js)


def test_a_group_dealt_by_chunks(spark):
    """A large group of near copies, dealt over tasks, keeps one text; another of texts that only share half stays whole."""
    rng = random.Random(22)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(k, " ".join(near(base, 0.005, rng))) for k in range(600)]
    rows += [(1000 + k, " ".join(base[:150] + [f"v{rng.randrange(10**6)}" for _ in range(150)])) for k in range(100)]
    marks = near_copies.described(spark.createDataFrame(rows, "doc_id long, text string"))
    for most in (8192, 100):
        got = near_copies.first_of_groups(marks, most=most).select("first.doc_id").distinct().collect()
        assert sorted(r["doc_id"] for r in got) == [0, *range(1000, 1100)]
