"""SimHash near-dedup: tiled exact comparison of fingerprints.

A fingerprint bit is 1 if it is set in over half of the XXH64 values (seed 42)
of a text's word shingles.  Equal fingerprints are one node; nodes are linked
where they differ in ``RADIUS`` bits or fewer; components of the links are the
groups.

Comparison is exact: numpy exclusive-or and bit counts over tiles of nodes that
are sorted by population count, and a pair of tiles whose population counts
differ by more than the radius is skipped, since two fingerprints differ in at
least as many bits as their counts.  Which nodes meet in a task is decided by
the pigeonhole: of ``RADIUS + k`` blocks of bits, two fingerprints within the
radius agree in k at least, so a node goes to one tile group per choice of k
blocks.  That loses no pair, and the work stays near-linear where comparing all
tiles is quadratic; k grows with the number of nodes, so that tile groups stay
small.  A tile group above ``MOST`` nodes is dealt over tasks by pairs of
chunks.

``near`` builds on these tiles for near copies by five words and a similarity.

A task reports the links of its nodes to the smallest node that they reach in
the task: at most one per node, never all pairs.  Only fingerprints, not texts,
are shuffled; hot fingerprints, groups and components are salted.

Defined results: null and empty texts, and texts of white space only, have
fingerprint 0 and are linked like others; texts of fewer words than a shingle
are one shingle; very long texts are taken whole; repeated rows are rows of their own in one component; null
doc_ids never name a component that has another id; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, per_key, salt
from .components import components

WORDS, RADIUS, SEED, TILE, MOST = 3, 3, 42, 1024, 8192
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; ASCII letters without case, ASCII white space between words."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    stops = ends[words - 1 :].tolist()
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops)], np.uint64, len(stops))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        some = hashes[k : k + BLOCK].astype(">u8").view(np.uint8)
        counts += np.unpackbits(some).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    return majority(shingle_hashes(text, words))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Another 64 bits of each hash (the finaliser of SplitMix64)."""
    z = hashes + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Written rows of doc_id, fp (the fingerprint as a signed long), seq (a number of the row's own) and piece (its salt).

    The numbers are written with the rows: counted anew in each scan, they could be others.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            marks = np.array([fingerprint(t, words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")
    return materialize(rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("piece", salt(F.col("seq"))), "fingerprints")


def choices(blocks: int, keep: int) -> list[int]:
    """A mask of 64 bits for each choice of ``keep`` of the blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(some) for some in itertools.combinations(own, keep)]


def tile_groups(nodes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(group, fp) for every tile group a node is compared in; few nodes want one block to agree, many want more."""
    n, keep = nodes.count(), 1
    while (n >> (64 * keep // (radius + keep))) > most // 2:
        keep += 1
    masks = choices(radius + keep, keep)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    group = lambda k, m: F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")))
    rows = nodes.select("fp", F.explode(F.array(*[group(k, m) for k, m in enumerate(masks)])).alias("group"))
    rows = rows.withColumn("piece", salt(F.col("fp")))
    counts = rows.groupBy("group", "piece").agg(F.count("*").alias("n")).groupBy("group").agg(F.sum("n").alias("n"), F.collect_set("piece").alias("pieces"))
    large = counts.where(F.col("n") > most).select("group", "n", F.explode("pieces").alias("piece"))
    rows = rows.join(large, ["group", "piece"], "left")
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / most).cast("int")
    own = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("chunks")).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair: Column = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(F.when(F.col("chunks") == 1, F.col("group")).otherwise(pair).alias("group"), "fp")


def settle(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels with i and j of each link united; a label is the smallest index reached."""
    while len(i):
        a, b = low[i], low[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up
    return low


def tile_links(marks: np.ndarray, radius: int, low: np.ndarray, at: int) -> np.ndarray:
    """Compares a large tile group: tiles of nodes by population count. marks: sorted by population count."""
    ones = np.bitwise_count(marks)
    tiles = range(0, len(marks), TILE)
    for a in tiles:
        for b in range(a, len(marks), TILE):
            if int(ones[b]) - int(ones[min(a + TILE, len(marks)) - 1]) > radius:
                break  # this tile and all after it are too far
            near = np.bitwise_count(marks[a : a + TILE, None] ^ marks[None, b : b + TILE]) <= radius
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            good = i < j
            low = settle(low, i[good] + at, j[good] + at)
    return low


def compare(groups: np.ndarray, marks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as row numbers, of rows sorted by group and population count, whole groups only."""
    n = len(groups)
    low = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff(np.append(starts, n))
    large = sizes > 64
    for at, size in zip(starts[large].tolist(), sizes[large].tolist()):
        low = tile_links(marks[at : at + size], radius, low, at)
    small = np.repeat(~large, sizes)
    i, d, ones = np.flatnonzero(small), 1, np.bitwise_count(marks)
    while True:  # rows d apart in one group
        i = i[i + d < n]
        i = i[groups[i] == groups[i + d]]
        if not len(i):
            break
        close = i[ones[i + d] - ones[i] <= radius]
        near = close[np.bitwise_count(marks[close] ^ marks[close + d]) <= radius]
        low = settle(low, near, near + d)
        d += 1
    linked = np.flatnonzero(low != np.arange(n))
    return linked, low[linked]


def streamed(compared: Callable) -> Callable:
    """A function for mapInArrow over rows sorted by their first column, the group: gives ``compared`` the columns of whole groups, and returns the pairs that it finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []  # of the group that the next batch may continue

        def out(x: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(map(pa.array, compared(x))), names=["a", "b"])

        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(x[0]):
                continue
            one = x[0][0] == x[0][-1] and (not kept or kept[0][0][0] == x[0][0])
            kept.append(x)
            if one:
                continue
            x = [np.concatenate(c) for c in zip(*kept)]
            cut = int(np.flatnonzero(x[0] != x[0][-1])[-1]) + 1
            kept = [[c[cut:] for c in x]]
            yield out([c[:cut] for c in x])
        if kept:
            yield out([np.concatenate(c) for c in zip(*kept)])

    return run


def links(tiles: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of fingerprints that are within the radius, or reach each other within a tile group."""

    def compared(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, b = compare(x[0], x[1].view(np.uint64), radius)
        return x[1][a], x[1][b]

    dealt = tiles.repartition("group").withColumn("ones", F.bit_count("fp")).sortWithinPartitions("group", "ones", "fp")
    return dealt.select("group", "fp").mapInArrow(streamed(compared), "a long, b long")


def named(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per fingerprint: the first row of its component (no_id, doc_id, seq), by doc_id."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "seq")
    nodes = materialize(rows.groupBy("fp").agg(F.min(first).alias("low")), "nodes")
    roots = components(links(tile_groups(nodes.select("fp"), radius), radius))
    found = nodes.join(roots.select(F.col("a").alias("fp"), "b"), "fp", "left").select("fp", F.coalesce("b", "fp").alias("root"), "low")
    return per_key(found.withColumn("piece", salt(F.col("fp"))), ["root"], {"first": ("min", "low")}, "piece").select("fp", "first")


def near_dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fp and component_id, the smallest doc_id reachable over links."""
    rows = fingerprints(docs, words)
    return spread(rows, named(rows, radius)).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def spread(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Rows with what their fingerprint names; a fingerprint's entry is copied to the pieces in which it has rows."""
    pieces = rows.groupBy("fp").agg(F.collect_set("piece").alias("pieces"))
    return rows.join(named.join(pieces, "fp").withColumn("piece", F.explode("pieces")).drop("pieces"), ["fp", "piece"])


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
