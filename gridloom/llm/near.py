"""Near copies by five words and a similarity of 0.8 or more: SimHash tiles, confirmed by exact similarity.

A text is the set of its five-word shingles' hashes.  Its 256-bit SimHash is
compared in tiles, as in ``simhash``: exclusive-or and bit counts, skipping tile
pairs whose population counts differ beyond the radius.  The radius lets all but
some 3 in 100,000 pairs at the threshold through; pairs within it are compared by the exact
Jaccard similarity of their sets, unless they are linked already.

Blocks of bits can't tell which texts to compare at such a radius, so tile
groups are made by min-wise keys: ``BANDS`` keys of ``ROWS`` minima each.  Two
sets of similarity s share one with probability 1 - (1 - s**ROWS)**BANDS: 0.999
at 0.8, 0.9999 at 0.85.  Unlike texts share none, at any number of texts, so the
work is that of the near copies.  Only texts that share a key with another carry their
sets into groups.  A group above ``MOST`` texts is dealt over tasks by pairs of
chunks, which loses no pair.

Texts with equal sets are one node; a task reports for each node the smallest
one that it reaches.  Defined results: those of ``simhash``; a text without a
word has one shingle, the empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, met, per_key, salt
from .components import components
from .filters import bitmaps, bits_for, keep_decided, marked, position
from .simhash import MOST, SEED, TILE, majority, mixed, settle, shingle_hashes, streamed

SHINGLE, SIMILARITY, WIDE, BANDS, ROWS = 5, 0.8, 4, 14, 4
#: Shingles that are minimised at once.
STEP = 1 << 13
_odd = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 2), np.int64).astype(np.uint64)
FACTORS, SHIFTS = (_odd[:, 0] * np.uint64(2) + np.uint64(1))[:, None], _odd[:, 1][:, None]


def wide_limit(similarity: float) -> int:
    """Differing bits of wide fingerprints at a Jaccard similarity J, and four deviations: cosine 2J / (1 + J) makes an angle, of which a bit differs with probability angle / pi."""
    share, n = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * WIDE
    return int(n * share + 4 * math.sqrt(n * share * (1 - share)))


def describe(text: bytes) -> tuple[list[int], list[int], np.ndarray]:
    """A text's wide fingerprint, its keys, and the sorted set of its shingles (32 bits of each hash)."""
    hashes = np.unique(shingle_hashes(text, SHINGLE))
    if not len(hashes):
        hashes = np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)
    wide, mixing = [], hashes
    for _ in range(WIDE):
        wide.append(majority(mixing))
        mixing = mixed(mixing)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), STEP):
        drawn = hashes[None, k : k + STEP] * FACTORS + SHIFTS
        low = np.minimum(low, (drawn ^ (drawn >> np.uint64(29))).min(axis=1))
    packed = low.tobytes()
    keys = [xxhash.xxh64_intdigest(packed[8 * ROWS * b : 8 * ROWS * (b + 1)], b) for b in range(BANDS)]
    return wide, keys, np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def described(docs: DataFrame) -> DataFrame:
    """Written rows of doc_id, hash (of the text), w0.. (the wide fingerprint), keys, shingles (packed), id (names them), seq and piece."""
    bounded_batches(docs.sparkSession)
    kind, wide = docs.schema["doc_id"].dataType.simpleString(), [f"w{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            marks = np.array([w for w, _, _ in found], np.uint64).reshape(len(found), WIDE).view(np.int64)
            keys = np.array([k for _, k, _ in found], np.uint64).reshape(len(found), BANDS).view(np.int64)
            columns = [batch.column(0), batch.column(2), *[pa.array(np.ascontiguousarray(marks[:, k])) for k in range(WIDE)]]
            columns += [pa.array(list(keys), pa.list_(pa.int64())), pa.array([s.tobytes() for _, _, s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", *wide, "keys", "shingles"])

    form = f"doc_id {kind}, hash long, " + "".join(f"{w} long, " for w in wide) + "keys array<long>, shingles binary"
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, form)
    rows = rows.withColumn("id", F.xxhash64(*wide, "shingles")).withColumn("seq", F.monotonically_increasing_id())
    return materialize(rows.withColumn("piece", salt(F.col("seq"))), "near-rows")


def tiles(rows: DataFrame, nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(group, ones, id, w0.., shingles) for every group in which a node is compared."""
    own = nodes.select(F.col("low.seq").alias("seq"))
    held = rows.select("seq", "id", "keys").join(own, "seq", "left_semi")
    held = held.select("id", F.posexplode("keys").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("group"), salt(F.col("id")).alias("piece"))
    held = materialize(held, "near-keys")
    counts = held.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    held = met(held, counts, ["group"], "piece").withColumn("chunks", F.ceil(F.col("n") / most).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    held = materialize(held.select("id", F.when(F.col("chunks") == 1, F.col("group")).otherwise(pair).alias("group")), "near-groups")
    # only rows that a filter of the needed numbers holds are moved with their sets
    needed = materialize(nodes.select("id", F.col("low.seq").alias("seq")).join(held.select("id").distinct(), "id", "left_semi").select("seq"), "near-needed")
    bits = bits_for(needed.count())
    key = F.xxhash64("seq")
    some = marked(rows, bitmaps(needed.select(position(key, bits).alias("pos")), "near-filter"), bits, key).where("__held").select(*rows.columns)
    carried = some.join(needed, "seq", "left_semi")
    wide = [f"w{k}" for k in range(WIDE)]
    ones = sum((F.bit_count(w) for w in wide), F.lit(0)).alias("ones")
    return held.join(carried.select("id", ones, *wide, "shingles"), "id").select("group", "ones", "id", *wide, "shingles")


def group_links(ones: np.ndarray, wide: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> np.ndarray:
    """Labels of a group's nodes, in order of ones: the smallest index reached over links of the similarity or more."""
    n = len(sets)
    low, sizes = np.arange(n), np.fromiter(map(len, sets), np.int64, n)
    universe, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts, mark = ends - sizes, np.zeros(len(universe), np.uint8)
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            if int(ones[b]) - int(ones[min(a + TILE, n) - 1]) > radius:
                break  # this tile and all after it are too far
            stop = min(b + TILE, n)
            near = np.bitwise_count(wide[a : a + TILE, None] ^ wide[None, b:stop]).sum(axis=2, dtype=np.int32) <= radius
            own, at = codes[starts[b] : ends[stop - 1]], starts[b:stop] - starts[b]
            for i in range(a, min(a + TILE, n)):
                js = np.flatnonzero(near[i - a]) + b
                js = js[js > i]
                js = js[low[js] != low[i]]
                js = js[similarity * np.maximum(sizes[js], sizes[i]) <= np.minimum(sizes[js], sizes[i])]
                if not len(js):
                    continue
                mine = codes[starts[i] : ends[i]]
                mark[mine] = 1
                if 8 * len(js) < stop - b:
                    both = np.array([np.count_nonzero(mark[codes[starts[j] : ends[j]]]) for j in js.tolist()])
                else:
                    both = np.add.reduceat(mark[own], at, dtype=np.int64)[js - b]
                mark[mine] = 0
                good = js[both >= similarity * (sizes[i] + sizes[js] - both) - 1e-9]
                low = settle(low, np.full(len(good), i), good)
    return low


def links(found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of nodes, by id, that are similar, or reach each other within a group."""
    wide, radius = [f"w{k}" for k in range(WIDE)], wide_limit(similarity)

    def compared(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        groups, ones, ids = x[0], x[1], x[2]
        marks, low = np.stack(x[3 : 3 + WIDE], axis=1).view(np.uint64), np.arange(len(groups))
        starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        for at, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(groups)]):
            if stop - at > 1:
                sets = [np.frombuffer(s, np.uint32) for s in x[-1][at:stop]]
                low[at:stop] = at + group_links(ones[at:stop], marks[at:stop], sets, radius, similarity)
        moved = np.flatnonzero(low != np.arange(len(low)))
        return ids[moved], ids[low[moved]]

    dealt = found.repartition("group").sortWithinPartitions("group", "ones", "id").select("group", "ones", "id", *wide, "shingles")
    return dealt.mapInArrow(streamed(compared), "a long, b long")


def first_of_groups(rows: DataFrame, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """(id, first): per node the first row of its group (no_id, doc_id, seq), by doc_id."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "seq")
    nodes = materialize(rows.groupBy("id").agg(F.min(first).alias("low")), "near-nodes")
    roots = components(links(tiles(rows, nodes, most), similarity))
    named = nodes.join(roots.select(F.col("a").alias("id"), "b"), "id", "left").select("id", F.coalesce("b", "id").alias("root"), "low")
    return per_key(named.withColumn("piece", salt(F.col("id"))), ["root"], {"first": ("min", "low")}, "piece").select("id", "first")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near copies, with all their columns. Rows are matched on doc_id and a hash of the text."""
    rows = described(docs)
    stay = first_of_groups(rows, similarity).select("first.seq").distinct().withColumn("kept", F.lit(True))
    decided = rows.select("seq", "doc_id", "hash").join(stay, "seq", "left").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.coalesce("kept", F.lit(False)).alias("kept"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"))
    return keep_decided(keyed, decided, ["__id", "__hash"], unique=True).select("row.*")
