r"""Ranked lexical search: a clustered index over documents reordered by recursive graph bisection.

Items are taken in blocks of a bounded number of items and terms; a block's terms are the
vocabulary of its pass over the documents.

1. *Scan*: per document its length and the block's terms in it with their occurrences; from
   these the numbers N, L and df over all documents.
2. *Reordering*: recursive graph bisection (Dhulipala et al. 2016) of a sample of ``SAMPLE``
   documents (those of the smallest hashes): documents are swapped between two halves while
   that lowers the log-gap cost of the terms' postings, then each half is halved. A
   bisection leaves a router, the terms' log-odds between its halves and the sample's
   median; by these every document of the corpus goes left or right, down to its leaf.
   The sample is what the tree is fitted on, and nothing more: the tree decides how
   tight bounds are, never which documents are found.
3. *Clustered index*: documents are written in order of (leaf, band of lengths),
   which is the shard, in ranges that split large shards. For each shard and term the
   largest share of a score is kept; a query's bound of a shard is the sum over its terms.
4. *Visits*: each query visits shards by falling bound, first ``FIRST``, then ``MORE`` times as many
   and so on. It stops when the best bound that is left is below its tenth score, which is exact;
   equal bounds are visited, since a tie may have a smaller doc_id. Results are by (score, doc_id)
   of the documents themselves, whatever their place in the order.

A score is a sum of integers below 2**53, which doubles add without error.

Tasks report their ten best for each query. The driver gets numbers, a block's
df, the sample (``SAMPLE`` rows of ``FEATURES`` bits) and the bounds of a block (items x shards).

Defined results: null and empty texts have no terms, are no part of N and are never found; items without
terms have no rows; repeated documents and documents that share a doc_id each take a rank; null doc_ids come last among equal
scores; repeated items are items of their own, with equal rows; very long texts are taken whole; no documents or no items give no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bounded_batches, materialize

TOP = 10
#: A block of queries.
ITEMS, PAIRS = 512, 1 << 15
SAMPLE, FEATURES, DEPTH, LEAF, SWEEPS = 4096, 2048, 6, 32, 16
FIRST, MORE = 4, 8
#: Query and posting pairs that are added up at once.
STEP = 1 << 20
#: Terms are what is left between these: ASCII that is no letter or digit.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def scan(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Written rows of doc_id, size (terms with repeats), terms (numbers in the vocabulary) and tfs."""
    bounded_batches(docs.sparkSession)
    known = {t.encode(): k for k, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers, tfs = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = text.as_py().translate(SPACES).lower().split()
                found = Counter(filter(known.__contains__, words))
                sizes.append(len(words))
                numbers.append([known[w] for w in found])
                tfs.append(list(found.values()))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, ints), pa.array(tfs, ints)], names=["doc_id", "size", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.mapInArrow(run, "doc_id long, size long, terms array<int>, tfs array<int>"), "lexical-scan")


@dataclass
class Tree:
    """Routers of the bisections, as a heap: the children of node k are 2k + 1 and 2k + 2."""

    odds: np.ndarray
    middle: np.ndarray
    depth: int


def halved(x: np.ndarray) -> np.ndarray:
    """Which rows of a 0/1 matrix go to the second half: swaps of the pairs that gain most, until none gains."""
    n = len(x)
    second = np.random.default_rng(n).permutation(n) >= n // 2  # halves that are alike would gain nothing
    for _ in range(SWEEPS):
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        a, b = x[left].sum(axis=0), x[right].sum(axis=0)
        cost = lambda d, of: d * np.log2(of / (d + 1))  # noqa: E731  d postings among ``of`` documents
        now = cost(a, len(left)) + cost(b, len(right))
        over = now - cost(np.maximum(a - 1, 0), len(left)) - cost(b + 1, len(right))
        back = now - cost(a + 1, len(left)) - cost(np.maximum(b - 1, 0), len(right))
        gain_l, gain_r = x[left] @ over, x[right] @ back
        by_l, by_r = np.argsort(-gain_l, kind="stable"), np.argsort(-gain_r, kind="stable")
        m = min(len(left), len(right))
        good = int((gain_l[by_l[:m]] + gain_r[by_r[:m]] > 1e-6).sum())  # falling, so these come first
        if not good:
            break
        second[left[by_l[:good]]], second[right[by_r[:good]]] = True, False
    return second


def bisected(x: np.ndarray, depth: int) -> Tree:
    """The tree of a sample, a float32 matrix of 0 and 1."""
    tree = Tree(np.zeros((2**depth - 1, x.shape[1]), np.float32), np.zeros(2**depth - 1, np.float32), depth)
    rows = {0: np.arange(len(x))}
    for node in range(2**depth - 1):
        own = rows.pop(node)
        if len(own) < 2:
            rows[2 * node + 1], rows[2 * node + 2] = own, own[:0]
            continue
        part = x[own]
        second = halved(part)
        share = lambda of: np.log2((part[of].sum(axis=0) + 1) / (of.sum() + 2))
        tree.odds[node] = share(second) - share(~second)
        scores = part @ tree.odds[node]
        tree.middle[node] = np.median(scores)
        right = scores > tree.middle[node]
        rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return tree


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row, from left to right."""
    node = np.zeros(len(x), np.int64)
    for _ in range(tree.depth):
        score = np.einsum("ij,ij->i", x, tree.odds[node])
        node = 2 * node + 1 + (score > tree.middle[node])
    return node - (2**tree.depth - 1)


def matrix(lists: list[np.ndarray]) -> np.ndarray:
    """Rows of 0 and 1: which features a list of terms has."""
    x = np.zeros((len(lists), FEATURES), np.float32)
    for k, terms in enumerate(lists):
        x[k, np.asarray(terms, np.int64) % FEATURES] = 1
    return x


def fitted(scanned: DataFrame, n_docs: int) -> Tree:
    """The tree of the documents of the smallest hashes. Those below a hash that about 1.25 * SAMPLE are below come to the driver, and no more than twice SAMPLE."""
    features = F.array_distinct(F.transform("terms", lambda t: F.pmod(t, F.lit(FEATURES)))).alias("features")
    h, least = F.xxhash64("doc_id", "size"), -(1 << 63)
    below = min((1 << 63) - 1, least + int((1 << 64) * 1.25 * SAMPLE / n_docs))
    some = scanned.where((F.size("terms") > 0) & (h <= F.lit(below).cast("long"))).select(h.alias("h"), "doc_id", features).limit(2 * SAMPLE).toArrow()
    order = some.sort_by([("h", "ascending"), ("doc_id", "ascending")]).slice(0, SAMPLE)
    x = matrix(order.column("features").to_pylist())
    return bisected(x, max(0, min(DEPTH, int(math.log2(max(1, len(x) // LEAF))))))


def spread(offsets: np.ndarray) -> np.ndarray:
    """The row of each list element, from the lists' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and the values of a batch's lists."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def ordered(scanned: DataFrame, tree: Tree, n_docs: int, length: int) -> DataFrame:
    """Written rows of shard, doc_id, m, terms and tfs, in order of shards: the reordered documents that hold a term of the block."""
    form = "shard int, doc_id long, m long, terms array<int>, tfs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = 10 + 90 * batch.column(1).to_numpy() * n_docs // length
            offsets, terms = lists(batch.column(2))
            leaf = leaves(tree, matrix([terms[a:b] for a, b in zip(offsets, offsets[1:])]))
            shard = leaf * 64 + np.floor(np.log2(m)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column(0), pa.array(m, pa.int64()), *batch.columns[2:]], names=["shard", "doc_id", "m", "terms", "tfs"])

    rows = scanned.where(F.size("terms") > 0).select("doc_id", "size", "terms", "tfs").mapInArrow(run, form)
    return materialize(rows.repartitionByRange("shard", F.xxhash64("doc_id", "terms")).sortWithinPartitions("shard"), "lexical-index")


def shares(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per posting of a batch of the index: row, term, and what it adds to a score."""
    offsets, terms = lists(batch.column(3))
    row, tf = spread(offsets), lists(batch.column(4))[1].astype(np.int64)
    return row, terms, weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * batch.column(2).to_numpy()[row]))


def bounds(index: DataFrame, weights: np.ndarray) -> DataFrame:
    """(shard, term, most): the largest share of a score that a term has in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, most = None, np.zeros(len(weights), np.int64)

        def out() -> pa.RecordBatch:
            terms = np.flatnonzero(most)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), at), pa.int32()), pa.array(terms, pa.int32()), pa.array(most[terms])], names=["shard", "term", "most"])

        for batch in batches:
            row, terms, add = shares(batch, weights)
            shard = batch.column(0).to_numpy()[row]
            for s in np.unique(shard).tolist():
                if at is not None and s != at:
                    yield out()
                    most[:] = 0
                at, own = s, shard == s
                np.maximum.at(most, terms[own], add[own])
        if at is not None:
            yield out()

    return index.mapInArrow(run, "shard int, term int, most long").groupBy("shard", "term").agg(F.max("most").alias("most"))


def best(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.select("q", "doc_id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= TOP)


class Kept:
    """The best documents of each query so far, in one task."""

    def __init__(self, floor: np.ndarray):
        self.floor, self.rows, self.n = floor.copy(), [], 0

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        self.rows.append((q, score, none, ids))
        self.n += len(q)
        if self.n > STEP:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        q, score, none, ids = map(np.concatenate, zip(*self.rows))
        order = np.lexsort((ids, none, -score, q))
        q, score, none, ids = q[order], score[order], none[order], ids[order]
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        tenth = rank == TOP - 1
        self.floor[q[tenth]] = np.maximum(self.floor[q[tenth]], score[tenth])
        keep = rank < TOP
        self.rows = [(q[keep], score[keep], none[keep], ids[keep])]
        self.n = int(keep.sum())
        return self.rows[0]


def visited(index: DataFrame, weights: np.ndarray, pairs: np.ndarray, visits: np.ndarray, floor: np.ndarray) -> DataFrame:
    """(q, doc_id, score) of the best documents of the visits. pairs: rows of (term, query) by term; visits: queries x shards, which are visited; floor: scores below aren't wanted."""
    n_queries = len(floor)
    first = np.searchsorted(pairs[:, 0], np.arange(len(weights) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(floor)
        for batch in batches:
            row, terms, add = shares(batch, weights)
            ids, shard = batch.column(1), batch.column(0).to_numpy()
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            fan = first[terms + 1] - first[terms]
            ends = np.cumsum(fan)
            # whole rows, of about STEP pairs
            cuts = [0]
            for k in np.flatnonzero(np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.zeros(0, bool)).tolist():
                if ends[k] - (ends[cuts[-1] - 1] if cuts[-1] else 0) >= STEP or k == len(row) - 1:
                    cuts.append(k + 1)
            for a, b in zip(cuts, cuts[1:]):
                low, many = int(row[a]), fan[a:b]
                inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                q = pairs[np.repeat(first[terms[a:b]], many) + inner, 1]
                n = int(row[b - 1]) - low + 1
                score = np.bincount(np.repeat(row[a:b] - low, many) * n_queries + q, weights=np.repeat(add[a:b], many), minlength=n * n_queries).reshape(n, n_queries)
                d, q = np.nonzero((score > 0) & (score >= kept.floor) & visits[:, shard[low : low + n]].T)
                if len(d):
                    kept.add(q, score[d, q].astype(np.int64), ids[low + d], none[low + d])
        if kept.rows:
            q, score, none, ids = kept.cut()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, pa.int64(), mask=none), pa.array(score)], names=["q", "doc_id", "score"])

    active = [s for s in np.flatnonzero(visits.any(axis=0)).tolist()]
    return index.where(F.col("shard").isin(active)).mapInArrow(run, "q int, doc_id long, score long")


def of_block(docs: DataFrame, block: list[tuple[int, str]], counts: list | None = None) -> DataFrame:
    """(q, rank, doc_id, score) for queries given as pairs of q (numbers from 0) and term; counts gets (visits, shards x queries)."""
    spark = docs.sparkSession
    terms = sorted({t for _, t in block})
    known, n_queries = {t: k for k, t in enumerate(terms)}, 1 + max((q for q, _ in block), default=-1)
    none = spark.createDataFrame([], "q int, doc_id long, score long, rank int")
    scanned = scan(docs, terms)
    total = scanned.agg(F.count_if(F.col("size") > 0).alias("docs"), F.sum("size").alias("length")).first()
    if not total["docs"] or not block:
        return none
    df = dict(scanned.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect())
    weights = np.array([weight(total["docs"], df.get(k, 0)) for k in range(len(terms))], np.int64)
    pairs = np.array(sorted({(known[t], q) for q, t in block}), np.int64).reshape(-1, 2)
    index = ordered(scanned, fitted(scanned, total["docs"]), total["docs"], total["length"])
    of_shard = bounds(index, weights)
    asked = spark.createDataFrame([(int(t), int(q)) for t, q in pairs], "term int, q int")
    table = of_shard.join(asked, "term").groupBy("q", "shard").agg(F.sum("most").alias("most")).toArrow()
    q, shard, most = (table.column(c).to_numpy() for c in ("q", "shard", "most"))
    limit = np.zeros((n_queries, 64 << DEPTH), np.int64)
    limit[q, shard] = most
    order = np.argsort(-limit, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
    done, floor, found, size = 0, np.zeros(n_queries, np.int64), None, FIRST
    made = 0
    while True:
        visits = (limit > 0) & (limit >= floor[:, None]) & (place >= done) & (place < done + size)
        if not ((limit > 0) & (limit >= floor[:, None]) & (place >= done)).any():
            break
        made += int(visits.sum())
        new = visited(index, weights, pairs, visits, floor)
        found = materialize(best(new if found is None else new.unionByName(found.select("q", "doc_id", "score"))), "lexical-best")
        for r in found.where(F.col("rank") == TOP).select("q", "score").collect():
            floor[r["q"]] = r["score"]
        done, size = done + size, size * MORE
    if counts is not None:
        counts.append((made, int((limit > 0).sum())))
    return none if found is None else found


def search(docs: DataFrame, items: DataFrame, counts: list | None = None) -> DataFrame:
    """Per item: item_id, rank, doc_id and score of its ten best documents."""
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("item"), "item_id", terms_of(F.col("text")).alias("terms")), "lexical-items")
    asked = numbered.select("item", F.explode("terms").alias("term"))
    size = asked.agg(F.count_distinct("item").alias("items"), F.count("*").alias("pairs")).first()
    blocks = max(1, -(-size["items"] // ITEMS), -(-size["pairs"] // PAIRS))
    names, out = numbered.select("item", "item_id"), None
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "term").collect()
        number = {item: q for q, item in enumerate(sorted({r["item"] for r in own}))}
        found = of_block(docs, [(number[r["item"]], r["term"]) for r in own], counts)
        back = docs.sparkSession.createDataFrame([(q, item) for item, q in number.items()], "q int, item long")
        found = found.join(F.broadcast(back), "q").join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
