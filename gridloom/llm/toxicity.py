"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are counts of words (ASCII letters without case, punctuation as white
space) and of word beginnings, as log(1 + count).  One weight vector serves all
grades: with ordered thresholds t1 < t2 < t3,

    P(grade <= k) = 1 / (1 + exp(score - t(k+1))),

so P(grade = k) is a difference of two such values, and the expected severity
is the sum of k * P(grade = k).  Features are those whose presence tells toxic rows from others by a likelihood ratio; weights are
fitted with an L1 and a small L2 penalty (accelerated proximal gradient steps)
and keep the sign of their feature's association.

Grades.  Labels say toxic or not.  Grade 0 is not toxic; toxic rows are graded
1 to 3 by the thirds of their amount of markers, which are features that are at
least ``MARKER`` times as frequent among toxic rows as among others.

The fit uses at most ``SAMPLE`` labelled rows with distinct texts, those with
the smallest hash of doc_id; their ids are broadcast (a proven bound), so texts
of other rows aren't moved.  Features are counted and chosen in tasks; the driver gets
those that tell or mark, and the sampled rows' counts of them, never texts.  All documents are scored, in whole, by mapping
partitions: no shuffle, memory bounded by a batch and the non-zero weights.

Defined results: null and empty texts have no features; labels that are null or
lack a document are not used, and of a document's several labels the largest
counts, as does of several rows of an id the smallest text for the fit;
without a toxic or without another label nothing is toxic and all
severities are 0; repeated rows are scored alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

SAMPLE, MARKER, GRADES, GAIN, TOXIC_SHARE = 6000, 8.0, 4, 25.0, 0.25
#: Words in fewer sampled texts are no features.
LEAST_TEXTS = 4
STEPS, PENALTY, RIDGE = 600, 3e-4, 3e-3
#: Lengths in bytes of the word beginnings that are features: stems carry meaning where endings vary.
PREFIXES = (5, 6, 7, 8)
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))


def features(text: bytes) -> Counter:
    """Counts of a text's words and of their prefixes (``prefix*``)."""
    held = Counter(text.translate(PLAIN).split())
    out = Counter(held)
    for w, n in held.items():
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + b"*"] += n
    return out


@dataclass
class Model:
    weights: dict[bytes, float]
    thresholds: np.ndarray

    def __post_init__(self):
        self.stems = {f[:-1] for f in self.weights if f.endswith(b"*")}

    def score(self, text: bytes) -> float:
        get, found = self.weights, Counter()
        for w, n in Counter(text.translate(PLAIN).split()).items():
            if w in get:
                found[w] += n
            for k in PREFIXES:
                if (x := w[:k]) in self.stems and len(w) > k:
                    found[x + b"*"] += n
        return float(sum(get[f] * np.log1p(n) for f, n in sorted(found.items())))

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade = k) by row and grade."""
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None], -50, 50)))
        return np.diff(np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))]))


def marked(among: Counter, other: Counter, n: float, m: float) -> set[bytes]:
    """Markers, from in how many of n toxic and m other rows each feature is."""
    return {f for f, k in among.items() if k >= LEAST_TEXTS and (k / n) / ((other[f] + 0.5) / m) >= MARKER}


def grades(amount: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for rows that aren't toxic, 1 to 3 by thirds of their amount of markers for those that are."""
    cuts = np.quantile(amount[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (amount[:, None] > cuts[None]).sum(axis=1), 0)


def gather_squares(columns: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(np.bincount(columns, values**2 * weights, minlength=n), 1e-6)


def telling(among: Counter, other: Counter, n: float, m: float) -> tuple[list[bytes], np.ndarray]:
    """Features whose presence tells toxic rows from others, by a likelihood ratio of GAIN or more, and for which of the two they speak."""
    names = sorted(w for w in among.keys() | other.keys() if among[w] + other[w] >= LEAST_TEXTS)
    a, b = np.array([among[w] for w in names], float), np.array([other[w] for w in names], float)
    cells = [(a, n, a + b), (b, m, a + b), (n - a, n, n + m - a - b), (m - b, m, n + m - a - b)]
    gain = 2 * sum(x * np.log(np.maximum(x, 1e-9) * (n + m) / np.maximum(row * column, 1e-9)) for x, row, column in cells)
    kept = np.flatnonzero(gain >= GAIN)
    return [names[k] for k in kept], np.where(a * m > b * n, 1.0, -1.0)[kept]


def fit(texts: list[bytes], toxic: list[int]) -> Model:
    """The regression from labelled texts at hand; repeated texts count once, with their first label."""
    once: dict[bytes, int] = {}
    for t, x in zip(texts, toxic):
        once.setdefault(t, x)
    texts, marks = list(once), np.array(list(once.values()), bool)
    n, m = float(marks.sum()), float(len(marks) - marks.sum())
    if not n or not m:
        return nothing()
    among, other = Counter(), Counter()
    for t, mark in zip(texts, marks):
        (among if mark else other).update(features(t).keys())
    names, signs = telling(among, other, n, m)
    index, markers = {f: k for k, f in enumerate(names)}, marked(among, other, n, m)
    return regression(names, signs, marks, *zip(*(described(t, index, markers) for t in texts)))


def nothing() -> Model:
    """Nothing is toxic."""
    return Model({}, np.array([40.0, 41.0, 42.0]))


def described(text: bytes, index: dict[bytes, int], markers: set[bytes]) -> tuple[float, list[int], list[int]]:
    """A text's amount of markers, and its features of the index with their counts."""
    own = features(text)
    found = sorted((index[f], k) for f, k in own.items() if f in index)
    return sum(np.log1p(k) for f, k in sorted(own.items()) if f in markers), [f for f, _ in found], [k for _, k in found]


def regression(names: list[bytes], signs: np.ndarray, marks: np.ndarray, amounts: tuple, features_: tuple, counts: tuple) -> Model:
    """The fit to rows of features and counts; ``names`` and ``signs`` of the features, ``marks`` and ``amounts`` of the rows."""
    index, amount = names, np.array(amounts, np.float64)
    rows = np.repeat(np.arange(len(marks)), list(map(len, features_)))
    columns = np.array([f for own in features_ for f in own], np.int64)
    values = np.array([k for own in counts for k in own], np.float64)
    y = grades(amount, marks)
    values = np.log1p(values)
    if not len(rows):
        return nothing()
    size = np.array([max(1, (y == k).sum()) for k in range(GRADES)])
    share = np.where(y == 0, (1 - TOXIC_SHARE) / size[0], TOXIC_SHARE / size[1:].sum())
    score = lambda w: np.bincount(rows, values * w[columns], minlength=len(y))
    gather = lambda x: np.bincount(columns, values * x[rows], minlength=len(index))
    spread = np.sqrt(gather_squares(columns, values, share[rows], len(index)))
    values = values / spread[columns]
    v = np.ones(len(index))
    for _ in range(30):  # the largest curvature, by power iteration
        v = gather(share * score(v / np.linalg.norm(v)))
    step = 1 / (0.5 * np.linalg.norm(v) + 1e-9)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    w, t, before = np.zeros(len(index)), np.array([1.0, 2.0, 3.0]), np.zeros(len(index))
    for k in range(1, STEPS + 1):
        ahead = w + (k - 1) / (k + 2) * (w - before)
        before = w
        s = score(ahead)
        ends = np.concatenate(([-60.0], t, [60.0]))
        low, high = sigmoid(ends[y] - s), sigmoid(ends[y + 1] - s)
        p = np.maximum(high - low, 1e-9)
        # high + low - 1 is the slope of log P(grade) in the score
        w = (ahead + step * gather(share * (high + low - 1))) / (1 + step * RIDGE)
        w = signs * np.maximum(signs * w - step * PENALTY, 0)  # a feature's weight has the sign of its association
        up, down = share * high * (1 - high) / p, share * low * (1 - low) / p
        g = np.array([up[y == j].sum() - down[y == j + 1].sum() for j in range(GRADES - 1)])
        t = np.maximum.accumulate(t + np.clip(g, -0.25, 0.25) * 2)
    return Model({names[k]: float(w[k] / spread[k]) for k in np.flatnonzero(np.abs(w) > 1e-6)}, t)


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Written rows of doc_id, text and toxic: the distinct texts of the sampled ids, with the first id and its label."""
    rated = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("__toxic").alias("__toxic"))  # a text per sampled id
    first = F.min(F.struct("doc_id", "__toxic"))
    found = rows.groupBy("text").agg(first.alias("first")).select("first.doc_id", "text", (F.col("first.__toxic").cast("int") != 0).alias("toxic"))
    return materialize(found.coalesce(16), "toxicity-sample")  # 6000 rows at most: few files


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """``fit`` of a sample whose texts stay in the tasks: what comes to the driver are the features that tell, and the rows' counts of them."""
    rows = sampled(docs, labels, most)
    size = rows.agg(F.count_if("toxic").alias("n"), F.count_if(~F.col("toxic")).alias("m")).first()
    n, m = float(size["n"]), float(size["m"])
    if not n or not m:
        return nothing()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                names = list(features(text))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([toxic] * len(names), pa.bool_())], names=["feature", "toxic"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            among, other = (Counter(dict(zip(batch.column(0).to_pylist(), batch.column(k).to_pylist()))) for k in (1, 2))
            names, signs = telling(among, other, n, m)
            signed, marks = dict(zip(names, signs.tolist())), marked(among, other, n, m)
            both = sorted(signed.keys() | marks)
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), pa.array([signed.get(f) for f in both], pa.float64()), pa.array([f in marks for f in both], pa.bool_())], names=["feature", "sign", "marker"])

    counts = rows.select("text", "toxic").mapInArrow(held, "feature binary, toxic boolean").groupBy("feature").agg(F.count_if("toxic").alias("among"), F.count_if(~F.col("toxic")).alias("other"))
    counts = counts.where(F.col("among") + F.col("other") >= LEAST_TEXTS).select("feature", "among", "other")
    told = sorted((bytes(r["feature"]), r["sign"], r["marker"]) for r in counts.mapInArrow(chosen, "feature binary, sign double, marker boolean").collect())
    names = [f for f, sign, _ in told if sign is not None]
    index, markers = {f: k for k, f in enumerate(names)}, {f for f, _, marker in told if marker}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [described(t, index, markers) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _, _ in found], pa.float64()), pa.array([f for _, f, _ in found], ints), pa.array([k for _, _, k in found], ints)], names=["doc_id", "toxic", "amount", "features", "counts"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    table = rows.select("doc_id", "toxic", "text").mapInArrow(rows_of, f"doc_id {kind}, toxic boolean, amount double, features array<long>, counts array<long>").toArrow().sort_by("doc_id")
    signs = np.array([sign for _, sign, _ in told if sign is not None])
    return regression(names, signs, table.column("toxic").to_numpy(), *(tuple(table.column(c).to_pylist()) for c in ("amount", "features", "counts")))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, expected_severity (0 to 3), grade (the likeliest), p_toxic and toxic (p_toxic of 0.5 or more)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(sample(docs, labels, most))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = model.chances(np.array([model.score(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.float64))
            severity, toxic = p @ np.arange(GRADES), 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(severity), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= 0.5)],
                names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    schema = f"doc_id {kind}, expected_severity double, grade int, p_toxic double, toxic boolean"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
