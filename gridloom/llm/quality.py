r"""Quality rules: base counts, and perplexity bands of a modified Kneser-Ney model.

Symbols.  A code point below 3072 (Latin, Greek, Cyrillic, Arabic, Indic
letters, with case, digits and punctuation each for itself) is its own symbol; others
(CJK and beyond) share 1024 more by a hash.  A symbol has 12 bits, so an n-gram
of ``ORDER`` symbols is a 60-bit number; that is what is counted, sorted and
looked up.

Counts.  Tasks count the n-grams of their texts' symbols per language; Spark
sums them per (language, n-gram).  Copies of a text count once per language,
here and in the quartiles.  Nothing is pruned: the tables grow with the corpus.

Model.  Modified Kneser-Ney, interpolated down to the uniform distribution:
raw counts at the highest order, continuation counts below, three discounts per
language and order from the counts of counts.  All of it is Spark aggregations
and joins on (language, order, n-gram), and the result is written as sorted arrays
of n-grams with their bits (-log2 of the probability), in ranges.  Every language
has a model and a band of its own.

Scoring.  The model is never broadcast or collected.  Texts are dealt to parts
of about ``PART`` characters; a part's distinct n-grams fetch their bits from the
model by a join, and come back to the part as sorted arrays, in which its texts
(of one language) look theirs up by binary search.  Since the model counts all texts, every
n-gram is found.

Verdict.  A document's perplexity per symbol (in bits) must lie in its
language's band: the quartiles of the language's distinct texts that pass the
base rules, ``FENCE`` interquartile ranges (at least ``NARROW`` bits each)
below and above.

A part holds its texts and its distinct n-grams, whatever the corpus; texts are
shuffled once, to their parts, and those that have copies once more to take one
of each, combined map-side.

Defined results: null and empty texts have no words and fail; a null language
is one named ''; repeated rows are judged alike, each in its row; very long texts
are taken whole (the part with one is larger); an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, bounded_batches, discard, materialize, salt
from .filters import distinct_rows, keep_decided

ORDER, BITS, OWN, PART = 5, 12, 3072, 32 << 20
SYMBOLS = 1 << BITS
LEAST_WORDS, MOST_REPEATED = 50, 50
FENCE, NARROW = 3.0, 0.02
#: What counts as a symbol character, and as white space.
MARKS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Slots of the table in which a task counts, and characters that are coded at once.
TABLE, CHUNK = 1 << 21, 1 << 21


def symbols(text: bytes) -> np.ndarray:
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < OWN, points, OWN + ((points * 2654435761) >> 7) % (SYMBOLS - OWN))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that end at each code point of the texts, and where each text's begin. A text is preceded by spaces."""
    pad = b" " * (ORDER - 1)
    s = symbols(pad + pad.join(texts) if texts else pad)
    n = max(0, len(s) - ORDER + 1)
    codes = np.zeros(n, np.int64)
    for k in range(ORDER):
        codes = (codes << BITS) | s[k : k + n]
    sizes = np.fromiter((len(t.decode("utf-8", "replace")) for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + ORDER - 1)[:-1])) if len(texts) else sizes
    if len(texts) > 1:
        inside = np.ones(n, bool)
        for k in range(ORDER - 1):
            inside[begins[1:] - 1 - k] = False
        codes = codes[inside]
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return codes, begins


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Whole texts in lists of about CHUNK bytes, with the place of the first."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts: most find a slot of a table to themselves, the others are sorted."""
    if len(codes) < TABLE // 8:
        return np.unique(codes, return_counts=True)
    at = (codes * np.int64(-7046029254386353131)) >> np.int64(64 - 21) & np.int64(TABLE - 1)
    owner = np.full(TABLE, -1, np.int64)
    owner[at] = codes
    own = owner[at] == codes
    n = np.bincount(at[own], minlength=TABLE)
    held = np.flatnonzero(n)
    rest, more = np.unique(codes[~own], return_counts=True)
    return np.concatenate((owner[held], rest)), np.concatenate((n[held], more))


class Counts:
    """Counts of codes by slot, in two arrays that are merged when they have doubled."""

    def __init__(self):
        self.kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.waiting: dict[str, int] = {}

    def add(self, slot: str, codes: np.ndarray) -> None:
        found = counted(codes)
        kept = self.kept.setdefault(slot, [])
        kept.append(found)
        self.waiting[slot] = self.waiting.get(slot, 0) + len(found[0])
        if self.waiting[slot] > 2 * len(kept[0][0]) + TABLE:
            self.kept[slot], self.waiting[slot] = [self.merged(slot)], 0

    def merged(self, slot: str) -> tuple[np.ndarray, np.ndarray]:
        kept = self.kept[slot]
        codes, back = np.unique(np.concatenate([c for c, _ in kept]), return_inverse=True)
        return codes, np.bincount(back, np.concatenate([n for _, n in kept]), len(codes)).astype(np.int64)


def slotted(docs: DataFrame) -> DataFrame:
    """doc_id, text, the document's language as its slot, and a hash of text and language."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("slot"), F.xxhash64("text", "lang").alias("hash"))


def by_slot(slots: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Each slot of a batch and the places of its rows."""
    coded = (slots.combine_chunks() if isinstance(slots, pa.ChunkedArray) else slots).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    for k, slot in enumerate(coded.dictionary.to_pylist()):
        yield slot, np.flatnonzero(codes == k)


def count_grams(rows: DataFrame) -> DataFrame:
    """(slot, gram, n) over the rows of (text, slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for slot, own in by_slot(batch.column(1)):
                for _, some in chunks(texts.take(pa.array(own)).to_pylist()):
                    counts.add(slot, grams(some)[0])
        for slot in counts.kept:
            codes, n = counts.merged(slot)
            for k in range(0, len(codes), TABLE):
                some = slice(k, k + TABLE)
                yield pa.RecordBatch.from_arrays([pa.repeat(slot, len(codes[some])), pa.array(codes[some]), pa.array(n[some])], names=["slot", "gram", "n"])

    return rows.select("text", "slot").mapInArrow(run, "slot string, gram long, n long").groupBy("slot", "gram").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> DataFrame:
    """(slot, gram, bits): modified Kneser-Ney from (slot, gram, n), in sorted ranges."""
    counts = materialize(counts, "quality-counts")
    low = lambda g, k: g.bitwiseAND(F.lit((1 << (BITS * k)) - 1))  # noqa: E731  the last k symbols
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), low(F.col("gram"), k).alias("gram"), low(F.col("gram"), k + 1).alias("longer")) for k in range(1, ORDER)]))
    below = counts.select("slot", steps.alias("s")).select("slot", "s.*").distinct().groupBy("slot", "k", "gram").agg(F.count("*").alias("n"))
    every = materialize(below.unionByName(counts.select("slot", F.lit(ORDER).alias("k"), "gram", "n")), "quality-levels")
    # discounts of counts of 1, 2, 3 or more (Chen and Goodman), within [0, count]
    few = every.groupBy("slot", "k").agg(*[F.count_if(F.col("n") == j).cast("double").alias(f"n{j}") for j in range(1, 5)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    all_known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    cut = lambda j, otherwise, most: F.when(all_known, F.greatest(F.lit(0.05), F.least(F.lit(most), j - (j + 1) * y * F.col(f"n{j + 1}") / F.col(f"n{j}")))).otherwise(F.lit(otherwise)).alias(f"d{j}")
    few = materialize(few.select("slot", "k", cut(1, 0.5, 0.95), cut(2, 0.75, 1.9), cut(3, 0.9, 2.85)), "quality-discounts")
    cut_of = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    levels = every.join(few, ["slot", "k"]).select("slot", "k", "gram", "n", cut_of.alias("d"), F.shiftright("gram", BITS).alias("context"))
    contexts = levels.groupBy("slot", "k", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("free"))
    nodes = levels.join(contexts, ["slot", "k", "context"])
    nodes = materialize(nodes.select("slot", "k", "gram", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("own"), (F.col("free") / F.col("total")).alias("weight")), "quality-nodes")
    p = nodes.where("k = 1").select("slot", "gram", (F.col("own") + F.col("weight") / SYMBOLS).alias("p"))
    for k in range(2, ORDER + 1):
        shorter = p.select("slot", F.col("gram").alias("suffix"), F.col("p").alias("p_below"))
        p = nodes.where(F.col("k") == k).withColumn("suffix", low(F.col("gram"), k - 1)).join(shorter, ["slot", "suffix"])
        p = p.select("slot", "gram", (F.col("own") + F.col("weight") * F.col("p_below")).alias("p"))
    found = p.select("slot", "gram", (-F.log2("p")).cast("float").alias("bits"))
    found = materialize(found.repartitionByRange("slot", "gram").sortWithinPartitions("slot", "gram"), "quality-model")
    discard(counts, every, nodes)
    return found


def repeated(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter([ids.setdefault(x, len(ids)) for x in words], np.int64, len(words))
    key = w[:n]
    for k in range(1, width):
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + w[k : n + k]
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    inside = np.zeros(len(words), bool)
    for k in range(width):
        inside[k : n + k] |= twice
    return int(inside.sum())


def base_counts(text: bytes, chars: int) -> tuple[int, int, int, int, int]:
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    blank = len(text) - len(text.translate(None, SPACES))
    return len(words), chars - blank, len(text) - len(text.translate(None, MARKS)), dup, repeated(words)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(texts: pa.Table, fetched: pa.Table) -> pa.Table:
    """doc_id, slot, the base counts, perplexity (bits per symbol; null without text) and hash of a part's rows, with the bits of its n-grams."""
    keys, values = (fetched.column(c).to_numpy() for c in ("gram", "bits"))
    order = np.argsort(keys)
    keys, values = keys[order], values[order].astype(np.float64)
    column, sizes = texts.column("text"), pc.utf8_length(texts.column("text")).to_numpy()
    counts, bits = np.zeros((len(sizes), len(MEASURES)), np.int64), np.full(len(sizes), np.nan)
    at, stops = 0, np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
    for stop in [*stops.tolist(), len(sizes)]:
        some = column.slice(at, stop - at).cast(pa.binary()).to_pylist()
        for k, t in enumerate(some, at):
            counts[k] = base_counts(t, int(sizes[k]))
        own = np.flatnonzero(sizes[at:stop])
        if len(own):
            codes, begins = grams([some[k] for k in own.tolist()])
            sums = np.add.reduceat(values[np.searchsorted(keys, codes)], begins)
            bits[at + own] = sums / sizes[at:stop][own]
        at = stop
    columns = {"doc_id": texts.column("doc_id"), "slot": texts.column("slot"), **{m: pa.array(counts[:, k]) for k, m in enumerate(MEASURES)}}
    return pa.table({**columns, "perplexity": pa.array(bits, mask=np.isnan(bits)), "hash": texts.column("hash")})


def measure(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """What is measured of each row of ``slotted``, by the model of the corpus that holds the rows; a part has texts of one language."""
    chars = rows.groupBy("slot").agg(F.sum(F.length("text")).alias("n"))
    sizes = materialize(chars.select("slot", F.greatest(F.lit(1), F.ceil(F.col("n") / PART)).alias("pieces")), "quality-sizes")
    parts = int(sizes.agg(F.sum("pieces")).first()[0] or 1)
    wide = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", salt(F.col("hash"), F.col("doc_id"))).join(wide, ["slot", "salt"])
    dealt = dealt.select("doc_id", "text", "slot", "hash", F.pmod(F.xxhash64("hash", "doc_id"), F.col("pieces")).cast("int").alias("piece")).repartition(parts, "slot", "piece")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            texts, piece = batch.column("text").cast(pa.binary()), batch.column("piece").to_numpy()
            for slot, own in by_slot(batch.column("slot")):
                for p in np.unique(piece[own]).tolist():
                    for _, some in chunks(texts.take(pa.array(own[piece[own] == p])).to_pylist()):
                        counts.add((slot, p), grams(some)[0])
        for slot, p in counts.kept:
            codes, _ = counts.merged((slot, p))
            for k in range(0, len(codes), TABLE):
                some = codes[k : k + TABLE]
                yield pa.RecordBatch.from_arrays([pa.repeat(slot, len(some)), pa.array(np.full(len(some), p, np.int32)), pa.array(some)], names=["slot", "piece", "gram"])

    fetched = dealt.mapInArrow(distinct, "slot string, piece int, gram long").join(bits, ["slot", "gram"])
    form = f"doc_id {kind}, slot string, " + "".join(f"{m} long, " for m in MEASURES) + "perplexity double, hash long"
    return dealt.groupBy("slot", "piece").cogroup(fetched.groupBy("slot", "piece")).applyInArrow(scored, form)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bands(measured: DataFrame, fence: float = FENCE) -> DataFrame:
    """Per slot: low and high. Quartiles are exact over rounded perplexities, of which there are a few thousand per slot, so reruns agree."""
    passed = measured.where(~base_failed()).groupBy("slot", F.round("perplexity", 3).alias("bits")).agg(F.count("*").alias("n"))
    found = passed.groupBy("slot").agg(F.percentile("bits", [0.25, 0.75], F.col("n")).alias("q"))
    reach = fence * F.greatest(F.get("q", F.lit(1)) - F.get("q", F.lit(0)), F.lit(NARROW))
    return found.select("slot", (F.get("q", F.lit(0)) - reach).alias("low"), (F.get("q", F.lit(1)) + reach).alias("high"))


def once(measured: DataFrame) -> DataFrame:
    """One row per distinct text of a language; copies are measured alike."""
    return measured.dropDuplicates(["slot", "hash"])


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept. The bands have a row per language; whether to broadcast them is left to Spark's size check."""
    inside = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    rows = measured.join(limits, "slot", "left").withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & inside)


def judgements(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """Per document: what was measured, the verdict and the hash."""
    bounded_batches(docs.sparkSession)
    rows = slotted(docs)
    bits = model(count_grams(distinct_rows(rows.select("text", "slot"), "quality-hashes")))
    measured = measure(rows, bits)
    measured = materialize(measured, "quality")
    limits = materialize(bands(once(measured), fence), "bands")
    return judged(measured, limits)


def quality(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """Per document: doc_id, the base counts, perplexity, base_failed, kept."""
    return judgements(docs, fence).select("doc_id", *MEASURES, "base_failed", "kept", "perplexity")


def keep_good(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Verdicts depend on text and language only, so rows are matched on doc_id and a hash of both."""
    decided = judgements(docs, fence).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("__id"), F.xxhash64("text", "lang").alias("__hash"))
    return keep_decided(rows, decided, ["__id", "__hash"], unique=False).select("row.*")
