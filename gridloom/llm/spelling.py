r"""Spelling variants: words at one edit of each other, by errata-trie merging.

Words.  Tasks count the runs of letters of their texts in a table of at most
``HELD`` words and hand it on; Spark sums the counts.

Near words.  Two words are near if they differ by one inserted, deleted or
replaced code point.  Their longest common prefix p is where they part, and
the node at which their paths in a trie of all words do.  At every branching node
the heaviest subtree stays as it is, and the words of the light subtrees are merged into
the errata of that node: with the character after the node replaced, with it skipped, and with the heavy
character put before it.  Terminals that coincide are near: replaced ones with
each other and with the heavy subtree's, skipped ones with any word of the node, those with
the heavy character with the heavy subtree's.  A word is in a light subtree of at most log2(words)
nodes (small to large), and each pair is found at its node p alone, so nothing is counted twice.

Dealing out.  One trie of all words would be one task.  A pair's shorter word
has a length n, the *base* of both.  The places 0..n are cut into segments; two words
that part in a segment are alike before it, and alike after it (counted from the end).  So
a word goes, for its own length and for one less as base, to one group for each of
``SEGMENTS`` segments, named by what stands before and after; a
group's trie reports only pairs that part within its segment.  Groups of more than ``MOST``
words have their segments cut again; a segment of one place, with some thousand words at
most, isn't cut.  So no task holds more than such a group, and no pair is lost.

Tasks report for each word the number of near words and the best of them, so
pairs are never rows (``near_pairs`` lists them on request).  Roots are found by
pointer doubling among words whose form has a form.

Defined results: null and empty texts have no words; a null doc_id is the empty string before
the colon; very long texts and words are taken whole; repeated rows count
each; ties of forms go to the first word in code-point order; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, met, salt

LENGTH, COUNT, SHARE, RATIO = 5, 3, 97, 2
#: Words that a task counts before it hands its table on.
HELD = 200_000
SEGMENTS, MOST = 2, 100_000
RUN = re.compile("[a-zÀ-ÿ]+")


def counted(docs: DataFrame, length: int = LENGTH, least: int = COUNT) -> DataFrame:
    """Written rows of word and n: the words of a length and number of occurrences, one in ``SHARE`` misspelt as the contract of ``op11`` says."""
    bounded_batches(docs.sparkSession)

    def table(known: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.string()), pa.array(known.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                start = zlib.crc32(name.encode() + b":")
                runs = RUN.findall(text.as_py().lower().decode(errors="replace"))
                for word, n in Counter(w for w in runs if len(w) >= length).items():
                    mark = zlib.crc32(word.encode(), start)
                    if mark % SHARE == 0:
                        k = mark % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < length:
                            continue
                    known[word] += n
                if len(known) > HELD:
                    yield table(known)
                    known = Counter()
        yield table(known)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    found = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(found.where(F.col("n") >= least), "spelling-words")


def cut(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of word, n, base and a segment (a, b), dealt to the groups of ``parts`` segments within it."""
    edge = lambda k: F.col("a") + F.floor((F.col("b") - F.col("a")) * k / parts).cast("int")
    own = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(edge(k).alias("a"), edge(k + 1).alias("b"))), lambda s: s["a"] < s["b"]))
    rows = rows.select("word", "n", "base", own.alias("s")).select("word", "n", "base", "s.*")
    before, after = F.expr("substring(word, 1, a)"), F.expr("substring(word, length(word) - (base - b) + 1)")
    return rows.withColumn("group", F.xxhash64("base", "a", "b", before, after))


def groups(words: DataFrame, most: int = MOST) -> DataFrame:
    """(group, base, a, b, word, n): each word in the groups in which it meets its near words."""
    base = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("base")
    # places 0..base: a word can part from a longer one at its end
    rows = cut(words.select("word", "n", base).where("base > 0").select("*", F.lit(0).alias("a"), (F.col("base") + 1).alias("b")), SEGMENTS)
    ready = None
    while True:
        large = rows.where("b - a > 1").groupBy("group").agg(F.count("*").alias("rows")).where(F.col("rows") > most)
        large = materialize(large.select("group"), "spelling-large")
        if large.isEmpty():
            return rows if ready is None else ready.unionByName(rows)
        # the rows of a large group are dealt by (group, piece)
        dealt = rows.withColumn("piece", salt(F.col("word")))
        marked = materialize(met(dealt, large.withColumn("is_large", F.lit(True)), ["group"], "piece", "left"), "spelling-groups")
        small = marked.where("is_large is null").select("group", "base", "a", "b", "word", "n")
        ready = small if ready is None else ready.unionByName(small)
        rows = cut(marked.where("is_large"), 4)


def branches(words: list[str], low: int, high: int) -> tuple[int, list[tuple[int, int]]]:
    """The branching node of a range of sorted words: its depth, and the ranges of its children (a word that ends there is in none)."""
    first, last = words[low], words[high - 1]
    depth, end = 0, min(len(first), len(last))
    while depth < end and first[depth] == last[depth]:
        depth += 1
    out, at = [], low + (len(first) == depth)
    while at < high:
        stop = bisect_left(words, words[at][:depth] + chr(ord(words[at][depth]) + 1), at, high)
        out.append((at, stop))
        at = stop
    return depth, out


def coinciding(words: list[str], base: int, a: int, b: int) -> Iterator[list[int] | tuple[int, int]]:
    """Of a group's sorted words, of ``base`` code points or one more: lists of words that are all near each other, and pairs, that part in a..b-1."""
    terminal = {w: k for k, w in enumerate(words)}
    todo = [(0, len(words))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        depth, children = branches(words, low, high)
        if depth >= b:
            continue
        todo += children
        if depth < a:
            continue
        heavy = max(children, key=lambda c: c[1] - c[0])
        x = words[low][:depth]
        over, errata = x + words[heavy[0]][depth], {}
        light = [k for c in children if c is not heavy for k in range(*c)]
        if len(words[low]) == depth:
            light.append(low)  # it ends at the node
        for k in light:
            w = words[k]
            if len(w) == base:
                if depth < base:
                    errata.setdefault(w[depth + 1 :], []).append(k)
                longer = terminal.get(over + w[depth:])
                if longer is not None:
                    yield k, longer
            elif w[depth + 1 : depth + 2] != w[depth]:  # else they part later
                shorter = terminal.get(x + w[depth + 1 :])
                if shorter is not None:
                    yield k, shorter
        for rest, some in errata.items():
            same = terminal.get(over + rest)
            if same is not None:
                some.append(same)
            if len(some) > 1:
                yield some


def whole_groups(reported: Callable, names: list[str]) -> Callable:
    """A function for mapInArrow over rows of group, base, a, b, word, n that are sorted by group, base, a, b and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def of(table: pa.Table) -> pa.RecordBatch:
            keys = np.stack([table.column(k).to_numpy() for k in range(4)], axis=1)
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            sizes = np.diff(np.append(starts, len(keys)))
            out: list[tuple] = []
            some = sizes > 1
            for at, size in zip(starts[some].tolist(), sizes[some].tolist()):
                part = table.slice(at, size)
                base, a, b = keys[at, 1:].tolist()
                out += reported(part.column(4).to_pylist(), part.column(5).to_pylist(), base, a, b)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names) if out else None

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.slice(batch.num_rows - 1).columns[:4]
            if batch.slice(0, 1).columns[:4] == last and (not kept or kept[0].slice(0, 1).columns[:4] == last):
                kept.append(batch)
                continue
            table = pa.Table.from_batches([*kept, batch])
            ends = np.stack([table.column(k).to_numpy() for k in range(4)], axis=1)
            border = int(np.flatnonzero((ends != ends[-1]).any(axis=1))[-1]) + 1
            kept = table.slice(border).combine_chunks().to_batches()
            if (found := of(table.slice(0, border).combine_chunks())) is not None:
                yield found
        if kept and (found := of(pa.Table.from_batches(kept).combine_chunks())) is not None:
            yield found

    return run


def dealt(words: DataFrame, most: int) -> DataFrame:
    rows = groups(words, most).select("group", *[F.col(c).cast("long").alias(c) for c in ("base", "a", "b")], "word", "n")
    return rows.repartition("group").sortWithinPartitions("group", "base", "a", "b", "word")


def near(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best_n, best): of the words that have near words, how many, and the one of largest n, then first in code-point order. words: distinct words and n."""

    def reported(some: list[str], n: list[int], base: int, a: int, b: int) -> list[tuple]:
        count, best = [0] * len(some), [None] * len(some)
        rank = lambda k: (-n[k], some[k])

        def meet(k: int, other: int, more: int) -> None:
            count[k] += more
            if best[k] is None or rank(other) < rank(best[k]):
                best[k] = other

        for near in coinciding(some, base, a, b):
            if len(near) == 2:
                meet(near[0], near[1], 1)
                meet(near[1], near[0], 1)
                continue
            first, second = sorted(near, key=rank)[:2]
            for k in near:
                meet(k, second if k == first else first, len(near) - 1)
        return [(some[k], count[k], n[best[k]], some[best[k]]) for k in range(len(some)) if count[k]]

    found = dealt(words, most).mapInArrow(whole_groups(reported, ["word", "n_near", "best_n", "best"]), "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return found.select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): all pairs of near words, each once, a before b. words: distinct words and n."""

    def reported(some: list[str], n: list[int], base: int, a: int, b: int) -> list[tuple]:
        return [(some[min(i, j)], some[max(i, j)]) for near in coinciding(some, base, a, b) for k, i in enumerate(near) for j in near[k + 1 :]]

    return dealt(words, most).mapInArrow(whole_groups(reported, ["a", "b"]), "a string, b string")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling. forms: words and their forms, without circles.

    A round joins those whose target has a form itself; the others have their root and stay behind.
    """
    ready, open_ = None, materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    step = open_  # all words that have a form, as far as they have come
    while True:
        rows = open_.withColumn("piece", salt(F.col("word")))
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(met(rows, ahead, ["root"], "piece", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "spelling-roots")
        done = moved.where("not open").select("word", "root")
        ready = done if ready is None else ready.unionByName(done)
        open_ = moved.where("open").select("word", "root")
        if open_.isEmpty():
            return ready
        step = ready.unionByName(open_)


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n. A word's form is its near word of largest n, if that is ``ratio`` times its own at least (2 or more, so forms lead upwards)."""
    found = words.join(near(words, most), "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = rooted(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of documents with their near words, forms and roots."""
    return variants(counted(docs))
