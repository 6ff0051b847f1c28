"""The training split of an external pair collection: packed conversations, their token records and statistics.

A task has many pairs and one stream of offers: its pairs in a cycle, each
under a drawn symmetry and colour mapping.  Variants take offers in turn until they
are full or the next one doesn't fit.  Whether it fits is a matter of tokens, and a
tokenizer's lengths don't add up: what joins at a seam may become other tokens.  So
the conversation itself grows, and its ids with it: ids of text that nothing after it can
change are kept, and only the rest is encoded again with each offer.

Everything about a task follows from its own pairs and the seed, so tasks are dealt
over the cluster and a lost one is made again.  Symmetries and grid texts are
made in the JVM; the kernel draws, joins texts and encodes.  Target spans are found among the ids where these are made.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chat, grids
from ..functions.tokens import Tokenizer, flat_ids, spans_finder
from . import variants

#: Tasks whose records a Python worker hands over together.
AT_ONCE = 64
PLACE = {code: k for k, code in enumerate(grids.CODES)}
TAKEN = "array<struct<source_index:int,transformation_code:string,value_mapping:string>>"
#: The same as Arrow's fields, and those of a record.
FIELDS = {
    "pair_augmentations": [pa.field("source_index", pa.int32()), pa.field("transformation_code", pa.string()), pa.field("value_mapping", pa.string())],
    "assistant_spans": [pa.field("start", pa.int32()), pa.field("end", pa.int32())],
}
SCHEMA = pa.schema([
    ("task_id", pa.string()), ("place", pa.int32()), ("variant_id", pa.string()), ("input_ids", pa.list_(pa.int32())), ("pair_augmentations", pa.list_(pa.struct(FIELDS["pair_augmentations"]))), ("source_pairs", pa.int32()),
    ("skipped", pa.int32()), ("status", pa.string()), ("sequence_length", pa.int32()), ("n_pairs", pa.int32()), ("assistant_spans", pa.list_(pa.struct(FIELDS["assistant_spans"]))),
])


class Growing:
    """The ids of a text that grows by parts; ``offered`` tries a part, ``take`` keeps it."""

    def __init__(self, tokenizer: Any):
        self.encode = lambda text: flat_ids(tokenizer.encode(text))
        #: How many characters of a text have ids that nothing after it changes; without this, all is encoded each time.
        self.settled = getattr(tokenizer, "settled", lambda text: 0)
        #: All of this at once, by a tokenizer that can: ids of what is settled and of the rest, and where that begins.
        self.pieced = getattr(tokenizer, "pieced", None)
        self.kept: list[int] = []
        self.last: list[int] = []
        self.open, self.tried = "", ("", self.last)
        self.settling: tuple[list[int], list[int], int] | None = None

    def offered(self, part: str) -> int:
        """The number of ids with this part."""
        text = self.open + part
        if self.pieced:
            settled, rest, _ = self.settling = self.pieced(text)
            self.tried = text, rest
            return len(self.kept) + len(settled) + len(rest)
        self.tried = text, self.encode(text)
        return len(self.kept) + len(self.tried[1])

    def take(self) -> None:
        text, ids = self.tried
        if self.settling:
            settled, self.last, end = self.settling
            self.kept += settled
            self.open = text[end:]
            return
        end = self.settled(text)
        self.open = text[end:]
        if end:  # the open rest is encoded by itself with the next part, so its ids are what the settled ones leave
            rest = self.encode(self.open)
            self.kept, ids = self.kept + ids[: len(ids) - len(rest)], rest
        self.last = ids

    def ids(self) -> list[int]:
        return self.kept + self.last


def filled(offers: Iterator[tuple[int, int, str]], block: Callable, growing: Growing, n_pairs: int, most_pairs: int, most_tokens: int) -> tuple[list, int]:
    """What a variant takes of the stream, and how many offers it passed over as too long for an empty one; nothing if no pair fits."""
    taken, passed = [], 0
    for offer in offers:
        if growing.offered(block(*offer)) <= most_tokens:
            growing.take()
            taken.append(offer)
            if len(taken) == most_pairs:
                break
        elif taken:
            break
        else:
            passed += 1  # in a row, as nothing is taken yet
            if passed == n_pairs:
                break
    return taken, passed


def task_records(task: str, turned: list, tokenizer: Any, n_variants: int, most_pairs: int, most_tokens: int, seed: int) -> list[tuple]:
    """(variant_id, ids, taken, passed) of a task's variants in their final order. turned: of each pair, the texts of the input under the eight symmetries, then those of the output."""
    rng = random.Random(variants.seeded(seed, variants.PACKING, task))
    offers = ((pair, rng.choice(grids.CODES), variants.drawn_mapping(rng)) for pair in itertools.cycle(range(len(turned))))

    def block(pair: int, code: str, mapping: str) -> str:
        texts, at, colours = turned[pair], PLACE[code], str.maketrans(grids.IDENTITY, mapping)
        return f"{chat.USER}{texts[at].translate(colours)}{chat.END}{chat.ASSISTANT}{texts[at + len(PLACE)].translate(colours)}{chat.END}"

    out = []
    for k in range(n_variants if turned else 0):
        growing = Growing(tokenizer)
        taken, passed = filled(offers, block, growing, len(turned), most_pairs, most_tokens)
        if not taken:
            return [(None, None, [], passed)]
        out.append((f"rearc:{task}:{k:03d}", growing.ids(), taken, passed))
    random.Random(variants.seeded(seed, variants.PACKED_ORDER, task)).shuffle(out)
    return out


def lists(items: list, type_: pa.DataType, fields: list[pa.Field] | None = None) -> pa.Array:
    """A column of lists, of None too; with fields, of tuples of such fields."""
    ends = list(itertools.accumulate(map(len, (x or () for x in items)), initial=0))
    flat = list(itertools.chain.from_iterable(x for x in items if x))
    if fields:
        values = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], f.type) for k, f in enumerate(fields)], fields=fields)
    else:
        values = pa.array(flat, type_.value_type)
    offsets = [None if x is None else at for x, at in zip(items, ends)]
    return pa.ListArray.from_arrays(pa.array([*offsets, ends[-1]], pa.int32()), values)


def external_split(tasks: DataFrame, load: Callable[[], Any], n_variants: int, most_pairs: int, most_tokens: int, seed: int, tokenizer: Tokenizer, delimiter: str = "") -> DataFrame:
    """tasks: task_id, pairs (input, output). Token records of the packed variants.

    load: makes the tokenizer in a task (``encode(text)`` and, if it has them, ``settled(text)`` and ``pieced(text)``); tokenizer: the same
    for the markers.  Per record: task_id, place (in the task's final order), variant_id, input_ids,
    sequence_length, assistant_spans, n_pairs, pair_augmentations, source_pairs, skipped (offers too long for an empty variant)
    and status: that of the spans, ``no_pair_fits`` (one row, without ids, for such a task) or ``bad_grid``.
    """
    slow = lambda g: F.array(*[grids.grid_text(grids.symmetry(g, F.lit(code)), delimiter) for code in grids.CODES])
    eight = (lambda g: F.coalesce(grids.turned_texts(g, delimiter), slow(g))) if len(delimiter) < 2 else slow
    rows = variants.dealt(tasks.select("task_id", "pairs"))  # as they are: turned texts are eight times as many
    rows = rows.withColumn("turned", F.transform("pairs", lambda p: F.concat(eight(p["input"]), eight(p["output"]))))
    sound = F.forall("turned", lambda t: F.forall(t, lambda s: s.isNotNull())) & (F.size("pairs") > 0)
    rows = rows.select("task_id", F.when(F.coalesce(sound, F.lit(False)), F.col("turned")).alias("turned"), F.coalesce(F.size("pairs"), F.lit(0)).alias("n"))
    form = f"task_id string, place int, variant_id string, input_ids array<int>, pair_augmentations {TAKEN}, source_pairs int, skipped int, status string, sequence_length int, n_pairs int, assistant_spans {chat.SPAN}"
    spans_of = spans_finder(tokenizer.encode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = []
                for task, pairs, n in zip(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns)):
                    made = task_records(task, pairs, known, n_variants, most_pairs, most_tokens, seed) if pairs else [(None, None, [], 0)]
                    for k, (v, ids, taken, passed) in enumerate(made):
                        spans, status = ([], "no_pair_fits" if pairs else "bad_grid") if ids is None else spans_of(ids, len(taken))
                        rows.append((task, k, v, ids, taken, n, passed, status, len(ids or ()), len(taken), spans))
                yield pa.RecordBatch.from_arrays([lists(c, f.type, FIELDS.get(f.name)) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    return rows.mapInArrow(run, form)


def split_statistics(records: DataFrame) -> DataFrame:
    """One row: source_pairs, packed_pairs and skipped_oversized_pairs of a written split."""
    first = F.col("place") == 0
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return records.agg(total(F.when(first, F.col("source_pairs")), "source_pairs"), total("n_pairs", "packed_pairs"), total("skipped", "skipped_oversized_pairs"))


def split_problems(records: DataFrame, tasks: DataFrame, expected_pairs: int | None = None) -> DataFrame:
    """(task_id, problem): unsound records, tasks without any, and tasks whose number of pairs isn't the expected one."""
    unsound = records.where("status <> 'ok'").select("task_id", F.col("status").alias("problem"))
    missing = tasks.select("task_id").join(records.select("task_id"), "task_id", "left_anti").select("task_id", F.lit("no_records").alias("problem"))
    out = unsound.unionByName(missing)
    if expected_pairs is None:
        return out
    other = tasks.where(F.coalesce(F.size("pairs"), F.lit(0)) != expected_pairs)
    return out.unionByName(other.select("task_id", F.lit("other_pair_count").alias("problem")))
