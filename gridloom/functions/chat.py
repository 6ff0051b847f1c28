"""Conversations of grids: rendering, target spans, labels and padding.

Token functions work on any ``array<int>``; ``byte_tokens`` is the built-in
tokenizer (UTF-8 bytes), others can be plugged in as a UDF of a text column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grids import grid_text, let
from .text import sha256

#: The chat template.
SYSTEM, USER, ASSISTANT, END = "<|im_start|>system\n", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n"
IGNORED = -100
SPAN = "array<struct<start:int,end:int>>"


def block(header: str, content: Column) -> Column:
    return F.concat(F.lit(header), content, F.lit(END))


def turns_text(roles: dict[str, str], role: Column, content: Column) -> Column:
    """One turn under the header of its role."""
    head = F.lit(None).cast("string")
    for name, header in roles.items():
        head = F.when(role == name, header).otherwise(head)
    return F.concat(head, content, F.lit(END))


def conversation(pairs: Column, guidance: Column, delimiter: str = "") -> Column:
    """The closed conversation of a training record: optional system turn, then a user and an assistant turn per pair."""
    return spoken(pairs, guidance, lambda grid: grid_text(grid, delimiter))


def spoken(pairs: Column, guidance: Column, shown: Callable[[Column], Column]) -> Column:
    """A closed conversation of pairs whose sides are shown by a function (or are texts already)."""
    each = F.transform(pairs, lambda p: F.concat(block(USER, shown(p["input"])), block(ASSISTANT, shown(p["output"]))))
    return F.concat(F.coalesce(block(SYSTEM, guidance), F.lit("")), F.array_join(each, ""))


def open_prompt(pairs: Column, test_input: Column, guidance: Column, delimiter: str = "") -> Column:
    """A prediction prompt: the closed conversation, the test input, and an assistant turn to fill."""
    return F.concat(conversation(pairs, guidance, delimiter), block(USER, grid_text(test_input, delimiter)), F.lit(ASSISTANT))


def prompt_digest(prompt: Column) -> Column:
    return sha256(prompt)


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes as token ids."""
    single = F.split(F.decode(F.encode(text, "utf-8"), "ISO-8859-1"), "")  # one character per byte
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(single, lambda c: F.ascii(c)))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def assistant_spans(pairs: Column, guidance: Column, delimiter: str = "") -> Column:
    """[start, end) in bytes of every assistant text of ``conversation``, from running lengths: no scan for markers."""
    return text_spans(pairs, guidance, lambda grid: grid_text(grid, delimiter))


def text_spans(pairs: Column, guidance: Column, shown: Callable[[Column], Column] = lambda text: text) -> Column:
    """[start, end) in bytes of every assistant text of ``spoken``, from running lengths."""
    fixed = len(USER) + len(ASSISTANT) + 2 * len(END)
    sizes = F.transform(pairs, lambda p: F.struct(byte_length(shown(p["input"])).alias("i"), byte_length(shown(p["output"])).alias("o")))
    head = F.coalesce(byte_length(block(SYSTEM, guidance)), F.lit(0))
    state = F.struct(head.alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(a: Column, s: Column) -> Column:
        start = a["at"] + len(USER) + s["i"] + len(END) + len(ASSISTANT)
        span = F.struct(start.cast("int").alias("start"), (start + s["o"]).cast("int").alias("end"))
        return F.struct((a["at"] + fixed + s["i"] + s["o"]).cast("int").alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    return F.aggregate(sizes, state, step, lambda a: a["spans"])


def is_plain(pairs: Column, guidance: Column) -> Column:
    """Whether neither guidance nor a side (a text) of the pairs holds the character that begins every marker, and no side is missing and no answer empty: then only the template's markers are found in ``spoken``."""
    free = lambda text: ~F.contains(text, F.lit(END[0]))
    sides = F.forall(pairs, lambda p: F.coalesce(free(p["input"]) & free(p["output"]) & (p["output"] != ""), F.lit(False)))
    return F.coalesce(sides & F.coalesce(free(guidance), F.lit(True)), F.lit(False))


def answer_bytes(pairs: Column, skip_first: bool = False) -> Column:
    """``target_tokens`` of ``text_spans``, from the answers alone."""
    some = F.slice(pairs, F.lit(2), F.greatest(F.size(pairs) - 1, F.lit(0))) if skip_first else pairs
    return F.aggregate(some, F.lit(0), lambda n, p: n + byte_length(p["output"]))


def target_tokens(spans: Column, skip_first: bool = False) -> Column:
    """Tokens in the spans, or in all but the first."""
    some = F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0))) if skip_first else spans
    return F.aggregate(some, F.lit(0), lambda n, s: n + s["end"] - s["start"])


def padded_length(n: Column, multiple: int = 8) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


def padded(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), length - F.size(ids)))


def attention_mask(ids: Column, length: Column) -> Column:
    return F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), length - F.size(ids)))


def labels_from(ids: Column, start: Column, length: Column) -> Column:
    """Labels from a position on; what stands before, and padding, is ignored."""
    own = F.transform(ids, lambda x, i: F.when(i >= start, x).otherwise(IGNORED))
    return F.concat(own, F.array_repeat(F.lit(IGNORED), length - F.size(ids)))


def labels_in(ids: Column, spans: Column, length: Column, skip_first: bool = False) -> Column:
    """Labels inside the spans only, which are in order and within the ids: gaps and slices in turn, in one pass."""
    some = F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0))) if skip_first else spans
    ignored = lambda n: F.array_repeat(F.lit(IGNORED), n)

    def piece(s: Column, k: Column, all_: Column) -> Column:
        before = F.when(k > 0, F.get(all_, k - 1)["end"]).otherwise(0)
        return F.concat(ignored(s["start"] - before), F.slice(ids, s["start"] + 1, s["end"] - s["start"]))

    def whole(all_: Column) -> Column:
        last = F.coalesce(F.get(all_, F.size(all_) - 1)["end"], F.lit(0))
        return F.concat(F.flatten(F.transform(all_, lambda s, k: piece(s, k, all_))), ignored(length - last))

    return let(some, whole)
