"""Tokenizers as columns, and where marker sequences stand among token ids.

A tokenizer is a function of a text column, so the built-in one (UTF-8 bytes)
stays in the JVM and others run as one Arrow batch function.  Ids are searched
as text of fixed width per id (bytes: one character each), so a place in the
text is a place among the ids and no Python scans them.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chat
from .grids import let

IDS = "array<int>"
#: A comma and seven digits for each id.
DIGITS, WIDTH = 7, 8
SCAN = f"struct<at:int,spans:{chat.SPAN},status:string>"


@dataclass(frozen=True)
class Coding:
    """How ids are written as text of ``width`` characters each: ``column`` of a row's text and ids, ``marker`` of a marker's ids."""

    width: int
    column: Callable[[Column, Column], Column]
    marker: Callable[[Sequence[int]], str]


def searchable(ids: Column) -> Column:
    """Ids as text of fixed width; null if one is missing, negative or too large."""
    fits = F.forall(ids, lambda i: F.coalesce(i.between(0, 10**DIGITS - 1), F.lit(False)))
    shown = F.transform(ids, lambda i: F.concat(F.lit(","), F.lpad(i.cast("string"), DIGITS, "0")))
    return F.when(fits, F.array_join(shown, ""))


BY_DIGITS = Coding(WIDTH, lambda text, ids: searchable(ids), lambda ids: "".join(f",{i:0{DIGITS}d}" for i in ids))
BY_BYTES = Coding(1, lambda text, ids: F.decode(F.encode(text, "utf-8"), "ISO-8859-1"), lambda ids: bytes(ids).decode("latin-1"))


@dataclass(frozen=True)
class Tokenizer:
    """``ids`` of a text column, ``encode`` of a text on the driver (for the markers, once), how ids are searched, and their number, which needn't take the ids."""

    ids: Callable[[Column], Column]
    encode: Callable[[str], list[int]]
    coding: Coding = BY_DIGITS
    length: Callable[[Column, Column], Column] = lambda text, ids: F.size(ids)
    #: Whether ids are the bytes of a text, so that lengths of its parts add up.
    by_bytes: bool = False


#: UTF-8 bytes.
BYTES = Tokenizer(chat.byte_tokens, lambda text: list(text.encode()), BY_BYTES, lambda text, ids: F.octet_length(text), True)


def flat_ids(value: Any) -> list[int]:
    """A tokenizer's answer as a list of integers; an error for anything else."""
    found = value.tolist() if hasattr(value, "tolist") else value
    if not isinstance(found, list) or not set(map(type, found)) <= {int}:
        raise TypeError("a tokenizer gives a flat list of integers")
    return found


def from_loader(load: Callable[[], Any]) -> Tokenizer:
    """A tokenizer from a function that loads an object with ``encode(text)``; each Python worker loads it once per task."""

    @F.pandas_udf(IDS)
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load().encode
        for texts in batches:
            yield texts.map(lambda t: None if t is None else flat_ids(encode(t)))

    return Tokenizer(ids, lambda text: flat_ids(load().encode(text)))


class Ranked:
    """Byte-pair encoding by a file of ranks (base64 and number in each line), each match of a pattern for itself."""

    #: Stretches of text whose ids are remembered, and the longest such stretch.
    MOST, LONGEST = 1 << 16, 64

    def __init__(self, path: str, pattern: str, by_lines: bool = False):
        """by_lines: the pattern neither looks back nor lets a piece go on from a character that isn't white space to a line feed, so a text can be cut there."""
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.pieces = regex.compile(pattern)
        self.known = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, list[int]] = {}
        self.pieced = self.line_ids if by_lines else None

    def encode(self, text: str) -> list[int]:
        return self.known.encode_ordinary(text)

    def remembered(self, stretch: str) -> list[int]:
        if len(stretch) > self.LONGEST:
            return self.encode(stretch)
        if len(self.seen) >= self.MOST:
            self.seen.clear()
        ids = self.seen[stretch] = self.encode(stretch)
        return ids

    def line_ids(self, text: str) -> tuple[list[int], list[int], int]:
        """The ids of a text up to where it was cut last, those of its open rest, which a text behind it may change, and where that begins."""
        lines = text.split("\n")
        cut = lines[:1]
        for before, line in zip(lines, lines[1:]):
            if before and not before[-1].isspace():
                cut.append("\n" + line)
            else:
                cut[-1] += "\n" + line
        known = self.seen.get
        each = [known(x) or self.remembered(x) for x in cut]
        rest = each.pop()
        return list(itertools.chain.from_iterable(each)), rest, len(text) - len(cut[-1])

    def settled(self, text: str) -> int:
        """Characters whose ids no text behind them changes: all but the last three pieces. A piece is decided by its
        own characters, the one behind it and the two behind an apostrophe, and each piece has one at least."""
        found = self.pieces.findall(text) if not self.pieces.groups else []
        if found and sum(map(len, found)) == len(text):  # pieces without gaps, as nearly always
            return len(text) - sum(map(len, found[-3:]))
        ends = [0, 0, 0, 0]
        for m in self.pieces.finditer(text):
            ends = [*ends[1:], m.end()]
        return ends[0]


def place(text: Column, marker: Sequence[int], start: Column | int = 0, coding: Coding = BY_DIGITS) -> Column:
    """Index of the marker's first occurrence at or after ``start`` in a searchable text, -1 if there is none or the marker is empty."""
    if not marker:
        return F.lit(-1)
    start = start if isinstance(start, Column) else F.lit(start)
    found = F.call_function("locate", F.lit(coding.marker(marker)), text, (start * coding.width + 1).cast("int"))
    return F.when(start < 0, -1).otherwise(let(found, lambda at: F.when(at > 0, ((at - 1) / coding.width).cast("int")).otherwise(-1)))


def place_after(text: Column, marker: Sequence[int], start: Column | int = 0, coding: Coding = BY_DIGITS) -> Column:
    """Index behind the marker's first occurrence, or -1."""
    return let(place(text, marker, start, coding), lambda at: F.when(at >= 0, at + len(marker)).otherwise(-1))


def scanned_spans(text: Column, ids: Column, turns: Column, system: Column, tokenizer: Tokenizer) -> Column:
    """(at, spans, status) of the assistant texts of a conversation of ``turns`` user and assistant turns, found by their markers.

    status is 'ok' or the first thing wrong: no_system, open_system, no_user,
    open_user, no_assistant, empty_target, trailing, bad_ids.
    """
    head, user, assistant, end = (tokenizer.encode(m) for m in (chat.SYSTEM, chat.USER, chat.ASSISTANT, chat.END))
    at, after = (functools.partial(f, coding=tokenizer.coding) for f in (place, place_after))

    def state(next_: Column, spans: Column, status: Column | str) -> Column:
        return F.struct(next_.alias("at"), spans.alias("spans"), (status if isinstance(status, Column) else F.lit(status)).alias("status")).cast(SCAN)

    def opened(coded: Column) -> Column:
        closed = after(coded, end, len(head))
        wrong = F.when(at(coded, head) != 0, "no_system").when(closed < 0, "open_system").otherwise("ok")
        none = F.array().cast(chat.SPAN)
        return F.when(system, state(closed, none, wrong)).otherwise(state(F.lit(0), none, "ok"))

    def turn(coded: Column, a: Column) -> Column:
        def of_answer(asked: Column, said: Column, start: Column, stop: Column) -> Column:
            wrong = F.when(asked < 0, "no_user").when(said < 0, "open_user").when(start < 0, "no_assistant").when(stop <= start, "empty_target").otherwise("ok")
            span = F.array(F.struct(start.alias("start"), stop.alias("end"))).cast(chat.SPAN)
            return state(stop + len(end), F.concat(a["spans"], span), wrong)

        def of_user(asked: Column) -> Column:
            return let(after(coded, end, asked), lambda said: let(after(coded, assistant, said), lambda start: let(at(coded, end, start), lambda stop: of_answer(asked, said, start, stop))))

        return F.when(a["status"] != "ok", a).otherwise(let(after(coded, user, a["at"]), of_user))

    def scan(coded: Column) -> Column:
        steps = F.when(turns > 0, F.sequence(F.lit(1), turns)).otherwise(F.array().cast(IDS))
        found = F.aggregate(steps, opened(coded), lambda a, _: turn(coded, a).cast(SCAN))
        trailing = lambda a: F.when((a["status"] == "ok") & (a["at"] * tokenizer.coding.width != F.length(coded)), state(a["at"], a["spans"], "trailing")).otherwise(a)
        return F.when(coded.isNull(), state(F.lit(-1), F.array().cast(chat.SPAN), "bad_ids")).otherwise(let(found, trailing))

    return let(tokenizer.coding.column(text, ids), scan)


def spans_finder(encode: Callable[[str], list[int]]) -> Callable[[list[int], int], tuple[list[tuple[int, int]], str]]:
    """``scanned_spans`` of a conversation without a system turn, for ids that a task of Python has at hand: (spans, status) of ids and turns."""
    user, assistant, end = (encode(m) for m in (chat.USER, chat.ASSISTANT, chat.END))

    def at(ids: list[int], marker: list[int], start: int) -> int:
        if start < 0 or not marker:
            return -1
        first, size, last = marker[0], len(marker), len(ids) - len(marker) + 1
        try:
            while True:
                start = ids.index(first, start, last)
                if ids[start : start + size] == marker:
                    return start
                start += 1
        except ValueError:
            return -1

    def after(ids: list[int], marker: list[int], start: int) -> int:
        found = at(ids, marker, start)
        return found if found < 0 else found + len(marker)

    def spans(ids: list[int], turns: int) -> tuple[list[tuple[int, int]], str]:
        if ids and not 0 <= min(ids) <= max(ids) < 10**DIGITS:
            return [], "bad_ids"
        out, place = [], 0
        for _ in range(turns):
            asked = after(ids, user, place)
            said = after(ids, end, asked)
            start = after(ids, assistant, said)
            stop = at(ids, end, start)
            out.append((start, stop))
            wrong = "no_user" if asked < 0 else "open_user" if said < 0 else "no_assistant" if start < 0 else "empty_target" if stop <= start else None
            if wrong:
                return out, wrong
            place = stop + len(end)
        return out, "ok" if place == len(ids) else "trailing"

    return spans


def misplaced(spans: Column, length: Column) -> Column:
    """Whether spans are empty, out of order, overlapping or beyond the ids."""
    before = lambda k: F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))
    bad = F.transform(spans, lambda s, k: (s["start"] < F.when(k > 0, before(k)).otherwise(0)) | (s["end"] <= s["start"]) | (s["end"] > length))
    return F.coalesce(F.exists(bad, lambda b: b), F.lit(True))
