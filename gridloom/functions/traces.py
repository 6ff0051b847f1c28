"""Normalising, validating and repairing reasoning traces; verdicts, guidance and predicted grids.

Everything here is a Catalyst expression: no Python runs on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grids import GRID, let
from .text import BLANK, LINE_END, is_blank, occurrences, strip

#: The tags and headings of a trace, in order.
SECTIONS = (
    "<think>",
    "1) INPUT ANALYSIS",
    "2) OUTPUT ANALYSIS",
    "3) TRANSFORMATION ANALYSIS",
    "4) STEPS FOR THE TRANSFORMATION",
    "</think>",
    "General natural language description:",
    "General steps:",
)
OPEN, CLOSE, DESCRIPTION, STEPS = SECTIONS[0], SECTIONS[5], SECTIONS[6], SECTIONS[7]
#: Markers of the chat template that may precede or follow a predicted grid.
CHAT_MARKERS = ("<|im_end|>", "<|im_start|>")
VOTES = 5
#: What a chat header leaves before a grid.
NAMED = "assistant\n"


def normalised(trace: Column) -> Column:
    """Harmless drift undone: line ends, special spaces, an outer fence, emphasis of headings, bullets, trailing blanks, empty lines."""
    out = F.regexp_replace(F.regexp_replace(trace, "\r\n?", "\n"), r"[\xa0\u2007\u202f]", " ")
    out = strip(out)
    lines = F.split(out, LINE_END)
    inner = strip(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))
    out = F.when(F.startswith(out, F.lit("```")) & F.endswith(out, F.lit("```")) & (F.size(lines) >= 2), inner).otherwise(out)
    for section in SECTIONS:
        pattern = rf"(?dm)^{BLANK}*(?:\*\*|__)?{BLANK}*{re.escape(section)}{BLANK}*(?:\*\*|__)?{BLANK}*$"
        out = F.regexp_replace(out, pattern, section)
    out = F.regexp_replace(out, rf"(?dm)^{BLANK}*[\u2022\u2013\u2014]{BLANK}+", "- ")
    out = F.regexp_replace(out, r"(?dm)[ \t]+$", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def section_positions(text: Column) -> Column:
    """First position of each section, -1 where there is none."""
    return F.array(*[F.instr(text, s) - 1 for s in SECTIONS])


def format_verdict(text: Column) -> Column:
    """What a normalised trace lacks, and whether it is accepted."""
    return let(text, lambda t: let(section_positions(t), lambda at: _verdict(t, at)))


def _verdict(text: Column, at: Column) -> Column:
    names = F.array(*map(F.lit, SECTIONS))
    missing = F.filter(F.transform(names, lambda s, i: F.when(F.get(at, i) < 0, s)), lambda s: s.isNotNull())
    in_order = (F.size(missing) == 0) & (F.array_sort(at) == at)
    counts = [occurrences(text, s) for s in SECTIONS]
    unique = counts[0] == 1
    for c in counts[1:]:
        unique = unique & (c == 1)
    one_block = (counts[0] == 1) & (counts[5] == 1)
    starts = F.startswith(text, F.lit(OPEN))
    return F.struct(
        (in_order & unique & one_block & starts).alias("accepted"),
        missing.alias("missing_sections"),
        in_order.alias("sections_in_order"),
        unique.alias("sections_unique"),
        one_block.alias("single_think_block"),
        starts.alias("starts_with_think"),
    )


def repaired(trace: Column) -> Column:
    """(trace, repair) of the two known defects: a missing closing tag, and a summary repeated inside the block. repair is null for accepted traces, 'unsupported' where nothing helps."""
    first = F.instr(trace, DESCRIPTION)
    close = F.instr(trace, CLOSE)
    n_open, n_close, n_head = (occurrences(trace, s) for s in (OPEN, CLOSE, DESCRIPTION))
    head = F.regexp_replace(F.substr(trace, F.lit(1), first - 1), rf"{BLANK}+\z", "")
    closed = F.concat(head, F.lit(f"\n{CLOSE}\n\n"), F.regexp_replace(F.substr(trace, first), rf"\A{BLANK}+", ""))
    cut = F.concat(head, F.lit("\n"), F.substr(trace, close))
    adds = (n_open == 1) & (n_close == 0) & (n_head == 1)
    cuts = (n_open == 1) & (n_close == 1) & (n_head == 2) & (first < close)
    valid = lambda t: format_verdict(normalised(t))["accepted"]
    result = lambda t, kind: F.struct(t.alias("trace"), F.lit(kind).cast("string").alias("repair"))
    return (
        F.when(valid(trace), result(trace, None))
        .when(adds & valid(closed), result(closed, "insert_missing_think_close"))
        .when(cuts & valid(cut), result(cut, "remove_duplicate_summary_inside_think"))
        .otherwise(result(trace, "unsupported"))
    )


def verdict(response: Column) -> Column:
    """'pass' or 'fail' of a JSON object with that string as ``verdict``; null for anything else."""
    # as the only element of an array, so that text after the object makes it malformed; of a repeated key the last counts
    strict = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    parsed = F.from_json(F.concat(F.lit("["), response, F.lit("]")), "array<struct<verdict variant>>", strict)
    said = F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0))["verdict"])
    is_text = F.schema_of_variant(said) == "STRING"
    word = F.lower(strip(F.try_variant_get(said, "$", "string")))
    return F.when(is_text & word.isin("pass", "fail"), word)


def valid_guidance(text: Column) -> Column:
    """The stripped text if it holds both summary headings."""
    bare = strip(text)
    return F.when(F.contains(bare, F.lit(DESCRIPTION)) & F.contains(bare, F.lit(STEPS)), bare)


def guidance(trace: Column) -> Column:
    """What follows the last closing tag, if it is valid guidance."""
    return F.when(F.contains(trace, F.lit(CLOSE)), valid_guidance(F.substring_index(trace, CLOSE, -1)))


def any_guidance(text: Column) -> Column:
    """Guidance of a whole trace or of a bare summary."""
    return F.when(F.contains(text, F.lit(CLOSE)), guidance(text)).otherwise(valid_guidance(text))


def predicted_grid(text: Column, most_rows: int = 30, most_columns: int = 30) -> Column:
    """(status, grid): the leading lines of digits of a completion. Height is judged before width, width before raggedness."""
    bare = text
    for marker in CHAT_MARKERS:
        bare = F.replace(bare, F.lit(marker))

    def of_lines(lines: Column) -> Column:
        named = let(strip(F.get(lines, F.lit(0))), lambda x: (F.length(x) == len("assistant")) & (F.lower(x) == "assistant"))
        return F.transform(F.slice(lines, F.when(named, 2).otherwise(1), F.size(lines)), strip)

    def of_rows(lines: Column) -> Column:
        other = F.array_position(F.transform(lines, lambda x: x.rlike(r"\A[0-9]+\z")), F.lit(False))
        return F.when(other > 0, F.slice(lines, F.lit(1), (other - 1).cast("int"))).otherwise(lines)

    def judged(rows: Column, empty: Column) -> Column:
        width = F.length(F.get(rows, F.lit(0)))
        status = (
            F.when(empty, "empty_output")
            .when(F.size(rows) == 0, "no_leading_grid")
            .when(F.size(rows) > most_rows, "grid_too_tall")
            .when(width > most_columns, "grid_too_wide")
            .when(F.exists(rows, lambda x: F.length(x) != width), "ragged_grid")
            .otherwise("ok")
        )
        cells = lambda: F.transform(rows, lambda x: F.transform(F.split(x, ""), lambda d: d.cast("int")))
        return let(status, lambda s: F.struct(s.alias("status"), F.when(s == "ok", cells()).cast(GRID).alias("grid")))

    found = lambda rows, empty: F.struct(rows.alias("rows"), empty.alias("empty"))

    def whole(t: Column) -> Column:
        return found(let(of_lines(F.split(t, LINE_END, -1)), of_rows), t == "")

    def plain(rest: Column, named: Column) -> Column:
        # digits and line ends only, as most completions are: no pattern is needed
        lines = F.split(F.when(named, F.rtrim(rest, F.lit("\n"))).otherwise(F.trim(rest, F.lit("\n"))), "\n")
        lead = lambda x: let(F.array_position(x, F.lit("")), lambda k: F.when(k > 0, F.slice(x, F.lit(1), (k - 1).cast("int"))).otherwise(x))
        return found(let(lines, lead), ~named & (F.call_function("translate", rest, F.lit("\n"), F.lit("")) == ""))

    def of(b: Column) -> Column:
        named = F.startswith(b, F.lit(NAMED))
        rest = F.when(named, F.substr(b, F.lit(len(NAMED) + 1))).otherwise(b)
        digits_only = lambda r: F.call_function("translate", r, F.lit("0123456789\n"), F.lit("")) == ""
        return let(rest, lambda r: F.when(digits_only(r), plain(r, named)).otherwise(let(strip(b), whole)))

    return let(let(bare, of), lambda f: judged(f["rows"], f["empty"]))


def hint_status(*fields: Column) -> Column:
    """complete if no field is blank, missing if there is no hint, else incomplete."""
    blank = F.array(*[is_blank(f) for f in fields])
    none = F.forall(F.array(*[f.isNull() for f in fields]), lambda x: x)
    return F.when(none, "missing").when(F.exists(blank, lambda x: x), "incomplete").otherwise("complete")
