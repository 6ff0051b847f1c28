"""Grid algebra on ``array<array<int>>`` columns, as Catalyst expressions.

An invalid argument (ragged or empty grid, unknown code, bad permutation) gives
null; ``checked`` turns such a null into an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight symmetries in the order that numbers variants, and what undoes each.
CODES = ("ID", "R90", "R180", "R270", "FH", "FV", "FD1", "FD2")
INVERSE = {"ID": "ID", "R90": "R270", "R180": "R180", "R270": "R90", "FH": "FH", "FV": "FV", "FD1": "FD1", "FD2": "FD2"}
IDENTITY = "0123456789"
GRID = "array<array<int>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_grid(grid: Column) -> Column:
    width = F.size(F.get(grid, F.lit(0)))
    return F.coalesce((F.size(grid) > 0) & F.forall(grid, lambda r: (F.size(r) > 0) & (F.size(r) == width)), F.lit(False))


def upside_down(grid: Column) -> Column:
    return F.reverse(grid)


def mirrored(grid: Column) -> Column:
    return F.transform(grid, lambda row: F.reverse(row))


def transposed(grid: Column) -> Column:
    columns = F.sequence(F.lit(0), F.size(F.get(grid, F.lit(0))) - 1)
    return F.transform(columns, lambda j: F.transform(grid, lambda row: F.get(row, j)))


#: Quarter turns are clockwise; "FH" reverses the order of rows.
SYMMETRIES = {
    "ID": lambda g: g,
    "R90": lambda g: transposed(upside_down(g)),
    "R180": lambda g: upside_down(mirrored(g)),
    "R270": lambda g: upside_down(transposed(g)),
    "FH": upside_down,
    "FV": mirrored,
    "FD1": transposed,
    "FD2": lambda g: mirrored(upside_down(transposed(g))),
}


def rotated(grid: Column, quarters: int) -> Column:
    return F.when(is_grid(grid), SYMMETRIES[("ID", "R90", "R180", "R270")[quarters % 4]](grid))


def flipped(grid: Column, axis: str) -> Column:
    codes = {"horizontal": "FH", "vertical": "FV", "main_diagonal": "FD1", "anti_diagonal": "FD2"}
    return F.when(is_grid(grid), SYMMETRIES[codes[axis]](grid))


def symmetry(grid: Column, code: Column) -> Column:
    """The grid under the symmetry of each row's code, in any case."""

    def choose(g: Column, name: Column) -> Column:
        out = F.lit(None).cast(GRID)
        for known in reversed(CODES):
            out = F.when(name == known, SYMMETRIES[known](g)).otherwise(out)
        return F.when(is_grid(g), out)

    return let(code_name(code), lambda name: let(grid, lambda g: choose(g, name)))


def code_name(code: Column) -> Column:
    """A code in upper case, as it nearly always is already: Spark's ``upper`` knows all languages and takes its time."""
    return let(code, lambda c: F.when(c.isin(*CODES), c).otherwise(F.upper(c)))


def is_permutation(mapping: Column) -> Column:
    good = F.length(mapping) == len(IDENTITY)  # ten characters that hold ten digits
    for digit in IDENTITY:
        good = good & F.contains(mapping, F.lit(digit))
    return F.coalesce(good, F.lit(False))


def inverted(mapping: Column) -> Column:
    places = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda v: (F.instr(mapping, v.cast("string")) - 1).cast("string"))
    return F.when(is_permutation(mapping), F.array_join(places, ""))


def remapped(grid: Column, mapping: Column) -> Column:
    """Cell v becomes digit v of the mapping; cells other than 0 to 9 make the grid invalid."""

    return let(digits(mapping), lambda to: recoloured(grid, to))


def digits(mapping: Column) -> Column:
    """The digits of a mapping; null unless it is a permutation."""
    return let(mapping, lambda m: F.when(is_permutation(m), F.transform(F.split(m, ""), lambda d: d.cast("int"))))


def recoloured(grid: Column, to: Column) -> Column:
    """``remapped`` by digits; a cell that has none there makes the grid invalid."""
    out = lambda g: F.when(is_grid(g), F.transform(g, lambda row: F.transform(row, lambda v: F.get(to, v))))
    whole = lambda g: F.forall(g, lambda row: F.forall(row, lambda v: v.isNotNull()))
    return let(let(grid, out), lambda g: F.when(whole(g), g))


def augmented(grid: Column, code: Column, mapping: Column) -> Column:
    """Values first, geometry second."""
    return symmetry(remapped(grid, mapping), code)


def restored(grid: Column, code: Column, mapping: Column) -> Column:
    """Geometry undone first, values second."""
    undo = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])
    plain = symmetry(grid, F.try_element_at(undo, code_name(code)))
    places = lambda m: F.when(is_permutation(m), F.transform(F.array(*map(F.lit, IDENTITY)), lambda v: F.instr(m, v) - 1))
    return let(let(mapping, places), lambda back: recoloured(plain, back))


def augmented_pair(pair: Column, code: Column, mapping: Column) -> Column:
    return let(digits(mapping), lambda to: turned_pair(pair, code, to))


def turned_pair(pair: Column, code: Column, to: Column) -> Column:
    """``augmented_pair`` by the ``digits`` of a mapping."""
    sides = [symmetry(recoloured(pair[side], to), code).alias(side) for side in ("input", "output")]
    return F.struct(*sides)


def checked(value: Column, message: str) -> Column:
    """The value, or an error where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(message)))


def grid_text(grid: Column, delimiter: str = " ") -> Column:
    return F.array_join(F.transform(grid, lambda row: F.array_join(F.transform(row, lambda v: v.cast("string")), delimiter)), "\n")


def parsed_grid(text: Column) -> Column:
    """Digits in lines as a grid."""
    return F.transform(F.split(text, "\n"), lambda line: F.transform(F.split(line, ""), lambda d: d.cast("int")))


def is_grid_text(text: Column) -> Column:
    """Whether a text is lines of digits, of one width."""
    digits_only = F.call_function("translate", text, F.lit(IDENTITY + "\n"), F.lit("")) == ""
    even = let(F.split(text, "\n"), lambda lines: let(F.length(F.get(lines, F.lit(0))), lambda w: (w > 0) & F.forall(lines, lambda line: F.length(line) == w)))
    return F.coalesce(digits_only & even, F.lit(False))


def text_columns(lines: Column) -> Column:
    """The columns of a grid's lines, as lines."""
    places = F.sequence(F.lit(1), F.length(F.get(lines, F.lit(0))))
    return F.transform(places, lambda j: F.array_join(F.transform(lines, lambda line: F.substr(line, j, F.lit(1))), ""))


def eight(lines: Column, columns: Column) -> Column:
    """The texts of the eight symmetries, as of ``CODES``, from a grid's lines and its columns: read backwards, a text is that of a half turn."""
    bases = F.array(*[F.array_join(x, "\n") for s in (lines, columns) for x in (s, F.reverse(s))])
    g, up, across, up_across = range(4)  # as it is, upside down, transposed, transposed and then upside down
    picks = ((g, False), (up_across, True), (g, True), (up_across, False), (up, False), (up, True), (across, False), (across, True))
    return let(bases, lambda b: F.array(*[F.reverse(F.get(b, F.lit(k))) if back else F.get(b, F.lit(k)) for k, back in picks]))


def symmetric_texts(text: Column) -> Column:
    """The texts of a grid's text under the eight symmetries, in the order of ``CODES``: digits are moved as characters, any other text is parsed."""
    moved = lambda t: let(F.split(t, "\n"), lambda lines: eight(lines, text_columns(lines)))
    parsed = lambda t: let(parsed_grid(t), lambda g: F.array(*[grid_text(symmetry(g, F.lit(code)), "") for code in CODES]))
    return let(text, lambda t: F.when(is_grid_text(t), moved(t)).otherwise(parsed(t)))


def turned_text(text: Column, code: Column) -> Column:
    """The text of a grid's text under one symmetry, by each row's code."""

    def moved(t: Column, name: Column, lines: Column) -> Column:
        down = lambda rows: F.array_join(rows, "\n")
        up, across = down(F.reverse(lines)), text_columns(lines)
        known = {"ID": t, "R90": F.reverse(down(F.reverse(across))), "R180": F.reverse(t), "R270": down(F.reverse(across)), "FH": up, "FV": F.reverse(up), "FD1": down(across), "FD2": F.reverse(down(across))}
        out = F.lit(None).cast("string")
        for k in reversed(CODES):
            out = F.when(name == k, known[k]).otherwise(out)
        return out

    def of(t: Column, name: Column) -> Column:
        return F.when(is_grid_text(t), let(F.split(t, "\n"), lambda lines: moved(t, name, lines))).otherwise(grid_text(symmetry(parsed_grid(t), name), ""))

    return let(text, lambda t: let(code_name(code), lambda name: of(t, name)))


def turned_texts(grid: Column, delimiter: str = "") -> Column:
    """The texts of a grid of digits under the eight symmetries, in the order of ``CODES``; null for other grids."""
    if len(delimiter) > 1:
        raise ValueError("texts are read backwards, so a delimiter is one character at most")
    sound = lambda g: is_grid(g) & F.forall(g, lambda row: F.forall(row, lambda v: F.coalesce(v.between(0, 9), F.lit(False))))
    line = lambda cells: F.array_join(F.transform(cells, lambda v: v.cast("string")), delimiter)
    columns = lambda g: F.transform(transposed(g), line)
    return let(grid, lambda g: F.when(sound(g), eight(F.transform(g, line), columns(g))))


def example_text(pair: Column, number: Column | None = None, delimiter: str = " ", shown: Callable[[Column], Column] | None = None) -> Column:
    head = [F.concat(F.lit("Example "), number.cast("string"))] if number is not None else []
    shown = shown or (lambda grid: grid_text(grid, delimiter))
    return F.concat_ws("\n", *head, F.lit("Input:"), shown(pair["input"]), F.lit("Output:"), shown(pair["output"]))


def examples_text(pairs: Column, delimiter: str = " ", shown: Callable[[Column], Column] | None = None) -> Column:
    """Numbered examples with a blank line between; null if there are none. ``shown``: how a side is written, if it isn't a grid."""
    return let(pairs, lambda all_: F.when(F.size(all_) > 0, F.array_join(F.transform(all_, lambda p, i: example_text(p, i + 1, delimiter, shown)), "\n\n")))
