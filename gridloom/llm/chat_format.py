"""Chat formatting with a grammar round trip (native).

A turn is rendered as ``<s>role[INST]text[/INST]</s>``.  The text is rendered
as it is first, parsed back by the grammar below, and compared with the source
turns; only a conversation whose recovered turns differ has its conflicting
strings escaped, and is parsed and compared again.

    conversation = turn*
    turn         = "<s>" body "[INST]" body "[/INST]" "</s>"
    body         = any text without a control string

Escaping puts one backslash more after the first character of every control
string and of every string that looks like an escaped one (``</s>`` becomes
``<\\/s>``, that ``<\\\\/s>``), so it has an inverse and an escaped body never
holds a control string: the second comparison always succeeds.

Turns are put in order in one sorted row per conversation, which the output
needs anyway (one digest over the whole conversation).  Offsets are running
sums over the same partitioning: no second shuffle, linear in the turns.

Defined results: null role or text is empty; turns with the same number are
ordered by role, then text; a null turn comes first; rows with a null conv_id
are one conversation; repeated rows are turns of their own; very long texts are
taken whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

CONTROL = r"</?s>|\[/?INST\]"
LOOKS = r"(?=/?(?:s>|INST\]))"
OVERHEAD = len("<s>[INST][/INST]</s>")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + LOOKS, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)\\" + LOOKS, "$1")


def render(turns: Column, form) -> Column:
    one = lambda t: F.concat(F.lit("<s>"), form(t["role"]), F.lit("[INST]"), form(t["text"]), F.lit("[/INST]</s>"))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; null if it isn't in the grammar."""
    parts = F.split(formatted, "</s>", -1)
    bodies = F.slice(parts, F.lit(1), F.size(parts) - 1)
    controls = F.array(F.lit("<s>"), F.lit("[INST]"), F.lit("[/INST]"))
    fits = lambda b: (F.regexp_extract_all(b, F.lit(CONTROL), F.lit(0)) == controls) & b.startswith("<s>") & b.endswith("[/INST]")

    def turn(b: Column) -> Column:
        head = F.instr(b, "[INST]")
        role, text = F.substr(b, F.lit(4), head - 4), F.substr(b, head + 6, F.length(b) - head - 12)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    well = (F.element_at(parts, -1) == "") & F.forall(bodies, fits)
    return F.when(well, F.transform(bodies, turn))


def format_chats(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, escaped, turns (parsed back), loss_spans (start, end in code points of the assistant texts in formatted)."""
    row = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = lambda form: F.coalesce(F.sum(F.length(form(F.col("role"))) + F.length(form(F.col("text"))) + OVERHEAD).over(before), F.lit(0))
    plain = lambda x: x
    row = row.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).withColumn("raw_at", size(plain)).withColumn("safe_at", size(escape))
    chat = row.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "raw_at", "safe_at"))).alias("source"))
    wanted = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    chat = chat.withColumn("wanted", wanted).withColumn("raw", render(F.col("source"), plain))
    chat = chat.withColumn("escaped", ~F.coalesce(parse(F.col("raw")) == F.col("wanted"), F.lit(False)))
    chat = chat.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), escape)).otherwise(F.col("raw")))
    chat = chat.withColumn("turns", parse(F.col("formatted")))

    def span(t: Column) -> Column:
        shown = lambda x: F.length(F.when(F.col("escaped"), escape(x)).otherwise(x))
        start = F.when(F.col("escaped"), t["safe_at"]).otherwise(t["raw_at"]) + 9 + shown(t["role"])
        return F.struct(start.alias("start"), (start + shown(t["text"])).alias("end"))

    spans = F.transform(F.filter("source", lambda t: t["role"] == "assistant"), span)
    return chat.select("conv_id", "formatted", "escaped", "turns", spans.alias("loss_spans"), (F.col("turns") == F.col("wanted")).alias("round_trip"))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, read from the formatted conversation and unescaped, in order with nothing between."""
    one = lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))
    return F.array_join(F.transform(spans, one), "")


def digests(chats: DataFrame) -> DataFrame:
    """What was read back from the formatted conversations, as counts and digests: turns by the grammar, loss texts by the mask."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = under_mask(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
        "round_trip",
    )
