r"""Personal data: base patterns, and information-theoretic sanitisation around them (native).

Base spans are found by four patterns (email, ip, card, phone).  Each pattern
is written for Java's engine so that it takes linear time and constant stack:
possessive loops, and a run is tried only at its first character or where the
last match ended, which is where a leftmost match can start.

The method then asks which *terms* give protected data away.  A term is a run of
letters and digits, in lower case, that touches no valid match: account names, postal
codes, dates and numbers that are no personal data of the four kinds are terms.  What is protected
stands at three levels: any personal data; a kind; and a class within a kind (an
address's domain, a network of 16 bits, a card's issuer digits, a number's
first four digits), so that different values share statistics.  Over the
distinct texts of the corpus (a text says the same however often it is copied),
N counts texts, n(t) those that hold term t, n(e) those that hold a value of
level e, n(t, e) those with both.  The information that t gives about e,

    PMI(t, e) = log2( n(t, e) * N / (n(t) * n(e)) ),

is compared with all there is to know about e, IC(e) = log2( N / n(e) ): t
discloses e if PMI >= ALPHA * IC, that is, if P(e | t) >= P(e) ** (1 - ALPHA).
To tell this from chance among V terms, the evidence must be strong enough: with
v different values of e in texts that hold t (n(t, e), if that is less), p = P(e) and q = P(e | t),

    v / q * KL(q || p) >= ln(SURE * V)

bounds the expected number of terms that pass by chance below 1 / SURE a level.
Counting values and not texts, near copies of one text are no evidence.  Every
occurrence of a disclosing term outside of base spans, in every text, becomes a
span of kind ``term`` (removed by ``sanitised``).  Base spans always stay.

All counts are combined map-side.  Texts with a match and texts that hold a
disclosing term are combined to one of each; other texts stay where they are.
Which texts hold disclosing terms is asked of a filter of at most ``MOST_WORDS``
64-bit words (2 MB), and then of the terms themselves; hot terms and hot texts
are met by (key, piece).  Co-occurrence takes (terms x levels) of one text, as a
stream.

Defined results: null text is empty and has no spans; repeated rows and texts
each get their spans, in their own row; very long texts are taken whole; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import let, materialize, met, salt, whole_text
from .filters import distinct_rows

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: What the contract calls base patterns, in their linear form.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign without which a pattern can't match.
SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Without these no match is valid: as many digits as a card has.
SURE_SIGNS = {**SIGNS, "ip": PATTERNS["ip"], "card": r"[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"}
ALPHA, SURE = 0.8, 20.0
#: A term; in the texts, and with the gap before it.
TERM = r"[\p{L}\p{N}]++"
#: Stands for a match while terms are taken; a private character, so runs that hold it in a text are no terms either.
MARK = "\ue000"
#: Most 64-bit words of the filter of disclosing terms.
MOST_WORDS = 1 << 18


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Digits from the right, every second one doubled, sum divisible by ten."""
    each = F.split(F.reverse(number), "")

    def value(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.transform(F.filter(each, lambda d: d != ""), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0")
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (bare(p) <= "255"))
    if kind == "card":
        return F.length(digits(x)).between(13, 19) & luhn(digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def found(text: Column, kind: str) -> Column:
    """array of (kind, i, size, match): the matches in order; size is the length of the gap before it with the match itself."""
    pattern = PATTERNS[kind]
    # \G: after the last match each later start fails at once, instead of looking through the rest again
    chunks = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))
    pairs = F.arrays_zip(chunks.alias("chunk"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    entry = lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(p["chunk"]).alias("size"), p["match"].alias("match"))
    none = F.array().cast("array<struct<kind:string,i:int,size:int,match:string>>")
    return F.when(text.rlike(SIGNS[kind]), F.transform(pairs, entry)).otherwise(none)


def keys(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def scan(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per document: row (a number of its own), its piece, doc_id, keys of the text, the matches of all kinds, and the text of rows that have any."""
    rows = docs.select("doc_id", whole_text().alias("text"), F.monotonically_increasing_id().alias("row"))
    for k in KINDS:
        rows = rows.withColumn(f"__{k}", found(F.col("text"), k))
    rows = rows.withColumn("found", F.concat(*[f"__{k}" for k in KINDS]))
    text = F.col("text") if keep_text else F.when(F.size("found") > 0, F.col("text"))
    return materialize(rows.select("row", salt(F.col("row")).alias("piece"), "doc_id", *keys(F.col("text")), text.alias("text"), "found"), "pii-scan")


def occurrences(scanned: DataFrame) -> DataFrame:
    """Per valid base span: row, kind, start, end, value (the match) and class."""
    each = scanned.select("row", F.explode("found").alias("m")).select("row", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum("size").over(order).cast("int")).withColumn("start", F.col("end") - F.length("match"))
    passes, of = F.lit(False), F.lit(None).cast("string")
    classes = {"email": F.lower(F.substring_index("match", "@", -1)), "ip": F.substring_index("match", ".", 2), "card": F.substring(digits(F.col("match")), 1, 6), "phone": F.substring(digits(F.col("match")), 1, 4)}
    for k in KINDS:
        passes = F.when(F.col("kind") == k, valid(k, F.col("match"))).otherwise(passes)
        of = F.when(F.col("kind") == k, classes[k]).otherwise(of)
    return materialize(each.where(passes).select("row", "kind", "start", "end", F.col("match").alias("value"), of.alias("class")), "pii-base")


def marked_matches(text: Column, kind: str) -> Column:
    """The text with a mark for every valid match of a kind; others stay, so their digits can be terms."""
    # as in ``found``: a gap and the match that ends it
    chunks = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{PATTERNS[kind]})"), F.lit(0))
    pairs = F.arrays_zip(chunks.alias("chunk"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("match"))
    shown = lambda p: F.when(valid(kind, p["match"]), F.concat(F.substr(p["chunk"], F.lit(1), F.length(p["chunk"]) - F.length(p["match"])), F.lit(MARK))).otherwise(p["chunk"])
    rest = F.substr(text, F.aggregate(chunks, F.lit(0), lambda n, c: n + F.length(c)) + 1)
    return F.when(text.rlike(SURE_SIGNS[kind]), F.concat(F.array_join(F.transform(pairs, shown), ""), rest)).otherwise(text)


def masked(text: Column) -> Column:
    """The text with a mark for every valid match of a base pattern, kind after kind: a number's digits are no card."""

    def marking(kind: str) -> Callable[[Column], Column]:
        return lambda t: marked_matches(t, kind)

    out = text
    for k in ("email", "phone", "ip", "card"):
        out = let(out, marking(k))
    return out


def terms_of(text: Column) -> Column:
    """The distinct terms of a text; a run that touches a match is none."""
    runs = F.regexp_extract_all(F.lower(masked(text)), F.lit(rf"[{MARK}\p{{L}}\p{{N}}]++"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda t: ~t.contains(MARK)))


def term_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(term, n_t) over all distinct texts, and their number N."""
    texts = distinct_rows(docs.select(whole_text().alias("text")), "pii-hashes")
    # the empty string, which is no term, counts the texts
    held = F.concat(terms_of(F.col("text")), F.array(F.lit("")))
    counts = materialize(texts.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "pii-terms")
    number = counts.where("term = ''").first()
    return counts.where("term <> ''"), number["n_t"] if number else 0


def protected(scanned: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct texts with valid matches: (row, level, value); per level (level, n_e, n_all: its values); and (row, term, kinds, classes) of their terms.

    Levels of a single value are left out: one value is no evidence, whatever stands beside it.
    """
    own = base.select("row").distinct()
    texts = materialize(scanned.where("size(found) > 0").groupBy("text").agg(F.min("row").alias("row")).join(own, "row", "left_semi"), "pii-texts")
    levels = F.array(F.lit("any"), F.col("kind"), F.concat_ws(":", "kind", "class"))
    held = base.join(texts.select("row"), "row", "left_semi").select("row", F.explode(levels).alias("level"), F.xxhash64("kind", "value").alias("value")).distinct()
    held = materialize(held, "pii-held")
    values = held.select("level", "value").distinct().groupBy("level").agg(F.count("*").alias("n_all"))
    n_e = held.select("level", "row").distinct().groupBy("level").agg(F.count("*").alias("n_e"))
    n_e = materialize(n_e.join(values.where("n_all > 1"), "level"), "pii-levels")
    is_class = F.col("level").contains(":")
    kinds = F.collect_set(F.when(~is_class & (F.col("level") != "any"), F.col("level")))
    of_row = held.join(n_e, "level", "left_semi").groupBy("row").agg(kinds.alias("kinds"), F.collect_set(F.when(is_class, F.col("level"))).alias("classes"))
    terms = texts.join(of_row, "row").select("row", F.explode(terms_of(F.col("text"))).alias("term"), "kinds", "classes")
    return held, n_e, materialize(terms.withColumn("piece", salt(F.col("row"))), "pii-pairs")


def disclosing(docs: DataFrame, scanned: DataFrame, base: DataFrame, alpha: float = ALPHA, sure: float = SURE) -> DataFrame:
    """(term, level, n_t, n_e, n_te, n_values, pmi, ic) of the terms that give a level away."""
    held, n_e, once = protected(scanned, base)
    counts, n = term_counts(docs)
    number, total = float(max(1, counts.count())), F.lit(float(max(1, n)))
    with_kind = [F.count_if(F.array_contains("kinds", k)).alias(k) for k in KINDS]
    terms = once.groupBy("term").agg(F.count("*").alias("any"), *with_kind).where(F.col("any") > 1)
    terms = materialize(terms.join(counts, "term"), "pii-both")
    by_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("n_te")) for k in ("any", *KINDS)])).alias("e")
    kinds = terms.select("term", "n_t", by_kind).select("term", "n_t", "e.*").where("n_te > 1")
    # a class is rarer than what holds it: P(any | t) >= P(class | t) >= P(class) ** (1 - alpha) >= (2 / N) ** (1 - alpha)
    possible = terms.where(F.col("any") >= F.col("n_t") * F.pow(2 / total, F.lit(1 - alpha))).select("term", "n_t")
    classed = met(once.where(F.size("classes") > 0), possible, ["term"], "piece").select("term", "n_t", F.explode("classes").alias("level"))
    classes = classed.groupBy("term", "n_t", "level").agg(F.count("*").alias("n_te")).where("n_te > 1").select("term", "n_t", "level", "n_te")
    p, q = F.col("n_e") / total, F.col("n_te") / F.col("n_t")
    pairs = kinds.unionByName(classes).join(n_e, "level").where(p < 1)
    pairs = pairs.withColumn("pmi", F.log2(q / p)).withColumn("ic", -F.log2(p)).where(F.col("pmi") >= alpha * F.col("ic"))
    miss = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(F.lit(0.0))
    pairs = pairs.withColumn("need", q * math.log(sure * number) / (q * F.log(q / p) + miss))
    pairs = materialize(pairs.where("need <= least(n_all, n_te)"), "pii-likely")
    # what is left has terms that are rare outside of the level, but for a level that most texts have
    seen = met(once.select("row", "term", "piece"), pairs.select("term", "level").groupBy("term").agg(F.collect_set("level").alias("levels")), ["term"], "piece")
    seen = seen.select("row", "term", F.explode("levels").alias("level")).join(held, ["row", "level"])
    evidence = seen.select("term", "level", "value").distinct().groupBy("term", "level").agg(F.count("*").alias("n_values"))
    return pairs.join(evidence, ["term", "level"]).where("n_values >= need").select("term", "level", "n_t", "n_e", "n_te", "n_values", "pmi", "ic")


def bit(term: Column, words: int) -> tuple[Column, Column]:
    """A term's place in a filter of 64-bit words: number of the word, and five of its bits."""
    h = F.xxhash64(term)
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * k), F.lit(64)).cast("int"))
    mask = one(0)
    for k in range(1, 5):
        mask = mask.bitwiseOR(one(k))
    return F.pmod(F.shiftright(h, 30), F.lit(words)).cast("int"), mask


def term_bitmap(known: DataFrame) -> tuple[Column, int]:
    """The filter of the terms, as a constant array, and its number of words; at most MOST_WORDS words pass the driver."""
    words, n = 64, known.count()
    while words < min(4 * n, MOST_WORDS):  # 256 bits for each term: one in some 100,000 others passes
        words *= 2
    at, mask = bit(F.col("term"), words)
    full = [0] * words
    for r in known.groupBy(at.alias("at")).agg(F.bit_or(mask).alias("bits")).collect():
        full[r["at"]] = r["bits"]
    return F.from_json(F.lit(json.dumps(full)), "array<bigint>"), words


def term_spans(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(k1, k2, given): for each text that holds one, the places (start, end) of the disclosing terms."""
    known = materialize(known.select("term").distinct(), "pii-known")
    bitmap, words = term_bitmap(known)

    def may(t: Column) -> Column:
        at, mask = bit(t, words)
        return F.get(bitmap, at).bitwiseAND(mask) == mask

    rows = docs.select(whole_text().alias("text")).withColumn("terms", terms_of(F.col("text"))).withColumn("terms", F.filter("terms", may))
    likely = rows.where(F.size("terms") > 0).groupBy("text").agg(F.first("terms").alias("terms"))
    likely = materialize(likely.select(*keys(F.col("text")), "text", "terms"), "pii-likely-texts")
    held = likely.select("k1", "k2", F.explode("terms").alias("term"), salt(F.col("k1")).alias("piece"))
    held = met(held, known, ["term"], "piece").groupBy("k1", "k2").agg(F.collect_set("term").alias("held"))
    places = F.arrays_zip(F.regexp_extract_all("text", F.lit(rf"\G(?s:.*?){TERM}"), F.lit(0)).alias("chunk"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("match"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p["chunk"])
        span = F.struct((end - F.length(p["match"])).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.array_contains("held", F.lower(p["match"])), F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    return likely.drop("terms").join(held, ["k1", "k2"]).select("k1", "k2", F.aggregate(places, start, step, lambda a: a["out"]).alias("given"))


def pii(docs: DataFrame, keep_text: bool = False, alpha: float = ALPHA, sure: float = SURE) -> DataFrame:
    """Per document: doc_id, spans (array of (at, start, end, kind) in order of kind, then start) and, if kept, text."""
    scanned = scan(docs, keep_text)
    base = occurrences(scanned)
    at = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    by_row = base.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "start", "end", "kind"))).alias("base"))
    given = materialize(term_spans(docs, disclosing(docs, scanned, base, alpha, sure)), "pii-given")
    text = ["text"] if keep_text else []
    rows = scanned.select("row", "piece", "doc_id", "k1", "k2", *text)
    rows = met(rows, given, ["k1", "k2"], "piece", "left").join(by_row, "row", "left")
    empty = F.array().cast("array<struct<at:int,start:int,end:int,kind:string>>")
    base = F.coalesce("base", empty)
    free = F.filter("given", lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    terms = F.transform(free, lambda t: F.struct(F.lit(len(KINDS) + 1).alias("at"), t["start"].alias("start"), t["end"].alias("end"), F.lit("term").alias("kind")))
    return rows.select("doc_id", *text, F.concat(base, F.coalesce(terms, empty)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, base_sha256 and all spans as one string."""
    show = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *[count(k) for k in KINDS], count("term"), F.sha2(show(base), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text with every base span generalised to ``[KIND]`` and disclosing terms removed (``[TERM]``); of overlapping spans the leftmost, longest counts."""
    found = pii(docs, keep_text=True, **options)
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    rest = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(a: Column, s: Column) -> Column:
        new = F.struct(F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), (-s["less"]).alias("at"))
        return F.when(s["start"] >= a["at"], new).otherwise(a)

    out = F.aggregate(order, rest, put, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)))
    return found.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(out).alias("text"))
