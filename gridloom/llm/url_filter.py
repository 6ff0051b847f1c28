r"""URL filter: pattern rules indexed by their rarest literal token (native).

A rule is a regular expression over ``host || path`` with the literal tokens
that any matching URL must hold.  Of these, the one rarest among the URLs at
hand indexes the rule.  A URL's own tokens fetch candidate rules, and only
those run their expressions; a URL without an indexing token runs none.

Tokens are maximal runs of ``[a-z0-9]`` in the lower-cased host and path.  Rules
are a table (``RULE`` columns; ``read_rules`` loads one from a JSON file, the
default is made from the lists below), of any number: the index is a table of
(token, rule) that URLs' tokens meet in a join.  An index of at most
``BROADCAST`` rules and ``BROADCAST_CHARS`` characters (both checked) is
broadcast, so URLs stay where they are; a larger one is met by (token, piece).  A rule
without tokens is a candidate for every URL.

Rules with a host and a path ("listed" rules) go before the other patterns; of
the listed rules that fit, the longest wins (ties: the first name).  A URL that
fits none is blocked if one of the other patterns that blocks matches, else
allowed.

Defined results: a null or malformed URL (no ``://``) has empty host and path
and is allowed; very long URLs are taken whole; repeated rows are judged alike,
each in its row; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, met, salt

RULE = "name string, verdict string, pattern string, tokens array<string>, listed boolean"
BROADCAST, BROADCAST_CHARS = 100_000, 16 << 20


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = field(default=False)


def listed_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``."""
    pieces = [t for t in re.split(r"[^a-z0-9]+", host.lower()) if t]
    whole = re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", path.lower())  # a piece that the path's end may cut is no token
    return Rule(host + path, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tuple(pieces + whole), True)


def word_rule(*words: str) -> Rule:
    """Blocks URLs in which the words stand in a row, as whole tokens."""
    name = "-".join(words)
    return Rule(name, "block", rf"(?i)(?:^|[^a-z0-9]){'[^a-z0-9]+'.join(words)}(?:$|[^a-z0-9])", tuple(words))


LISTED = (
    listed_rule("allow", "com", "/"),
    listed_rule("block", "example.com", "/en/"),
    listed_rule("allow", "www.example.com", "/en/"),
    listed_rule("block", "net", "/es/"),
    listed_rule("block", "net", "/fr/"),
)
#: The method's own patterns, for junk and adult hosts and paths.
PATTERNS = tuple(
    word_rule(*words.split())
    for words in (
        "casino", "poker", "viagra", "cialis", "cheap pills", "pills online", "porn", "xxx", "adult dating", "escort", "payday loan",
        "warez", "torrent", "keygen", "crack download", "free money", "replica watches", "spam", "malware", "phishing", "click bait", "link farm",
    )
)


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(host: str = "host", path: str = "path") -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.concat(host, path)), "[^a-z0-9]+"), lambda t: t != ""))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = (*LISTED, *PATTERNS)) -> DataFrame:
    """Rules written in code, as a table; made by an expression, so no Python worker is needed."""
    text = json.dumps([{"name": r.name, "verdict": r.verdict, "pattern": r.pattern, "tokens": r.tokens, "listed": r.listed} for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{RULE}>>")))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A table of rules from a file of JSON lines with the ``RULE`` columns."""
    return spark.read.schema(RULE).json(path)


def index_of(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, rule): each rule by its token that fewest URLs hold (ties: by the token); the empty token for a rule without any."""
    rules = rules.select(F.struct("name", "verdict", "pattern", "listed").alias("rule"), F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    wanted = materialize(rules.distinct(), "url-rules")
    counts = urls.select(F.explode(url_tokens()).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rated = wanted.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    return materialize(rated.select("rarest.token", "rule"), "url-index")


def candidates(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(row, spot, rule): the rules that a URL's tokens fetch."""
    tokens = urls.select("row", F.concat("host", "path").alias("spot"), F.explode(F.concat(url_tokens(), F.array(F.lit("")))).alias("token"))
    size = index.agg(F.count("*"), F.sum(F.length("rule.pattern") + F.length("rule.name"))).first()
    if size[0] <= BROADCAST and (size[1] or 0) <= BROADCAST_CHARS:
        return tokens.join(F.broadcast(index), "token")
    rules = index.groupBy("token").agg(F.collect_list("rule").alias("rules"))
    return met(tokens.withColumn("piece", salt(F.col("row"))), rules, ["token"], "piece").select("row", "spot", F.explode("rules").alias("rule"))


def url_filter(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule (a listed rule or null), verdict, n_candidates (expressions that were run)."""
    host, path = host_path(F.col("url"))
    urls = materialize(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path")), "urls")
    index = index_of(rule_table(pages.sparkSession) if rules is None else rules, urls)
    tried = candidates(urls, index).select("row", "rule", F.expr("spot rlike rule.pattern").alias("hit"))
    listed = F.when(F.col("hit") & F.col("rule.listed"), F.struct((-F.length("rule.name")).alias("less"), F.col("rule.name").alias("name"), F.col("rule.verdict").alias("verdict")))
    spam = F.col("hit") & ~F.col("rule.listed") & (F.col("rule.verdict") == "block")
    judged = tried.groupBy("row").agg(F.count("*").alias("n"), F.min(listed).alias("best"), F.max(spam).alias("spam"))
    verdict = F.coalesce("best.verdict", F.when(F.col("spam"), "block").otherwise("allow"))
    return urls.join(judged, "row", "left").select("page_id", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"))
