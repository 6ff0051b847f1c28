"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, exact_dedup, gif, html_text, lexical, mixing, pii, quality, simhash, spelling, toxicity, url_filter
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digests(chat_format.format_chats(turns.unionByName(more)))


def vocabulary() -> str:
    """The place of the rank file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), ids=False)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.pii(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("perplexity")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("copies", lambda c: c["shard"].cast("string")), ",")
    return found.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_dedup(table(spark, sf_dir, "documents")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(gif.stored(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_html_text": op7_html_text,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_lexical": op12_lexical,
    "op13_gif": op13_gif,
}


def url_sql() -> str:
    """The URL filter's verdicts from the same rules, without an index."""
    listed = sorted(url_filter.LISTED, key=lambda r: (-len(r.name), r.name))
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    case = lambda of, other: "case " + " ".join(f"when regexp_matches(spot, {quote(r.pattern)}) then {quote(of(r))}" for r in listed) + f" else {other} end"
    spam = " or ".join(f"regexp_matches(spot, {quote(r.pattern)})" for r in url_filter.PATTERNS)
    wanted = ", ".join(quote(t) for t in sorted({t for r in (*url_filter.LISTED, *url_filter.PATTERNS) for t in r.tokens}))
    rules = ", ".join(f"({k}, [{', '.join(map(quote, r.tokens))}])" for k, r in enumerate((*url_filter.LISTED, *url_filter.PATTERNS)))
    return rf"""
with rest as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, lower(regexp_extract(rest, '^[^/?#]*')) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
urls as (select *, host || path as spot, list_distinct(list_filter(regexp_split_to_array(lower(host || path), '[^a-z0-9]+'), lambda t: t in ({wanted}))) as tokens from parts),
counts as (select token, count(*) as n from (select unnest(tokens) as token from urls) group by token),
rules(k, tokens) as (values {rules}),
indexed as (select k, arg_min(token, (coalesce(n, 0), token)) as token from (select k, unnest(tokens) as token from rules) left join counts using (token) group by k),
fetched as (select token, count(*) as n from indexed group by token)
select page_id, host, path, {case(lambda r: r.name, "null")} as rule,
  {case(lambda r: r.verdict, f"case when {spam} then 'block' else 'allow' end")} as verdict,
  coalesce((select sum(n) from fetched where list_contains(tokens, token)), 0)::bigint as n_candidates
from urls"""


_DOCS = r"""
rows as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)"""

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown as (
  select *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g') as safe_text,
    regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g') as safe_role from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(safe_text) + length(safe_role) + 20)::bigint as formatted_chars,
  bool_or(safe_text <> text or safe_role <> role) as escaped, true as round_trip
from shown group by conv_id""",
    "op3_exact_dedup": f"""
with {_DOCS},
ranked as (
  select *, count(*) over (partition by norm) as n, first_value(doc_id) over w as keep_id, row_number() over w as rank
  from rows window w as (partition by norm order by length(text) desc, doc_id nulls last))
select doc_id, keep_id, n::bigint as group_size, rank = 1 as kept, sha256(norm) as text_sha256 from ranked""",
    "op9_url_filter": url_sql(),
    "op12_lexical": r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
asked as (
  select item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
total as (select count(*) as docs, sum(len(terms)) as length from docs where len(terms) > 0),
lengths as (select r, doc_id, 100 - 90 + ((90 * len(terms) * docs) // length) as m from docs, total where len(terms) > 0),
postings as (select r, term, count(*) as tf from (select r, unnest(terms) as term from docs) where term in (select term from asked) group by r, term),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, total group by term),
scored as (
  select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join postings using (term) join weights using (term) join lengths using (r) group by all)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10""",
}
