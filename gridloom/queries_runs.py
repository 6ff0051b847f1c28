"""Queries over whole runs: splits packed with a tokenizer, inference through adapters, artifacts and orders.

What a model would say is a digest of all that it was asked with, so the SQL can say it too.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import grids
from .functions.text import sha256
from .functions.tokens import Ranked, from_loader
from .operators import corpus, cost, inference, migration, token_records
from .plans import external, variants
from .plans.ranges import numbered
from .queries import _CHATS, _CORPUS, _KEY_SQL, _TASKS, SEED, conversations, corpus_rows, query, rotated_plan, rotation, task_sizes, tasks
from .sources import artifacts, files, invariants
from .sources.shared import new_folder, written

lit, col = F.lit, F.col


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- splits -----------------------------------------------------------------------------


@functools.cache
def ranked() -> Ranked:
    """The tokenizer of the registered queries, loaded once a process: ids of joined texts aren't the joined ids."""
    import public_tokenizers

    return Ranked(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, by_lines=True)


def packed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks(spark, sf_dir).select("task_id", F.concat("train", "test").alias("pairs"))
    return external.external_split(rows, ranked, 4, 6, 260, SEED, from_loader(ranked))


@query()
def external_split(spark, sf_dir):
    """Every task's pairs packed into token records, ids and spans by digest."""
    spans = F.array_join(F.transform("assistant_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    found = packed_records(spark, sf_dir)
    taken = F.array_join(F.transform("pair_augmentations", lambda p: F.concat_ws(":", p["source_index"], p["transformation_code"], p["value_mapping"])), ",")
    return found.select("task_id", "place", "variant_id", "n_pairs", "sequence_length", "skipped", "status", sha256(F.array_join("input_ids", ",")).alias("ids_sha256"), spans.alias("spans"), taken.alias("pairs"))


@query("pairs", sql="select count(*) as source_pairs, true as all_sound, true as no_problem, count(distinct task_id) * 4 as records from pairs")
def external_split_counts(spark, sf_dir):
    """Statistics and problems of a written split: all pairs counted, every record sound."""
    records = written(packed_records(spark, sf_dir), "external-split")
    rows = tasks(spark, sf_dir).select("task_id", F.concat("train", "test").alias("pairs"))
    problems = external.split_problems(records, rows).agg((F.count("*") == 0).alias("no_problem"))
    sound = records.agg(F.bool_and(col("status") == "ok").alias("all_sound"), F.count("*").alias("records"))
    return external.split_statistics(records).select("source_pairs").join(sound).join(problems)


# --- inference --------------------------------------------------------------------------


def digesting(adapter: str | None):
    """A stand-in for a model: digests of the adapter, the sampling, the sample's number and the prompt."""

    def generate(prompts, sampling):
        n = sampling.get("n", 1)
        said = "|".join([adapter or "", str(round(10 * sampling["temperature"])), str(sampling["max_tokens"]), str(sampling.get("seed", ""))])
        text = lambda p, k: hashlib.sha256(f"{said}|{k}|{p}".encode()).hexdigest()
        return [[{"text": text(p, k), "token_ids": [1, 2, 3], "finish_reason": "length"} for k in range(n)] for p in prompts]

    return generate


def sampling() -> F.Column:
    """One of twelve ways to sample, by document."""
    k = col("doc_id")
    return F.struct((k % 2 + 1).cast("double").alias("temperature"), lit(1.0).alias("top_p"), (k % 3 + 10).cast("int").alias("max_tokens"), F.when(k % 4 > 0, k % 2).alias("seed"))


_SAID = "concat(cast((doc_id % 2 + 1) * 10 as varchar), '|', cast(doc_id % 3 + 10 as varchar), '|', case when doc_id % 4 > 0 then cast(doc_id % 2 as varchar) else '' end)"


@query(sql=f"select cast(doc_id as varchar) as request_id, sha256(concat('|', {_SAID}, '|0|', coalesce(text, ''))) as text, 3::bigint as tokens, 'length' as finish_reason, true as in_place from documents")
def sampling_batches(spark, sf_dir):
    """Whole documents as prompts of twelve ways to sample: answered in batches of one way, in their order."""
    asked = documents(spark, sf_dir).select(col("doc_id").cast("string").alias("request_id"), F.coalesce("text", lit("")).alias("prompt"), sampling().alias("sampling"))
    found = numbered(inference.in_order(asked, digesting, batch=64, window=512))
    before = numbered(asked.select("request_id"), name="place")
    out = F.get("outputs", lit(0))
    return found.join(before, "request_id").select("request_id", out["text"].alias("text"), out["generated_token_count"].alias("tokens"), out["finish_reason"].alias("finish_reason"), (col("ordinal") == col("place")).alias("in_place"))


@query(sql=f"""select cast(doc_id as varchar) as request_id, coalesce(lang, 'none') as adapter, sha256(coalesce(text, '')) as prompt_sha256, octet_length(encode(coalesce(text, '')))::bigint as prompt_token_count, 2 as sample_count,
 sha256(concat(coalesce(lang, 'none'), '|', {_SAID}, '|0|', coalesce(text, ''))) as first, sha256(concat(coalesce(lang, 'none'), '|', {_SAID}, '|1|', coalesce(text, ''))) as second, true as few_loads from documents""")
def adapter_generation(spark, sf_dir):
    """A run through adapters over all documents, written in parts and read back; adapters are loaded once a task."""
    asked = documents(spark, sf_dir).select(
        col("doc_id").cast("string").alias("request_id"), F.coalesce("lang", lit("none")).alias("adapter"), F.coalesce("text", lit("")).alias("prompt"), lit(2).alias("samples"), sampling().alias("sampling")
    )
    path = new_folder(spark, "adapter-run")
    manifest = inference.adapter_run(asked, digesting, path, {"protocol": "standard32"}, most=1 << 20, waves=2)
    found = inference.read_run(spark, path)
    busy = found.select(F.input_file_name().alias("f"), "task").distinct().count()
    few = manifest["load_count"] <= busy + manifest["adapter_count"] + 2
    text = lambda k: F.get("outputs", lit(k))["text"]
    return found.select("request_id", "adapter", "prompt_sha256", "prompt_token_count", "sample_count", text(0).alias("first"), text(1).alias("second"), lit(few).alias("few_loads"))


# --- artifacts --------------------------------------------------------------------------


@query(sql="select doc_id, row_number() over (order by doc_id) - 1 as ordinal, sha256(coalesce(text, '')) as text_sha256 from documents")
def artifact_documents(spark, sf_dir):
    """All documents as an artifact of parts: digest taken from what is written, verified, and read back in order."""
    path = new_folder(spark, "artifact")
    artifacts.write_artifact(documents(spark, sf_dir).select("doc_id", "text"), path, {"kind": "documents"}, "doc_id", rows=1000)
    artifacts.verified(spark, path, kind="documents")
    back = artifacts.read_artifact(spark, path, "doc_id long, text string", kind="documents")
    return back.select("doc_id", "ordinal", sha256(F.coalesce("text", lit(""))).alias("text_sha256"))


@query("pairs", sql="select task_id, row_number() over (order by task_id) - 1 as ordinal, n_train from (select task_id, min(n_train) as n_train from pairs group by 1)")
def artifact_tasks(spark, sf_dir):
    """Tasks, a line each, in order of their names."""
    path = new_folder(spark, "artifact")
    artifacts.write_artifact(tasks(spark, sf_dir).select("task_id", "train"), path, {"kind": "tasks"}, "task_id", rows=500)
    back = artifacts.read_artifact(spark, path, "task_id string, train array<struct<input:array<array<int>>,output:array<array<int>>>>", kind="tasks")
    return back.select("task_id", "ordinal", F.size("train").alias("n_train"))


@query(sql="select count(*) as \"rows\", count_if(text is null or text = '') as empty, count_if(contains(text, '@')) as with_at, count_if(lang = 'en') as english from documents")
def counted_write(spark, sf_dir):
    """JSON lines of all documents, counted as they are written."""
    path = new_folder(spark, "counted")
    counts = artifacts.counted_write(documents(spark, sf_dir), lambda df: files.write_lines(df, path), empty=col("text").isNull() | (col("text") == ""), with_at=F.contains("text", lit("@")), english=col("lang") == "en")
    return documents(spark, sf_dir).limit(1).select(*[lit(n).alias(name) for name, n in counts.items()])


def document_lines(spark: SparkSession, sf_dir: str) -> str:
    """Documents as JSON lines, 500 a file in order of doc_id; every seventh is broken off."""
    path = new_folder(spark, "lines")
    line = F.to_json(F.struct(F.concat(lit("d"), col("doc_id").cast("string"), lit(".json")).alias("task_id"), "text"))
    rows = numbered(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").select("ordinal", F.when(col("doc_id") % 7 == 0, F.substr(line, lit(1), F.length(line) - 1)).otherwise(line).alias("value"))
    part = F.lpad(F.floor(col("ordinal") / 500).cast("string"), 9, "0")
    rows.withColumn("part", part).repartition("part").sortWithinPartitions("part", "ordinal").select("part", "value").write.partitionBy("part").text(path)
    return path


_LINES = "with placed as (select *, row_number() over (order by doc_id) - 1 as k from documents)"


@query(sql=f"{_LINES} select k // 500 as part, k % 500 + 1 as line from placed where doc_id % 7 = 0")
def bad_line_places(spark, sf_dir):
    """File and line of lines that are no JSON."""
    rows = artifacts.malformed_places(spark, document_lines(spark, sf_dir))
    return rows.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), "line")


@query(sql=f"{_LINES} select case when doc_id % 7 > 0 then concat('d', cast(doc_id as varchar)) end as task_id, k as ordinal from placed")
def ordered_ids(spark, sf_dir):
    """Ids of a list in its order, over many files; a line that is broken has none."""
    return artifacts.read_ordered_ids(spark, document_lines(spark, sf_dir))


# --- seeded orders -----------------------------------------------------------------------


@query()
def seeded_order(spark, sf_dir):
    """All tasks in the order of a seed."""
    return variants.seeded_order(tasks(spark, sf_dir), SEED)


@query("traces", sql=_CORPUS + "select count(*) as n, count(*) - 1 as last, true as distinct_places from ranked where place = 1")
def seeded_epoch(spark, sf_dir):
    """An epoch's variants with their tasks' places in the seeded order."""
    rows = corpus.selected(corpus_rows(spark, sf_dir), 4, SEED)
    tasks_ = rows.where("rank = 1").select("task_id")
    found = variants.seeded_epoch(rows.join(tasks_, "task_id", "left_semi"), 1, SEED)
    return found.agg(F.count("*").alias("n"), F.max("place").alias("last"), (F.count_distinct("place") == F.count("*")).alias("distinct_places"))


# --- records and caches --------------------------------------------------------------------


#: By document: what is wrong with its result, as SQL.
_DEFECTS = """case doc_id % 9 when 1 then 'blank:task_id' when 2 then 'unknown_value:stage' when 3 then 'missing:model' when 4 then 'negative:usage.prompt_tokens' when 5 then 'kind:usage.total_tokens'
 when 6 then 'unknown:note,unknown:usage.cost' when 7 then 'kind:few_shot_task_ids[],out_of_range:sampling.top_p' when 8 then 'no_json' end"""


@query(sql=f"{_LINES} select doc_id, {_DEFECTS} as violations from placed where doc_id % 9 > 0")
def record_violations(spark, sf_dir):
    """Whole documents as results with eight planted defects, all of which are named."""
    k = col("doc_id") % 9
    bad = lambda n, value, other: F.when(k == n, value).otherwise(other)
    record = F.struct(
        col("doc_id").cast("string").alias("request_id"), bad(1, lit(" "), lit("t")).alias("task_id"), bad(2, lit("final"), lit("judge")).alias("stage"), lit("local").alias("backend"),
        F.when(k != 3, lit("m")).alias("model"), F.coalesce("text", lit("")).alias("raw_output"), F.when(k == 6, lit(1)).alias("note"),
        F.struct(bad(4, lit(-1), lit(1)).alias("prompt_tokens"), F.when(k != 5, lit(2)).alias("total_tokens"), F.when(k == 6, lit(0.5)).alias("cost")).alias("usage"),
        F.when(k == 7, F.struct(lit(1.5).alias("top_p"))).alias("sampling"),
    )
    line = F.to_json(record)
    line = F.when(k == 5, F.regexp_replace(line, r'"usage":\{', '"usage":{"total_tokens":"2",')).when(k == 7, F.concat(lit('{"few_shot_task_ids":["a",7],'), F.substr(line, lit(2)))).when(k == 8, F.substr(line, lit(1), F.length(line) - 1)).otherwise(line)
    path = new_folder(spark, "records")
    # the number stands before the line, to be told apart from what is read of it
    rows = documents(spark, sf_dir).select("doc_id", line.alias("value"))
    part = F.lpad(F.floor(col("ordinal") / 500).cast("string"), 9, "0")
    numbered(rows, "doc_id").withColumn("part", part).repartition("part").sortWithinPartitions("part", "ordinal").select("part", "value").write.partitionBy("part").text(path)
    found = invariants.bad_results(spark, path).withColumn("ordinal", F.regexp_extract("file", "part=([0-9]+)", 1).cast("long") * 500 + col("line") - 1)
    return found.join(numbered(rows.select("doc_id"), "doc_id"), "ordinal").select("doc_id", F.array_join("violations", ",").alias("violations"))


_CONTRACT = {"seed": SEED, "data": {"max_sequence_length": 1 << 20, "delimiter": ""}, "model": {"name": "bytes", "revision": None}}


@query("pairs", sql=_CHATS + "select count(*) as records, sum(n)::bigint as tokens, 5 as refused from chats where cast(substr(task_id, 2) as bigint) % 5 = 0")
def cache_under_contract(spark, sf_dir):
    """One split of a token cache; the cache is refused under another version, kind, setting, split or none."""
    path, number = new_folder(spark, "cache"), F.substr(col("task_id"), lit(2)).cast("long")
    rows = token_records.adaptation_records(conversations(spark, sf_dir).withColumn("pairs", col("train")), 1 << 20)
    kept = rows.select(F.when(number % 5 == 0, "validation").otherwise("training").alias("split"), "task_id", col("task_id").alias("variant_id"), "input_ids", col("assistant_spans").alias("spans"), "sequence_length")
    token_records.write_cache(kept, path, {"kind": "adaptation", "contract": _CONTRACT})
    both, refused = ("training", "validation"), 0
    others = [(path, "prediction", _CONTRACT, both), (path, "adaptation", {**_CONTRACT, "seed": SEED + 1}, both), (path, "adaptation", {**_CONTRACT, "model": {"name": "bytes", "revision": "x"}}, both), (path, "adaptation", _CONTRACT, token_records.SPLITS), (f"{path}-none", "adaptation", _CONTRACT, both)]
    for place, kind, contract, splits in others:
        try:
            token_records.read_cache(spark, place, "validation", kind, contract, splits)
        except token_records.OtherCache:
            refused += 1
    found = token_records.read_cache(spark, path, "validation", "adaptation", _CONTRACT, both)
    return found.agg(F.count("*").alias("records"), F.sum("sequence_length").alias("tokens")).withColumn("refused", lit(refused))


# --- tasks and resources ---------------------------------------------------------------------


def number() -> F.Column:
    return F.substr(col("task_id"), lit(2)).cast("long")


#: SQL: the number of a task.
_NUMBER = "cast(substr(task_id, 2) as bigint)"


@query("pairs", sql="select task_id, count(*) filter (where split = 'train')::int as train, count(*) filter (where split = 'test')::int as test, sha256(string_agg(concat(split, ':', input_text, '>', output_text), ';' order by split desc, pair_index)) as pairs_sha256 from pairs group by 1")
def labelled_pairs(spark, sf_dir):
    """All pairs of every task, train pairs first, each with its split."""
    shown = F.array_join(F.transform("pairs", lambda p: F.concat(p["split"], lit(":"), grids.grid_text(p["input"], ""), lit(">"), grids.grid_text(p["output"], ""))), ";")
    of = lambda s: F.size(F.filter("pairs", lambda p: p["split"] == s)).alias(s)
    return corpus.labelled_pairs(tasks(spark, sf_dir)).select("task_id", of("train"), of("test"), sha256(shown).alias("pairs_sha256"))


@query("pairs", sql=f"""select task_id, string_agg(case when {_NUMBER} % 2 = 0 then translate({fixtures.shape("input_text", "cba/fed")}, '0123456789', {fixtures.rotation(f"{_NUMBER} % 10")}) else input_text end, ';' order by split desc, pair_index) as inputs from pairs group by 1""")
def whole_views(spark, sf_dir):
    """Every task's pairs under a view: mirrored and recoloured, or as they are where a view has no code."""
    views = task_sizes(spark, sf_dir).select("task_id", F.when(number() % 2 == 0, "FV").alias("code"), F.when(number() % 2 == 0, rotation(number() % 10)).alias("value_mapping"))
    return corpus.whole_views(views, tasks(spark, sf_dir)).select("task_id", F.array_join(F.transform("pairs", lambda p: grids.grid_text(p["input"], "")), ";").alias("inputs"))


@query("pairs", sql=_TASKS + f"select count(*) as task_count, count_if({_NUMBER} % 3 > 0) as completed_task_count, (64 * count_if({_NUMBER} % 3 > 0))::bigint as optimizer_updates, sum(case when {_NUMBER} % 3 > 0 then n_train * 100 else 0 end)::bigint as processed_tokens, sum(case when {_NUMBER} % 3 > 0 then n_train * 7 else 0 end)::bigint as target_tokens from own")
def adaptation_totals(spark, sf_dir):
    """Totals of a run's adapters, a third of which aren't there."""
    sizes = task_sizes(spark, sf_dir)
    made = sizes.where(number() % 3 > 0).select("task_id", lit(64).alias("optimizer_updates"), (col("n_pairs") * 100).alias("processed_tokens"), (col("n_pairs") * 7).alias("target_tokens"))
    return cost.adaptation_summary(made, sizes)


@query("pairs", sql=_TASKS + f"""select task_id, case when {_NUMBER} % 2 = 0 then 'legacy_training_2024' else 'training_2025_addition' end as corpus_partition, case {_NUMBER} % 3 when 0 then 'complete' when 1 then 'incomplete' else 'missing' end as hint_status,
  case when {_NUMBER} % 3 = 0 then 'provided' else 'none' end as hint_mode, {_NUMBER} % 5 = 0 as few_shot_pool from own""")
def task_manifest(spark, sf_dir):
    """A row for each task: its partition, hint and place in the pool."""
    rows = task_sizes(spark, sf_dir).select("task_id")
    hints = rows.where(number() % 3 < 2).withColumn("status", F.when(number() % 3 == 0, "complete").otherwise("incomplete"))
    found = migration.task_manifest(rows, rows.where(number() % 2 == 0), hints, rows.where(number() % 5 == 0))
    return found.select("task_id", "corpus_partition", "hint_status", "hint_mode", "few_shot_pool")


@query("pairs", sql=_TASKS + f"""select task_id, 'in one view only' as problem from own where {_NUMBER} % 7 = 0 union all select task_id, 'in training' from own where {_NUMBER} % 11 = 0
 union all select {_KEY_SQL} as task_id, 'not an augmented key' from own, range(64) as q(v) where false""")
def validation_pairs(spark, sf_dir):
    """Validation tasks that have one view only, or are trained on."""
    rows = task_sizes(spark, sf_dir).select(col("task_id").alias("key"), lit("t").alias("trace"))
    seen = rotated_plan(spark, sf_dir).where((col("variant_index") == 7) & (number() % 7 > 0)).select(variants.view_key().alias("key"), lit("t").alias("trace"))
    return migration.validation_problems(rows, seen, task_sizes(spark, sf_dir).where(number() % 11 == 0))
