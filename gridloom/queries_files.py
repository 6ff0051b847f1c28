"""Queries that write files and read them back, and queries over the records of runs.

What is written goes to the shared folder; the SQL says what must come back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import grids, keys
from .functions.text import sha256
from .operators import cost, execution, judging, requests, token_records
from .plans import variants
from .queries import _CHATS, _KEY_SQL, _NORMAL, _TASKS, candidates, conversations, query, rotated_plan, tasks, trace_rows
from .sources import files, records, schemas
from .sources.shared import shared_dir, write_text

lit, col = F.lit, F.col


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def nation_files(spark: SparkSession, sf_dir: str, name: str, value) -> str:
    """One JSON file per nation (25 in all) in a new folder; ``value`` makes its content of a row."""
    folder = new_folder(spark, name)
    for n in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect():
        write_text(spark, f"{folder}/n{n['n_nationkey']}.json", json.dumps(value(n)))
    return folder


# --- one file per task ----------------------------------------------------------------


def nation_task(n) -> dict:
    pair = lambda k: {"input": [[k % 10, n["n_regionkey"]]], "output": [[n["n_regionkey"], k % 10]]}
    return {"train": [pair(n["n_nationkey"]), pair(n["n_nationkey"] + 1)], "test": [pair(n["n_nationkey"] + 2)]}


@query(sql="""
select concat('n', cast(n_nationkey as varchar)) as task_id, case when k < 2 then 'train' else 'test' end as split, cast(case when k < 2 then k else 0 end as int) as pair_index,
 concat(cast((n_nationkey + k) % 10 as varchar), cast(n_regionkey as varchar)) as input, concat(cast(n_regionkey as varchar), cast((n_nationkey + k) % 10 as varchar)) as output from nation, range(3) as r(k)""")
def task_files(spark, sf_dir):
    """Tasks of one file each, as one row per pair."""
    rows = files.long_form(files.read_tasks(spark, nation_files(spark, sf_dir, "task-files", nation_task)))
    return rows.select("task_id", "split", "pair_index", grids.grid_text(col("input"), "").alias("input"), grids.grid_text(col("output"), "").alias("output"))


@query(sql="select concat('n', cast(n_nationkey as varchar)) as stem, n_regionkey::bigint as region from nation")
def record_files(spark, sf_dir):
    """JSON files of any shape, by stem."""
    rows = files.read_records(spark, nation_files(spark, sf_dir, "record-files", lambda n: {"region": n["n_regionkey"]}))
    return rows.select("stem", F.try_variant_get("record", "$.region", "bigint").alias("region"))


@query(sql="""
select concat('n', cast(n_nationkey as varchar)) as task_id, case when n_nationkey % 5 = 0 then 'complete' else 'incomplete' end as status,
 case n_nationkey % 5 when 0 then '' when 4 then 'general,inputs,outputs,transformation,transformation_steps' else 'outputs' end as missing from nation""")
def hint_folder(spark, sf_dir):
    """A folder of hints, some in lists, some blank in one field, some without any."""

    def hint(n):
        k = n["n_nationkey"] % 5
        whole = {f: n["n_name"] for f in files.HINT_FIELDS}
        return [whole, {}] if k == 0 else {} if k == 4 else {**whole, "outputs": (" \n", 7, None)[k - 1]}

    rows = files.read_hint_folder(spark, nation_files(spark, sf_dir, "hint-folder", hint))
    return rows.select("task_id", "status", F.array_join("missing_fields", ",").alias("missing"))


@query(sql="""
select concat('n', cast(n_nationkey as varchar), case when k = 1 then '.test' else '' end) as task_id from nation, range(2) as r(k) where k = 0 or n_nationkey % 2 = 0""")
def task_lists(spark, sf_dir):
    """Task ids of a JSON list and of JSON lines."""
    folder = new_folder(spark, "task-lists")
    ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect()]
    write_text(spark, f"{folder}/all.json", json.dumps([f" n{k}.json " for k in ids]))
    write_text(spark, f"{folder}/some.jsonl", "\n\n".join(json.dumps({"task_id": f"n{k}.test"}) if k % 4 else json.dumps(f"n{k}.test.json") for k in ids if k % 2 == 0) + "\n")
    return files.read_task_ids(spark, f"{folder}/all.json").union(files.read_task_ids(spark, f"{folder}/some.jsonl"))


# --- JSON lines ---------------------------------------------------------------------


@query(sql="select doc_id, sha256(coalesce(text, '')) as text_sha256, text is null as no_text from documents")
def result_lines(spark, sf_dir):
    """Whole texts as result records in JSON lines and back."""
    path, docs = new_folder(spark, "result-lines"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    files.write_lines(docs.select(col("doc_id").cast("string").alias("request_id"), col("text").alias("raw_output"), F.struct(lit(1).cast("bigint").alias("prompt_tokens")).alias("usage")), path)
    rows = files.read_lines(spark, path, schemas.RESULT)
    return rows.select(col("request_id").cast("bigint").alias("doc_id"), sha256(F.coalesce("raw_output", lit(""))).alias("text_sha256"), col("raw_output").isNull().alias("no_text"))


def guidance_lines(spark: SparkSession, sf_dir: str) -> str:
    """Traces as reasoning records under three names of the text."""
    path, rows, k = new_folder(spark, "guidance-lines"), trace_rows(spark, sf_dir), col("doc_id") % 3
    named = [F.when(k == i, col("trace")).alias(name) for i, name in enumerate(("guidance", "trace", "raw_output"))]
    files.write_lines(rows.select(F.concat(lit("d"), col("doc_id").cast("string")).alias("request_id"), *named), path)
    return path


#: SQL: what follows the private block of a trace, where it is guidance.
_SUMMARY = "case class when 7 then replace(concat(description, chr(10), steps), chr(10), concat(chr(13), chr(10))) when 4 then concat(description, chr(10), steps, chr(10), '```') when 8 then concat(description, chr(10), '   ', '• point', chr(10), '—  more', chr(10), steps) when 9 then null when 1 then null else concat(description, chr(10), steps) end"


@query("traces", sql=f"select concat('d', cast(doc_id as varchar)) as key, case class when 1 then trim(trace, chr(10) || ' ') else {_SUMMARY} end as guidance from traces join parts using (doc_id, lang, source, class)")
def guidance_file(spark, sf_dir):
    return files.read_guidance(spark, guidance_lines(spark, sf_dir))


@query("traces", sql=f"select count(*) as records, count({_SUMMARY}) + count_if(class = 1) as texts, 0::bigint as blocks from traces join parts using (doc_id, lang, source, class)")
def adaptation_guidance_file(spark, sf_dir):
    """No private block is left in what adaptation is told."""
    rows = files.read_adaptation_guidance(spark, guidance_lines(spark, sf_dir))
    return rows.agg(F.count("*").alias("records"), F.count("guidance").alias("texts"), F.count_if(F.contains("guidance", lit("</think>"))).alias("blocks"))


@query("pairs", "draws", sql="select task_id, test_index, sample_index, class from draws")
def prediction_lines(spark, sf_dir):
    """Predictions as nested records, one line per request, and back as one row per sample."""
    path, rows = new_folder(spark, "prediction-lines"), candidates(spark, sf_dir)
    out = F.struct("sample_index", "text", col("class").cast("bigint").alias("generated_token_count"))
    variant = F.struct(col("code").alias("transformation_code"), "value_mapping", "task_id")
    files.write_lines(rows.groupBy("request_id", "task_id", "test_index", variant.alias("variant")).agg(F.sort_array(F.collect_list(out)).alias("outputs")), path)
    back = files.candidates(files.read_lines(spark, path, schemas.PREDICTION))
    return back.select("task_id", "test_index", "sample_index", col("generated_tokens").cast("int").alias("class"))


@query(sql="select conv_id, count(*) as n_messages, sha256(string_agg(concat('[', role, ']', chr(10), coalesce(text, '')), concat(chr(10), chr(10)) order by turn)) as text_sha256 from conversations where conv_id is not null group by 1")
def request_lines(spark, sf_dir):
    """Conversations as requests in JSON lines and back, rendered for reading."""
    path, rows = new_folder(spark, "request-lines"), spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", lit("")).alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    files.write_lines(rows.groupBy(col("conv_id").cast("string").alias("request_id")).agg(said.alias("messages")), path)
    back = files.read_lines(spark, path, schemas.REQUEST)
    shown = requests.rendered(back).select("request_id", sha256(col("text")).alias("text_sha256"))
    return back.select("request_id", F.size(requests.chat_messages(col("messages"))).cast("bigint").alias("n_messages")).join(shown, "request_id").select(col("request_id").cast("bigint").alias("conv_id"), "n_messages", "text_sha256")


@query("pairs", sql=f"{_TASKS} select {_KEY_SQL} as key, v::int as variant_index from own, range(64) as q(v)")
def plan_lines(spark, sf_dir):
    """A plan as records by key, read back and numbered anew."""
    path = new_folder(spark, "plan-lines")
    files.write_lines(rotated_plan(spark, sf_dir).select(variants.view_key().alias("key"), col("variant_index").alias("at")), path, compression="gzip")
    task = F.substring_index("key", "_", 1)
    back = files.read_lines(spark, path, "key string, at int").repartition(fixtures.view_parts(spark, sf_dir), task)  # keys alone, a task's side by side: their parts are taken from them where they meet
    back = back.select("key", "at", task.alias("task_id"), F.inline(F.array(F.struct(keys.parsed_key(col("key"))["code"].alias("code")))))
    return variants.renumbered(back).select("key", "variant_index")


@query("pairs", sql=_CHATS + "select case when cast(substr(task_id, 2) as bigint) % 5 = 0 then 'validation' else 'training' end as split, count(*) as records, min(n)::int as shortest, max(n)::int as longest, sum(n)::bigint as tokens from chats group by 1")
def token_cache(spark, sf_dir):
    """Token records written by split, with a manifest, and read back."""
    path, number = new_folder(spark, "token-cache"), F.substr(col("task_id"), lit(2)).cast("long")
    rows = token_records.adaptation_records(conversations(spark, sf_dir).withColumn("pairs", col("train")), 1 << 20)
    kept = rows.select(F.when(number % 5 == 0, "validation").otherwise("training").alias("split"), "task_id", col("task_id").alias("variant_id"), "input_ids", col("assistant_spans").alias("spans"), "sequence_length")
    token_records.write_cache(kept, path, {"kind": "token_cache"})
    back = records.read_tokens(spark, path)
    return back.groupBy("split").agg(F.count("*").alias("records"), F.min("sequence_length").alias("shortest"), F.max("sequence_length").alias("longest"), F.sum(F.size("input_ids")).alias("tokens"))


# --- whole prompts, rewrites, adapters ---------------------------------------------------


#: SQL: a task's demonstrations as numbered examples.
_SHOWN = """, shown as (select task_id, string_agg(concat('Example ', cast(pair_index + 1 as varchar), chr(10), 'Input:', chr(10), spaced(input_text), chr(10), 'Output:', chr(10), spaced(output_text)), concat(chr(10), chr(10)) order by pair_index) as puzzle from pairs where split = 'train' group by 1)
"""


def spaced(sql: str) -> str:
    """SQL with ``spaced(x)`` written out: a grid text with blanks between its digits."""
    for c in ("input_text", "output_text"):
        sql = sql.replace(f"spaced({c})", f"rtrim(replace(regexp_replace({c}, '([0-9])', '\\1 ', 'g'), concat(' ', chr(10)), chr(10)))")
    return sql


@query("pairs", sql=spaced(_TASKS + _SHOWN + """select task_id, sha256(concat('Worked task ', task_id, chr(10), chr(10), 'Puzzle:', chr(10), puzzle, case when cast(substr(task_id, 2) as bigint) % 2 = 0 then concat(chr(10), chr(10), 'Hint:', chr(10), 'h') else '' end, chr(10), chr(10), 'Reasoning:', chr(10), 't')) as block_sha256 from shown"""))
def few_shot_blocks(spark, sf_dir):
    """Every task as a worked example, digested whole."""
    number = F.substr(col("task_id"), lit(2)).cast("long")
    block = requests.few_shot_block(col("task_id"), grids.examples_text(col("train")), F.when(number % 2 == 0, "h"), lit(" t\n"))
    return tasks(spark, sf_dir).select("task_id", sha256(block).alias("block_sha256"))


@query("pairs", sql=spaced(_TASKS + _SHOWN + """select task_id, sha256(concat('Find the rule that turns each input into its output.', case when cast(substr(task_id, 2) as bigint) % 2 = 0 then ' A hint is given; check it against the examples.' else '' end, chr(10), chr(10), 'Worked examples:', chr(10), chr(10), 's1', chr(10), chr(10), 's2', case when cast(substr(task_id, 2) as bigint) % 2 = 0 then concat(chr(10), chr(10), 'Hint:', chr(10), 'h') else '' end, chr(10), chr(10), 'Puzzle:', chr(10), puzzle)) as prompt_sha256 from shown"""))
def initial_prompts(spark, sf_dir):
    """The whole text of first requests."""
    number = F.substr(col("task_id"), lit(2)).cast("long")
    prompt = requests.initial_prompt(grids.examples_text(col("train")), F.when(number % 2 == 0, "h"), F.array(lit("s1"), lit("s2")))
    return tasks(spark, sf_dir).select("task_id", sha256(prompt).alias("prompt_sha256"))


@query("traces", sql=f"""select doc_id, sha256(concat('Judge the reasoning by these criteria: inputs, outputs, rule, steps, consistency, generality, format, clarity. Answer with a JSON object whose "verdict" is "pass" or "fail".', chr(10), chr(10),
 case when doc_id % 2 = 0 then concat('Hint:', chr(10), 'h', chr(10), chr(10)) else '' end, 'Puzzle:', chr(10), 'p', chr(10), chr(10), 'Reasoning:', chr(10), {_NORMAL})) as prompt_sha256 from parts""")
def judge_prompts(spark, sf_dir):
    """The whole text that judges are asked."""
    rows = judging.normalised_answers(trace_rows(spark, sf_dir).withColumnRenamed("trace", "raw_output"))
    return rows.select("doc_id", sha256(requests.judge_prompt(lit("p"), col("normalized_output"), F.when(col("doc_id") % 2 == 0, "h"))).alias("prompt_sha256"))


@query("pairs", sql=spaced(_TASKS + _SHOWN + """select task_id, sha256(concat('Rewrite the reasoning so that it fits the changed puzzle.', chr(10), chr(10), 'Say each thing once, in few words.', chr(10), chr(10), 'Geometry: each row is reversed.', chr(10), 'w', chr(10), chr(10),
 'Old puzzle:', chr(10), puzzle, chr(10), chr(10), 'Reasoning:', chr(10), 't', chr(10), chr(10), 'New puzzle:', chr(10), puzzle)) as prompt_sha256 from shown"""))
def rewrite_prompts(spark, sf_dir):
    """The whole text of rewrite requests."""
    puzzle = grids.examples_text(col("train"))
    words = F.concat(lit("Geometry: "), lit(requests.GEOMETRY["FV"]), lit(".\nw"))
    return tasks(spark, sf_dir).select("task_id", sha256(requests.rewrite_prompt(puzzle, lit("t"), puzzle, words, lit("concise"))).alias("prompt_sha256"))


@query("pairs", sql=_TASKS + "select task_id, n_train::int as n_pairs, (cast(substr(task_id, 2) as bigint) % 3)::bigint as accepted, (cast(substr(task_id, 2) as bigint) % 3 + 1)::int as n_used, (cast(substr(task_id, 2) as bigint) % 3)::int as last_index from own where cast(substr(task_id, 2) as bigint) % 2 = 0")
def rewrite_sources(spark, sf_dir):
    """Sound results as sources of rewrites, with what was asked for before: one request more than were accepted."""
    number = F.substr(col("task_id"), lit(2)).cast("long")
    base = tasks(spark, sf_dir).withColumn("sound", number % 2 == 0)
    static, quality = (F.struct(x.alias("accepted")) for x in (lit(True), col("sound")))
    results = base.select(F.concat(lit("i-"), col("task_id")).alias("request_id"), "task_id", lit("t").alias("raw_output"), lit("").alias("normalized_output"), lit(None).cast("string").alias("error"), F.struct(static.alias("static"), quality.alias("quality")).alias("validation"))
    each = base.select("task_id", F.explode(F.sequence(lit(0), (number % 3).cast("int"))).alias("k"), (number % 3).alias("n"))
    spec = F.struct(F.concat(lit("i-"), col("task_id")).alias("source_trace_id"), lit("ID").alias("transformation_code"), lit(grids.IDENTITY).alias("value_mapping"), col("k").cast("string").alias("order_mapping"), col("k").alias("variant_index"))
    asked = each.select(F.concat_ws("-", lit("w"), "task_id", col("k").cast("string")).alias("request_id"), spec.alias("augmentation"))
    answers = each.select(F.concat_ws("-", lit("w"), "task_id", col("k").cast("string")).alias("request_id"), lit(None).cast("string").alias("error"), F.struct(F.struct((col("k") < col("n")).alias("accepted")).alias("static")).alias("validation"))
    found = requests.planned_sources(requests.rewrite_sources(results), base, requests.earlier_rewrites(asked, answers))
    return found.select("task_id", "n_pairs", "accepted", F.size("used").alias("n_used"), "last_index")


@query("traces", sql=f"select doc_id, {_NORMAL} as answer from parts")
def judge_answers(spark, sf_dir):
    """Judges' answers undergo the normalisation of traces."""
    rows = judging.normalised_answers(trace_rows(spark, sf_dir).withColumnRenamed("trace", "raw_output"))
    return rows.select("doc_id", col("normalized_output").alias("answer"))


@query("pairs", sql=_TASKS + "select task_id from own where cast(substr(task_id, 2) as bigint) % 6 in (1, 2, 3, 4, 5)")
def unsound_adapters(spark, sf_dir):
    """Of six kinds of training logs, the five that aren't a whole plan."""
    kind = F.substr(col("task_id"), lit(2)).cast("long") % 6
    rows = rotated_plan(spark, sf_dir).withColumn("kind", kind)
    step = F.when((col("kind") == 1) & (col("variant_index") == 63), 63).otherwise(col("variant_index") + 1)
    name = F.when((col("kind") == 2) & (col("variant_index") == 63), "v0").otherwise(F.concat(lit("v"), col("variant_index").cast("string")))
    code = F.when((col("kind") == 3) & (col("variant_index") == 63), "ID").otherwise(col("code"))
    status = F.when((col("kind") != 4) | (col("variant_index") != 7), "provided")
    rows = rows.where((col("kind") != 5) | (col("variant_index") != 9))
    return cost.unsound_adapters(rows.select("task_id", step.alias("step"), name.alias("variant_id"), code.alias("code"), status.alias("guidance_status")))


@query("traces", sql="select count(*) as records, count_if(class not in (1, 9)) as valid, count_if(class in (1, 9)) as malformed from traces")
def reasoning_records(spark, sf_dir):
    """Completions of a reasoning model as records: malformed ones are kept, with the reason."""
    outputs = F.array(F.struct(lit(0).alias("sample_index"), col("trace").alias("text"), lit(1).cast("bigint").alias("generated_token_count"), lit("stop").alias("finish_reason")))
    found = execution.guidance_records(trace_rows(spark, sf_dir).select(col("doc_id").cast("string").alias("request_id"), "task_id", lit("p").alias("prompt"), outputs.alias("outputs")))
    return found.agg(F.count("*").alias("records"), F.count("guidance").alias("valid"), F.count("validation_error").alias("malformed"))


@query("pairs", sql=_TASKS + f"""select {_KEY_SQL} as variant_id, case when v % 8 in (3, 7) then 'missing' else 'budget_empty' end as guidance_status, n_train::int as n_pairs, ((n_train - 1) * case when v // 8 in (1, 3, 6, 7) then 15 - o else o end)::int as targets,
  case when n_train < 2 then 'too_few_pairs' else 'ok' end as status from own, range(64) as q(v)""")
def planned_records(spark, sf_dir):
    """A token record of every planned view of every task; turned grids of 2 x 3 cells have texts of 8 or 7 characters."""
    parts = fixtures.parts(spark, sf_dir)  # plan, guidance and tasks are dealt alike, so views stay where they are made
    none = variants.by_task(spark.createDataFrame([], "task_id string, key string, guidance string"), parts)
    views = variants.resolved_guidance(rotated_plan(spark, sf_dir, parts), none, 16).withColumnsRenamed({"status": "guidance_status", "content": "guidance"})
    rows = token_records.guided_records(views, tasks(spark, sf_dir), 1 << 20)
    return rows.select("variant_id", "guidance_status", col("n_pairs_train").alias("n_pairs"), col("target_token_count").alias("targets"), "status")
