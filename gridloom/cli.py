"""Commands over folders of JSON lines: ``python -m gridloom.cli COMMAND ...``. Exit status 2 on bad input."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grids, traces
from .functions.text import is_blank
from .operators import cost, execution, guards, judging, requests, scoring
from .plans import variants
from .sources import files, records, schemas


def puzzles(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_tasks(spark, folder).withColumn("puzzle", grids.examples_text(F.col("train")))


def prepare_initial(spark: SparkSession, a: argparse.Namespace) -> None:
    ids = files.read_listed_tasks(spark, a.task_ids)
    guards.raise_if_any(files.bad_task_ids(ids), "bad task ids")
    rows = puzzles(spark, a.tasks).join(ids, "task_id")
    if a.hints:
        hints = files.read_hint_source(spark, a.hints)
        guards.raise_if_any(files.bad_hints(hints), "bad hints")
        hint = requests.hint_text(F.struct(*files.HINT_FIELDS))
        rows = rows.join(hints.where("status = 'complete'").select("task_id", hint.alias("hint")), "task_id", "left")
    else:
        hints = None
        rows = rows.withColumn("hint", F.lit(None).cast("string"))
    rows = rows.withColumn("candidate", F.explode(F.sequence(F.lit(a.candidate_start), F.lit(a.candidate_start + a.candidates - 1))))
    if a.few_shots:
        rows = with_pool(spark, a, rows, hints)
    none = F.array().cast("array<string>")
    for name in ("few_shots", "few_shot_ids"):
        rows = rows.withColumn(name, F.coalesce(F.col(name), none) if name in rows.columns else none)
    files.write_lines(requests.initial_requests(rows, a.candidates), a.output)


def with_pool(spark: SparkSession, a: argparse.Namespace, rows: DataFrame, hints: DataFrame | None) -> DataFrame:
    """Few-shots for each task and candidate, from a pool of JSON lines (task_id, trace) whose order counts."""
    listed = files.read_lines(spark, a.few_shots, "task_id string, pool_order int, trace string")
    none = spark.createDataFrame([], f"schema_version int, task_id string, status string, {', '.join(f'{f} string' for f in files.HINT_FIELDS)}")
    pool = records.few_shot_pool(listed, files.read_tasks(spark, a.tasks), hints if hints is not None else none, listed.where("false"))
    guards.raise_if_any(records.bad_pool(pool), "bad few-shot pool")
    hint = F.when(F.col("status") == "complete", requests.hint_text(F.col("hint")))
    blocks = pool.select("task_id", requests.few_shot_block(F.col("task_id"), grids.examples_text(F.col("train"), ""), hint, F.col("trace")).alias("block"))
    order = [r["task_id"] for r in pool.orderBy("pool_order").select("task_id").collect()]  # a pool is a few dozen hand-picked tasks
    return requests.with_few_shots(rows, variants.few_shots(rows, order, a.few_shot_count, a.seed), blocks)


def prepare_rewrite(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rewrites of accepted traces (or of selected base traces), under augmentations that weren't asked for before."""
    if bool(a.sources) == bool(a.base_traces):
        raise ValueError("give either --sources or --base-traces")
    tasks = files.read_tasks(spark, a.tasks)
    if a.base_traces:
        sources = records.base_traces(spark, a.base_traces)
        guards.raise_if_any(guards.repeated(sources, "task_id"), "repeated base traces")
        guards.raise_if_any(sources.where("accepted is not true").select("task_id"), "malformed base traces")
        sources = sources.drop("accepted")
    else:
        sources = requests.rewrite_sources(files.read_lines(spark, a.sources, schemas.RESULT))
    guards.raise_if_any(guards.missing(sources, tasks, "task_id"), "traces of unknown tasks")
    asked = files.read_existing(spark, a.existing_requests, schemas.REQUEST) if a.existing_requests else spark.createDataFrame([], schemas.REQUEST)
    results = files.read_existing(spark, a.existing_results, schemas.RESULT) if a.existing_results else spark.createDataFrame([], schemas.RESULT)
    plan = variants.rewrite_plan(requests.planned_sources(sources, tasks, requests.earlier_rewrites(asked, results)), a.target, a.seed)
    rows = plan.join(sources, "source_id").join(tasks.select("task_id", F.col("train").alias("pairs")), "task_id").withColumnRenamed("source_id", "source_request_id")
    found = requests.rewrite_requests(rows)
    spec = F.struct(F.col("source_request_id").alias("source_trace_id"), F.col("code").alias("transformation_code"), "value_mapping", "order_mapping", "style", "variant_index")
    files.write_lines(found.select("request_id", "task_id", F.lit("rewrite").alias("stage"), "messages", spec.alias("augmentation")), a.output)


def run_local(spark: SparkSession, a: argparse.Namespace) -> None:
    """Runs requests through the built-in deterministic generator; engines of one's own call ``execution.local_results``."""
    asked = files.read_lines(spark, a.input, schemas.REQUEST)
    guards.raise_if_any(execution.provider_defaults(asked), "requests that leave sampling to a provider")
    files.write_lines(execution.local_results(asked, execution.echo, "echo"), a.output)


def validate_static(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_lines(spark, a.input, schemas.RESULT)
    guards.raise_if_any(rows.where("stage = 'judge'").select("request_id"), "judge results have no trace")
    text = traces.normalised(F.col("raw_output"))
    files.write_lines(rows.withColumn("normalized_output", text).withColumn("validation", F.struct(traces.format_verdict(text).alias("static"))), a.output)


def render_requests(spark: SparkSession, a: argparse.Namespace) -> None:
    shown = requests.rendered(files.read_lines(spark, a.input, schemas.REQUEST))
    shown.write.mode("errorifexists").partitionBy("request_id").text(a.output)


def prepare_judge(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_lines(spark, a.input, schemas.RESULT).join(puzzles(spark, a.tasks).select("task_id", "puzzle"), "task_id")
    if a.hints:
        hints = files.read_hint_source(spark, a.hints)
        guards.raise_if_any(files.bad_hints(hints), "bad hints")
        hint = requests.hint_text(F.struct(*files.HINT_FIELDS))
        rows = rows.join(hints.where("status = 'complete'").select("task_id", hint.alias("hint")), "task_id", "left")
    else:
        rows = rows.withColumn("hint", F.lit(None).cast("string"))
    rows = rows.select("request_id", "task_id", "stage", "error", F.col("validation.static.accepted").alias("accepted"), F.col("normalized_output").alias("trace"), "puzzle", "hint")
    files.write_lines(requests.judge_requests(rows, temperature=a.temperature, top_p=a.top_p, max_tokens=a.max_tokens, seed=a.judge_seed), a.output)


def evaluate_judges(spark: SparkSession, a: argparse.Namespace) -> None:
    asked = files.read_lines(spark, a.judge_requests, "request_id string, source_request_id string, judge_index int")
    counts = judging.judged(asked, files.read_lines(spark, a.judge_results, schemas.RESULT))
    guards.raise_if_any(judging.wrong_vote_counts(counts), "sources without five answers")
    if a.sources:
        files.write_lines(judging.evaluated(files.read_lines(spark, a.sources, schemas.RESULT), counts), a.output)
        return
    files.write_lines(judging.unanimous(counts).withColumnRenamed("source_request_id", "request_id"), a.output)


def apply_reviews(spark: SparkSession, a: argparse.Namespace) -> None:
    decisions = files.read_lines(spark, a.decisions, schemas.DECISION).select("request_id", F.col("accepted").alias("decision"), F.col("reviewer_note").alias("note"))
    guards.raise_if_any(judging.notes_missing(decisions), "decisions without a note")
    if a.whole:
        files.write_lines(judging.reviewed_results(files.read_lines(spark, a.input, schemas.RESULT), decisions), a.output)
        return
    results = files.read_lines(spark, a.input, "request_id string, accepted boolean, route string")
    files.write_lines(judging.reviewed(results, decisions), a.output)


def prepare_plan(spark: SparkSession, a: argparse.Namespace) -> None:
    tasks = files.read_tasks(spark, a.tasks).select("task_id", F.size("train").alias("n_pairs"))
    guards.raise_if_any(tasks.where("n_pairs < 2"), "tasks with fewer than two demonstrations")
    files.write_plan(variants.augmentation_plan(tasks, a.seed), a.output, a.seed)


def export_batch(spark: SparkSession, a: argparse.Namespace) -> None:
    s = F.col("sampling")
    line = requests.provider_record(F.col("request_id"), F.col("messages"), s["temperature"], s["top_p"], s["max_tokens"], s["seed"])
    files.read_lines(spark, a.input, schemas.REQUEST).select(line.alias("value")).write.mode("errorifexists").text(a.output)


def import_batch(spark: SparkSession, a: argparse.Namespace) -> None:
    asked = files.read_lines(spark, a.requests, schemas.REQUEST)
    results = spark.read.text(a.input).where(~is_blank(F.col("value"))).select(requests.provider_result(F.col("value")).alias("r")).select("r.*")
    good, unknown = requests.imported(results, asked)
    guards.raise_if_any(unknown.select("key"), "results that nobody asked for")
    files.write_lines(good, a.output)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    predictions = files.read_lines(spark, a.predictions, schemas.PREDICTION)
    guards.raise_if_any(files.inconsistent_variants(predictions), "inconsistent variants")
    guards.raise_if_any(guards.repeated(predictions, "request_id"), "repeated requests")
    tasks = files.read_tasks(spark, a.tasks, files.read_task_ids(spark, a.task_ids) if a.task_ids else None)
    guards.raise_if_any(files.bad_expected(tasks), "test outputs that can't be scored")
    expected = files.expected_outputs(tasks)
    rows = files.candidates(predictions)
    guards.raise_if_any(guards.missing(rows, expected, "task_id", "test_index"), "candidates without an expected output")
    guards.raise_if_any(guards.missing(expected, rows, "task_id", "test_index"), "test inputs without candidates")
    guards.raise_if_any(guards.gaps(rows, ["request_id"], "sample_index"), "sample indices that aren't 0, 1, 2 and so on")
    guards.raise_if_any(guards.not_functional(predictions.withColumn("all", F.lit(1)), ["all"], "protocol", "guidance_mode", "adapter_used"), "predictions of several protocols")
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("requests"), F.count_distinct("task_id", "test_index").alias("tests")).first()
    stated = files.verified_manifest(spark, a.predictions, "predictions") if a.manifest else {}
    budget = stated.get("candidates_per_test_input", counts["n"] // max(1, counts["tests"]))
    guards.raise_if_any(scoring.budget_violations(rows, budget), f"test inputs whose candidates aren't {budget}")
    for name, found in (("record_count", counts["requests"]), ("request_count", counts["requests"]), ("total_candidates", counts["n"])):
        if stated.get(name, found) != found:
            raise ValueError(f"{name} is {found}, the manifest states {stated[name]}")
    scored = scoring.scored(rows, expected)
    by_task = scoring.by_task(scoring.by_test(scored))
    if a.details:
        files.write_lines(scored, f"{a.details}/candidates")
        files.write_lines(by_task, f"{a.details}/tasks")
    found = scoring.metrics(by_task).cache()
    files.write_json({r["metric"]: {"correct": r["correct"], "total": r["total"], "rate": r["rate"]} for r in found.collect()}, f"{a.output}.json")
    files.refuse_existing(f"{a.output}.md")
    with open(f"{a.output}.md", "x", encoding="utf-8") as f:
        f.write(scoring.report(found, {"Predictions": a.predictions}))


def summarize_compute(spark: SparkSession, a: argparse.Namespace) -> None:
    runs = files.read_lines(spark, a.runs, "kind string, prompt_tokens long, generated_tokens long, trained_tokens long")
    files.write_json(cost.summary(runs).first().asDict(), a.output)


COMMANDS = {
    "prepare-initial": (prepare_initial, ("tasks", "task-ids", "output"), ("hints", "few-shots")),
    "prepare-rewrite": (prepare_rewrite, ("tasks", "output"), ("sources", "base-traces", "existing-requests", "existing-results")),
    "run-local": (run_local, ("input", "output"), ()),
    "validate-static": (validate_static, ("input", "output"), ()),
    "render-requests": (render_requests, ("input", "output"), ()),
    "prepare-judge": (prepare_judge, ("input", "tasks", "output"), ("hints",)),
    "evaluate-judges": (evaluate_judges, ("judge-requests", "judge-results", "output"), ("sources",)),
    "apply-reviews": (apply_reviews, ("input", "decisions", "output"), ()),
    "build-plan": (prepare_plan, ("tasks", "output"), ()),
    "export-batch": (export_batch, ("input", "output"), ()),
    "import-batch": (import_batch, ("input", "requests", "output"), ()),
    "evaluate": (evaluate, ("predictions", "tasks", "output"), ("task-ids", "manifest", "details")),
    "summarize-compute": (summarize_compute, ("runs", "output"), ()),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, needed, allowed) in COMMANDS.items():
        one = commands.add_parser(name)
        for option in (*needed, *allowed):
            one.add_argument(f"--{option}", required=option in needed)
        one.add_argument("--seed", type=int, default=0)
        one.add_argument("--judge-seed", type=int)
        one.add_argument("--whole", action="store_true", help="results keep all their fields")
        one.add_argument("--temperature", type=float, default=0.7)
        one.add_argument("--top-p", type=float, default=1.0)
        one.add_argument("--max-tokens", type=int, default=2048)
        for name, start in (("candidates", 1), ("candidate-start", 0), ("few-shot-count", 3), ("target", 100)):
            one.add_argument(f"--{name}", type=int, default=start)
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        COMMANDS[a.command][0](spark or SparkSession.builder.appName("gridloom").getOrCreate(), a)
    except (OSError, RuntimeError, ValueError) as error:
        print(f"gridloom: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
