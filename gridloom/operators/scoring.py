"""Scoring candidates: parse, undo the augmentation, compare, and roll up.

candidates: task_id, test_index, request_id, sample_index, code, value_mapping,
text.  expected: task_id, test_index, expected.  Candidates meet the expected
grids of their task, and every later aggregation is by task and more, so one
shuffle by task carries the whole roll-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids, traces

#: The metrics in the order of the report.
METRICS = {
    "thesis_solve": "Thesis Solve",
    "all_test_inputs_solve": "All-Test-Inputs Solve",
    "test_input_solve": "Test-Input Solve",
    "request_solve": "Request Solve",
    "sample_accuracy": "Sample Accuracy",
    "parse_success": "Parse Success",
}


def scored(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """Candidates with status, the restored grid and whether it is the expected one; a candidate that doesn't parse is wrong."""
    parsed = candidates.withColumn("parsed", traces.predicted_grid(F.col("text")))
    parsed = parsed.withColumn("status", F.col("parsed.status")).withColumn("restored", grids.restored(F.col("parsed.grid"), F.col("code"), F.col("value_mapping")))
    # by task alone: rows that are dealt by task stay where they are, and candidates aren't sorted to meet the few grids of their task
    tests = expected.groupBy("task_id").agg(F.collect_list(F.struct("test_index", "expected")).alias("__tests"))
    own = F.filter("__tests", lambda t: t["test_index"] == F.col("test_index"))
    joined = parsed.join(tests.hint("shuffle_hash"), "task_id").withColumn("__test", F.explode(own)).withColumn("expected", F.col("__test.expected")).drop("__tests", "__test")
    right = F.col("restored").isNotNull() & F.col("restored").eqNullSafe(F.col("expected"))
    return joined.withColumn("is_parsed", F.col("status") == "ok").withColumn("correct", right).drop("parsed")


def by_request(rows: DataFrame) -> DataFrame:
    return rows.groupBy("task_id", "test_index", "request_id").agg(F.count("*").alias("samples"), F.count_if("is_parsed").alias("parsed"), F.count_if("correct").alias("correct"))


def by_test(rows: DataFrame) -> DataFrame:
    """From scored candidates: requests, samples, parsed, correct and solved per test input."""
    requests = by_request(rows)
    sums = [F.sum(c).alias(c) for c in ("samples", "parsed", "correct")]
    tests = requests.groupBy("task_id", "test_index").agg(F.count("*").alias("requests"), F.count_if(F.col("correct") > 0).alias("solved_requests"), *sums)
    return tests.withColumn("solved", F.col("correct") > 0)


def by_task(tests: DataFrame) -> DataFrame:
    """A task is solved in the loose sense by any test input, in the strict one by all."""
    return tests.groupBy("task_id").agg(
        F.count("*").alias("tests"), F.bool_or("solved").alias("any_solved"), F.bool_and("solved").alias("all_solved"),
        *[F.sum(c).alias(c) for c in ("requests", "solved_requests", "samples", "parsed", "correct")], F.count_if("solved").alias("solved_tests"),
    )


def rate(correct: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.try_divide(correct.cast("double"), total.cast("double")))


def metrics(tasks: DataFrame) -> DataFrame:
    """(metric, correct, total, rate), one row each."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = tasks.agg(
        F.struct(F.count_if("any_solved").alias("correct"), F.count("*").alias("total")).alias("thesis_solve"),
        F.struct(F.count_if("all_solved").alias("correct"), F.count("*").alias("total")).alias("all_test_inputs_solve"),
        F.struct(total("solved_tests").alias("correct"), total("tests").alias("total")).alias("test_input_solve"),
        F.struct(total("solved_requests").alias("correct"), total("requests").alias("total")).alias("request_solve"),
        F.struct(total("correct").alias("correct"), total("samples").alias("total")).alias("sample_accuracy"),
        F.struct(total("parsed").alias("correct"), total("samples").alias("total")).alias("parse_success"),
    )
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("place"), F.col(f"{m}.correct").alias("correct"), F.col(f"{m}.total").alias("total")) for k, m in enumerate(METRICS)])).alias("m")).select("m.*")
    return rows.withColumn("rate", rate(F.col("correct"), F.col("total")))


def report_lines(found: DataFrame) -> DataFrame:
    """The rows of the metrics table in Markdown, with their place."""
    name = F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair])[F.col("metric")]
    return found.select("place", F.format_string("| %s | %d | %d | %.2f%% |", name, F.col("correct").cast("long"), F.col("total").cast("long"), F.col("rate") * 100).alias("line"))


def report(found: DataFrame, facts: dict[str, object]) -> str:
    """A Markdown report of six metrics; the only rows that come to the driver."""
    head = ["# Evaluation Summary", "", *[f"- {k}: {v}" for k, v in facts.items()], "", "## Metrics", "", "| Metric | Correct | Total | Rate |", "| --- | ---: | ---: | ---: |"]
    return "\n".join([*head, *[r["line"] for r in report_lines(found).orderBy("place").collect()], ""])


def status_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def budget_violations(rows: DataFrame, budget: int) -> DataFrame:
    """Test inputs whose candidates aren't as many as planned."""
    return rows.groupBy("task_id", "test_index").agg(F.count("*").alias("samples")).where(F.col("samples") != budget)
