"""Compute accounting from run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens a second of the reference accelerator, and training's multiple of prefill.
PREFILL, DECODE, TRAINING = 5000.0, 75.0, 3.0
#: Fixed value: the kind that an adaptation run's summary states.
ADAPTATION_RUN = "ttt_run"


def summary(runs: DataFrame, *by: str, prefill: float = PREFILL, decode: float = DECODE, training: float = TRAINING) -> DataFrame:
    """runs: kind (reasoning, prediction or adaptation), prompt_tokens, generated_tokens, trained_tokens. Token sums and seconds, per group or in all."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = runs.groupBy(*by).agg(total("prompt_tokens").alias("prefill_tokens"), total("trained_tokens").alias("training_tokens"), total("generated_tokens").alias("decode_tokens"))
    seconds = sums.withColumn("prefill_seconds", F.col("prefill_tokens") / prefill).withColumn("training_seconds", training * F.col("training_tokens") / prefill).withColumn("decode_seconds", F.col("decode_tokens") / decode)
    return seconds.withColumn("total_seconds", F.col("prefill_seconds") + F.col("training_seconds") + F.col("decode_seconds"))


def provenance(required: DataFrame, provided: DataFrame) -> DataFrame:
    """Reasoning artifacts that a run needs and wasn't given, was given without need, or was given twice."""
    given = provided.groupBy("digest").agg(F.count("*").alias("times"))
    both = required.select("digest", F.lit(True).alias("needed")).distinct().join(given, "digest", "full")
    kind = F.when(F.col("times").isNull(), "missing").when(F.col("needed").isNull(), "unexpected").when(F.col("times") > 1, "repeated")
    return both.select("digest", kind.alias("problem")).where("problem is not null")


def adapter_manifest(steps: DataFrame) -> DataFrame:
    """steps: task_id, step, code, guidance_status, tokens. Per task: steps, tokens, histograms and the order of codes."""
    counts = lambda c: F.sort_array(F.collect_list(c))
    rows = steps.groupBy("task_id").agg(F.count("*").alias("steps"), F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("step", "code"))).alias("done"), counts("guidance_status").alias("statuses"))
    histogram = lambda xs: F.transform(F.array_sort(F.array_distinct(xs)), lambda k: F.concat(k, F.lit("="), F.size(F.filter(xs, lambda x: x == k)).cast("string")))
    codes = F.transform("done", lambda d: d["code"])
    return rows.select("task_id", "steps", "tokens", F.array_join(codes, ",").alias("code_order"), F.array_join(histogram(codes), ",").alias("codes"), F.array_join(histogram(F.col("statuses")), ",").alias("guidance"))


def incomplete_adapters(manifest: DataFrame, steps: int = 64, codes: int = 8) -> DataFrame:
    """Tasks whose adapter isn't the result of all planned steps, the same number per code."""
    per_code = F.transform(F.split("codes", ","), lambda x: F.split_part(x, F.lit("="), F.lit(2)).cast("int"))
    whole = (F.col("steps") == steps) & (F.size(per_code) == codes) & F.forall(per_code, lambda n: n == steps // codes)
    return manifest.where(~whole).select("task_id")


def pending(tasks: DataFrame, done: DataFrame) -> DataFrame:
    return tasks.select("task_id").distinct().join(done.select("task_id"), "task_id", "left_anti")


def unsound_adapters(steps: DataFrame, planned: int = 64, codes: int = 8) -> DataFrame:
    """steps: task_id, step, variant_id, code, guidance_status. Tasks whose steps aren't numbered 1 to ``planned``, repeat or lack a variant, don't have the same number of every code, or have one without a guidance status.

    Only counts are kept per task, and a bit for each step that is there, 32 to a number.
    """
    words = range(0, planned, 32)
    bit = lambda w: F.when(F.col("step").between(w + 1, min(w + 32, planned)), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("step") - w - 1).cast("int")))
    per_code = steps.groupBy("task_id", "code").agg(F.count("*").alias("n"), F.min("step").alias("low"), F.max("step").alias("high"), F.count("guidance_status").alias("guided"), *[F.bit_or(bit(w)).alias(f"bits{w}") for w in words])
    balanced = per_code.groupBy("task_id").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("guided").alias("guided"), F.count("code").alias("codes"), F.bool_and((F.col("n") == planned // codes) & F.col("code").isNotNull()).alias("even"),
        *[F.bit_or(f"bits{w}").alias(f"bits{w}") for w in words],
    )
    different = steps.where(F.col("variant_id").isNotNull()).groupBy("task_id", "variant_id").agg(F.count("*").alias("k")).groupBy("task_id").agg(F.count("*").alias("variant_id"))
    rows = balanced.join(different, "task_id", "left")
    whole = (F.col("n") == planned) & (F.col("low") == 1) & (F.col("high") == planned) & (F.col("variant_id") == planned) & (F.col("guided") == planned) & (F.col("codes") == codes) & F.col("even")
    for w in words:
        whole = whole & (F.col(f"bits{w}") == (1 << min(32, planned - w)) - 1)
    return rows.where(~F.coalesce(whole, F.lit(False))).select("task_id")


def adaptation_summary(manifests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Totals of a run's adapters: manifests with task_id, optimizer_updates, processed_tokens, target_tokens."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    asked = tasks.select("task_id").distinct().withColumn("__asked", F.lit(True))
    both = asked.join(manifests, "task_id", "left")
    done = F.col("optimizer_updates").isNotNull()
    return both.agg(F.count_distinct("task_id").alias("task_count"), F.count_distinct(F.when(done, F.col("task_id"))).alias("completed_task_count"), total("optimizer_updates"), total("processed_tokens"), total("target_tokens"))


def adaptation_problems(runs: DataFrame, completed: DataFrame, expected: DataFrame, tasks_digest: str) -> DataFrame:
    """(run, problem) of adaptation runs that a cost report must not count.

    runs: run, schema_version, kind, task_count, completed_task_count, processed_tokens, guidance_mode, guidance_budget, tasks_sha256, guidance_sha256;
    completed: run, task_id; expected: run, task_id.
    """
    want = expected.distinct().groupBy("run").agg(F.count("*").alias("asked"))
    pair = lambda df, name: df.groupBy("run", "task_id").agg(F.count("*").alias(name))
    cover = pair(expected.distinct(), "e").join(pair(completed, "c"), ["run", "task_id"], "full")
    cover = cover.groupBy("run").agg(F.bool_and((F.coalesce("e", F.lit(0)) == 1) & (F.coalesce("c", F.lit(0)) == 1)).alias("covered"))
    rows = runs.join(want, "run", "left").join(cover, "run", "left")
    asked = F.coalesce("asked", F.lit(0))
    digest = F.col("guidance_sha256")
    uses = (F.col("guidance_mode") == "guided") & (F.col("guidance_budget") > 0)
    checks = {
        "not an adaptation run": (F.col("schema_version") == 1) & (F.col("kind") == ADAPTATION_RUN),
        "other tasks": F.coalesce("covered", asked == 0),
        "wrong completed count": F.col("completed_task_count") == asked,
        "wrong task count": F.col("task_count") == asked,
        "other task files": F.col("tasks_sha256") == tasks_digest,
        "bad guidance digest": digest.isNull() | (F.length(digest) == 64),
        "bad guidance mode": F.col("guidance_mode").isin("guided", "unguided"),
        "bad guidance budget": F.col("guidance_budget") >= 0,
        "bad token count": F.col("processed_tokens") >= 0,
        "guidance of unknown origin": ~F.coalesce(uses, F.lit(False)) | digest.isNotNull(),
    }
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.select("run", F.explode(found).alias("problem"))


def guidance_sources(runs: DataFrame) -> DataFrame:
    """(run, digest) of the guidance that guided adaptation runs learnt from; ``provenance`` compares them with what is given."""
    return runs.where("guidance_mode = 'guided' and guidance_budget > 0").select("run", F.col("guidance_sha256").alias("digest"))
