"""Building the small, versioned resources from older inputs. Every output is a frame; its guards are ``problems``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, traces


def repaired_traces(found: DataFrame) -> DataFrame:
    """task_id, trace and repair of (task_id, trace)."""
    return found.withColumn("r", traces.repaired(F.col("trace"))).select("task_id", "r.trace", "r.repair")


def task_manifest(tasks: DataFrame, legacy: DataFrame, hints: DataFrame, few_shot: DataFrame) -> DataFrame:
    """One row per task: its partition, hint status and mode, and whether it is in the few-shot pool. hints: task_id, status."""
    flag = lambda df, name: df.select("task_id", F.lit(True).alias(name)).distinct()
    rows = tasks.select("task_id").distinct().join(flag(legacy, "old"), "task_id", "left").join(flag(few_shot, "pool"), "task_id", "left").join(hints.select("task_id", "status"), "task_id", "left")
    status = F.coalesce("status", F.lit("missing"))
    has = status == "complete"
    return rows.select(
        F.lit(1).alias("schema_version"), "task_id", F.when(F.col("old"), "legacy_training_2024").otherwise("training_2025_addition").alias("corpus_partition"), status.alias("hint_status"),
        F.when(has, "provided").otherwise("none").alias("hint_mode"), F.when(has, F.col("task_id")).alias("hint_resource_id"), F.coalesce("pool", F.lit(False)).alias("few_shot_pool"),
        F.lit(True).alias("accepted_trace_in_legacy_source"), F.when(has, "unknown").otherwise("manual_review").alias("historical_validation_route"),
    )


def manifest_problems(tasks: DataFrame, legacy: DataFrame, hints: DataFrame, few_shot: DataFrame, found: DataFrame) -> DataFrame:
    """(task_id, problem): older tasks that aren't in the corpus, tasks without a trace or traces without a task, unrepaired traces, few-shot tasks without a complete hint."""
    only = lambda a, b, what: a.select("task_id").distinct().join(b.select("task_id"), "task_id", "left_anti").withColumn("problem", F.lit(what))
    broken = repaired_traces(found).where("repair = 'unsupported'").select("task_id", F.lit("trace can't be repaired").alias("problem"))
    parts = [only(legacy, tasks, "not in the corpus"), only(tasks, found, "no trace"), only(found, tasks, "no task"), broken, only(few_shot, hints.where("status = 'complete'"), "no complete hint")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validation_views(original: DataFrame, augmented: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two frames from (key, trace): the original views, and the augmented ones with their augmentation."""
    plain = original.select(F.lit(1).alias("schema_version"), F.lit("validation").alias("split"), F.col("key").alias("variant_id"), F.col("key").alias("task_id"), "trace")
    k = augmented.withColumn("k", keys.parsed_key(F.col("key")))
    parts = F.struct(F.col("k.code").alias("transformation_code"), "k.value_mapping", "k.order_mapping")
    return plain, k.select(F.lit(1).alias("schema_version"), F.lit("validation_augmented").alias("split"), F.col("key").alias("variant_id"), "k.task_id", parts.alias("augmentation"), "trace")


def validation_problems(original: DataFrame, augmented: DataFrame, training: DataFrame) -> DataFrame:
    """(task_id, problem): keys of the wrong kind, tasks in one view only or twice in one, tasks that are trained on."""
    plain, full = validation_views(original, augmented)
    wrong = plain.where(F.contains("task_id", F.lit("_")) | (F.col("task_id") == "")).select("task_id", F.lit("not a plain key").alias("problem"))
    wrong = wrong.unionByName(full.where("augmentation.transformation_code is null").select(F.col("variant_id").alias("task_id"), F.lit("not an augmented key").alias("problem")))
    # a task's rows on each side are counted once; a problem is said for each row of a view that has it
    side = lambda df, k: df.select("task_id", *[F.lit(int(k == i)).cast("long").alias(n) for i, n in enumerate(("p", "f", "t"))])
    rows = side(plain, 0).unionByName(side(full, 1)).unionByName(side(training, 2))
    counts = rows.groupBy("task_id").agg(*[F.sum(n).alias(n) for n in ("p", "f", "t")])
    p, f = F.col("p"), F.col("f")
    alone = F.when(F.col("task_id").isNull() | (p == 0) | (f == 0), p + f).otherwise(0)
    trained = F.when(F.col("task_id").isNotNull() & (F.col("t") > 0), p).otherwise(0)
    said = lambda what, n: F.array_repeat(F.lit(what), n.cast("int"))
    found = F.concat(said("twice", (p > 1).cast("int") + (f > 1).cast("int")), said("in one view only", alone), said("in training", trained))
    return wrong.unionByName(counts.select("task_id", F.explode(found).alias("problem")))
