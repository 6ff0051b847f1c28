"""The training corpus: joining accepted rewrites, bounded selection, splits and statistics.

Results meet requests on the request id (no side is assumed small; Spark picks
the strategy by size); selection per task is a ranked window, which Spark cuts
off per task before the shuffle (group limit).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grids, keys, traces
from ..functions.text import score


def accepted_variants(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results without an error whose normalised trace is accepted, with the augmentation of their request."""
    good = results.where(F.col("error").isNull()).withColumn("trace", traces.normalised(F.col("raw_output"))).where(traces.format_verdict(F.col("trace"))["accepted"])
    asked = requests.select("request_id", "task_id", "code", "value_mapping", "order_mapping", "variant_index")
    if "task_id" not in good.columns:
        return good.join(asked, "request_id")
    # a result that names another task than its request is no variant; ``disagreeing`` reports it
    found = good.withColumnRenamed("task_id", "__named").join(asked, "request_id")
    return found.where(F.col("__named").isNull() | (F.col("__named") == F.col("task_id"))).drop("__named")


def disagreeing(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results that name another task than their request."""
    named = results.select("request_id", F.col("task_id").alias("result_task_id"))
    return named.join(requests.select("request_id", "task_id"), "request_id").where("result_task_id <> task_id")


def unmatched(results: DataFrame, requests: DataFrame) -> DataFrame:
    return results.join(requests, "request_id", "left_anti")


def selected(rows: DataFrame, per_task: int, seed: int, variant: str = "variant_id") -> DataFrame:
    """The ``per_task`` variants of smallest stable score per task, with their rank from 0."""
    scored = rows.withColumn("score", score(F.lit(str(seed)), F.col("task_id"), F.col(variant)))
    order = Window.partitionBy("task_id").orderBy("score", variant)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_task).withColumn("rank", F.col("rank") - 1)


def short_tasks(rows: DataFrame, tasks: DataFrame, per_task: int) -> DataFrame:
    """Tasks with fewer variants than asked for."""
    counts = tasks.select("task_id").distinct().join(rows.groupBy("task_id").agg(F.count("*").alias("n")), "task_id", "left")
    return counts.select("task_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < per_task)


def fitting(rows: DataFrame, length: str, most: int) -> DataFrame:
    """Length limits come before selection: a rank must not be spent on a row that is too long."""
    return rows.where(F.col(length) <= most)


def filter_counts(rows: DataFrame, repeated: Column, rejected: Column, too_long: Column) -> DataFrame:
    """How many records each filter takes, in order."""
    left = ~repeated & ~rejected
    return rows.agg(F.count("*").alias("records"), F.count_if(repeated).alias("duplicates"), F.count_if(~repeated & rejected).alias("rejected"), F.count_if(left).alias("accepted"), F.count_if(left & too_long).alias("too_long"))


def length_stats(rows: DataFrame, length: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("records"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.avg(length).alias("mean"))


def overlap(training: DataFrame, validation: DataFrame) -> DataFrame:
    """Tasks that are in both splits; must be none."""
    return training.select("task_id").distinct().join(validation.select("task_id").distinct(), "task_id", "left_semi")


def epoch_view(rows: DataFrame, epoch: int, seed: int) -> DataFrame:
    """One variant per task for an epoch, with the place of the task in a seeded order."""
    return rows.where(F.col("rank") == epoch).withColumn("task_score", score(F.lit(str(seed)), F.lit("epoch"), F.col("task_id")))


def weighted_loss(batches: DataFrame, loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    total = F.sum(tokens)
    return batches.agg(F.when(total > 0, F.try_divide(F.sum(F.col(loss) * F.col(tokens)), total)).alias("loss"), F.coalesce(total, F.lit(0)).alias("tokens"))


def materialised(views: DataFrame, tasks: DataFrame) -> DataFrame:
    """views: task_id, code, value_mapping, order_mapping; tasks: task_id, train. The augmented demonstrations of each view."""
    rows = views.join(tasks.select("task_id", "train"), "task_id")
    return rows.withColumn("pairs", keys.augmented_pairs(F.col("train"), F.col("code"), F.col("value_mapping"), F.col("order_mapping"))).drop("train")


def symmetric_texts(tasks: DataFrame, turned: Callable[[Column], Column] = grids.turned_texts, *kept: str) -> DataFrame:
    """(task_id, __turned): of each train pair the texts of its sides under the eight symmetries; null for grids that aren't of digits 0 to 9. ``turned`` makes a side's eight texts."""
    sides = lambda p: F.struct(*[turned(p[side]).alias(side) for side in ("input", "output")])
    return tasks.select("task_id", F.transform("train", sides).alias("__turned"), *kept)


def materialised_texts(views: DataFrame, tasks: DataFrame, turned: Callable[[Column], Column] = grids.turned_texts, *kept: str) -> DataFrame:
    """``materialised`` with the sides of its pairs as texts. Grids are turned and written once for a task and symmetry; a view
    picks its symmetry, puts the pairs in order and changes the texts' digits. A part's turned texts are held while its views pass. kept: columns of tasks that come with them."""
    rows = views.join(symmetric_texts(tasks, turned, *kept).hint("shuffle_hash"), "task_id")
    place = F.array_position(F.array(*map(F.lit, grids.CODES)), grids.code_name(F.col("code"))).cast("int") - 1
    mapping = F.when(grids.is_permutation(F.col("value_mapping")), F.col("value_mapping"))
    rows = rows.withColumn("__at", place).withColumn("__to", mapping)
    text = lambda texts: F.call_function("translate", F.get(texts, F.col("__at")), F.lit(grids.IDENTITY), F.col("__to"))
    pairs = F.transform(keys.ordered(F.col("__turned"), F.col("order_mapping")), lambda p: F.struct(*[text(p[side]).alias(side) for side in ("input", "output")]))
    return rows.withColumn("pairs", pairs).drop("__turned", "__at", "__to")


def labelled_pairs(tasks: DataFrame) -> DataFrame:
    """Train pairs, then test pairs, each with its split, as ``pairs`` of one row per task."""
    side = lambda name: F.transform(name, lambda p: F.struct(p["input"].alias("input"), p["output"].alias("output"), F.lit(name).alias("split")))
    return tasks.select("task_id", F.concat(side("train"), side("test")).alias("pairs"))


def unlabelled(tasks: DataFrame) -> DataFrame:
    """Tasks without pairs, or with a pair that lacks an output."""
    pairs = labelled_pairs(tasks)
    return pairs.where((F.coalesce(F.size("pairs"), F.lit(0)) <= 0) | F.exists("pairs", lambda p: p["output"].isNull())).select("task_id")


def whole_views(views: DataFrame, tasks: DataFrame) -> DataFrame:
    """views: task_id, code, value_mapping. All labelled pairs of each view's task under its code and mapping, in their own order; a view without a code shows them as they are."""
    rows = views.join(labelled_pairs(tasks), "task_id")

    def shown(p: Column) -> Column:
        new = keys.grids.augmented_pair(p, F.col("code"), F.col("value_mapping"))
        return F.struct(new["input"].alias("input"), new["output"].alias("output"), p["split"].alias("split"))

    return rows.withColumn("pairs", F.when(F.col("code").isNull(), F.col("pairs")).otherwise(F.transform("pairs", shown)))
