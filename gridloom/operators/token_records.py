"""Token records of the three kinds of training conversations, their splits and their cache.

What is wrong with a record is its ``status``; a guard turns such rows into an
error.  Every record is an expression over its own row: tokenising needs no
shuffle, and texts become ids where they are.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat, grids, keys
from ..functions.tokens import BYTES, Tokenizer, place_after, scanned_spans
from ..sources.records import read_tokens, write_tokens
from ..sources.shared import exists, write_text
from . import corpus


def with_ids(rows: DataFrame, text: Column, tokenizer: Tokenizer) -> DataFrame:
    """Adds input_ids and sequence_length, and the text as ``__text``."""
    return rows.withColumn("__text", text).withColumn("input_ids", tokenizer.ids(F.col("__text"))).withColumn("sequence_length", tokenizer.length(F.col("__text"), F.col("input_ids")))


def reasoning_records(rows: DataFrame, tokenizer: Tokenizer = BYTES, delimiter: str = "") -> DataFrame:
    """rows: pairs, trace and any others. Adds input_ids, sequence_length, assistant_start (behind the first assistant header) and status."""
    text = F.concat(chat.block(chat.USER, grids.examples_text(F.col("pairs"), delimiter)), chat.block(chat.ASSISTANT, F.col("trace")))
    out = with_ids(rows, text, tokenizer)
    out = out.withColumn("assistant_start", place_after(tokenizer.coding.column(F.col("__text"), F.col("input_ids")), tokenizer.encode(chat.ASSISTANT), coding=tokenizer.coding))
    start, size = F.col("assistant_start"), F.col("sequence_length")
    status = F.when(F.col("input_ids").isNull() | (size == 0), "empty").when(start.isNull(), "bad_ids").when(start < 0, "no_assistant").when(start >= size, "empty_target").otherwise("ok")
    return out.withColumn("status", status).drop("__text")


def prediction_records(rows: DataFrame, guided: bool, tokenizer: Tokenizer = BYTES, delimiter: str = "") -> DataFrame:
    """rows: pairs (input, output, split), guidance and any others. Adds ids, spans, the number of pairs of each split, and status."""
    out = with_ids(rows, chat.conversation(F.col("pairs"), F.col("guidance"), delimiter), tokenizer)
    has = F.col("guidance").isNotNull()
    scan = scanned_spans(F.col("__text"), F.col("input_ids"), F.size("pairs"), has, tokenizer)
    of = lambda split: F.size(F.filter("pairs", lambda p: p["split"] == split))
    wrong = F.when(F.coalesce(F.size("pairs"), F.lit(0)) <= 0, "no_pairs").when(has != F.lit(guided), "other_profile").when(F.col("sequence_length") <= 0, "empty")
    out = out.withColumn("__scan", scan).withColumn("status", F.coalesce(wrong, F.col("__scan.status"))).withColumn("assistant_spans", F.col("__scan.spans")).drop("__scan", "__text")
    return out.withColumn("guided", has).withColumn("n_pairs_total", F.size("pairs")).withColumn("n_pairs_train", of("train")).withColumn("n_pairs_test", of("test"))


def adaptation_records(rows: DataFrame, most: int, skip_first: bool = True, tokenizer: Tokenizer = BYTES, delimiter: str = "") -> DataFrame:
    """rows: pairs, guidance and any others. Adds ids, spans, target_token_count and status; a length beyond ``most`` is wrong, not left out."""
    return told_records(rows, chat.conversation(F.col("pairs"), F.col("guidance"), delimiter), most, skip_first, tokenizer)


def told_records(rows: DataFrame, text: Column, most: int, skip_first: bool, tokenizer: Tokenizer, texts: bool = False) -> DataFrame:
    """``adaptation_records`` of rows whose conversation is a column; texts: the sides of its pairs are texts, whose lengths say where the answers stand if no side can hold a marker."""
    out = with_ids(rows, text, tokenizer)
    has, pairs = F.col("guidance").isNotNull(), F.col("pairs")
    scan = scanned_spans(F.col("__text"), F.col("input_ids"), F.size("pairs"), has, tokenizer)
    targets = chat.target_tokens(F.col("assistant_spans"), skip_first)
    if texts and tokenizer.by_bytes:
        out = out.withColumn("__plain", chat.is_plain(pairs, F.col("guidance")))
        out = out.withColumn("__scan", F.when(~F.col("__plain"), scan))
        spans = F.when(F.col("__plain"), chat.text_spans(pairs, F.col("guidance"))).otherwise(F.col("__scan.spans"))
        targets = F.when(F.col("__plain"), chat.answer_bytes(pairs, skip_first)).otherwise(chat.target_tokens(F.col("__scan.spans"), skip_first))
        found = F.when(F.col("__plain"), "ok").otherwise(F.col("__scan.status"))
    else:
        out = out.withColumn("__scan", scan)
        spans, found = F.col("__scan.spans"), F.col("__scan.status")
    out = out.withColumn("assistant_spans", spans).withColumn("target_token_count", targets)
    size = F.col("sequence_length")
    status = (
        F.when(F.coalesce(F.size("pairs"), F.lit(0)) < 2, "too_few_pairs").when(size <= 0, "empty").when(size > most, "too_long")
        .when(found != "ok", found).when(F.col("target_token_count") <= 0, "no_target").otherwise("ok")
    )
    return out.withColumn("status", status).withColumn("has_system_message", has).withColumn("n_pairs_train", F.size("pairs")).drop("__scan", "__plain", "__text")


def wrong_records(records: DataFrame) -> DataFrame:
    """Records that a run must not be trained on, with the reason."""
    return records.where("status <> 'ok'").select("task_id", "variant_id", "status")


def planned_records(plan: DataFrame, tasks: DataFrame, guidance: DataFrame, most: int, skip_first: bool = True, tokenizer: Tokenizer = BYTES) -> DataFrame:
    """plan: task_id, code, value_mapping, order_mapping, variant_index; guidance: the same and status, content. A record of every planned view, with its pairs as texts.

    Grids are turned and written once for a task and symmetry; a view picks its
    symmetry, puts the pairs in order and changes the texts' digits.
    """
    said = guidance.select("task_id", "variant_index", F.col("status").alias("guidance_status"), F.col("content").alias("guidance"))
    return guided_records(plan.join(said, ["task_id", "variant_index"]), tasks, most, skip_first, tokenizer)  # views meet their guidance first, as few bytes


def guided_records(views: DataFrame, tasks: DataFrame, most: int, skip_first: bool = True, tokenizer: Tokenizer = BYTES) -> DataFrame:
    """``planned_records`` of views that have their guidance_status and guidance already, as ``variants.resolved_guidance`` adds them: a plan isn't joined with itself."""
    rows = corpus.materialised_texts(views, tasks)
    name = keys.made_key(F.col("task_id"), F.col("code"), F.col("value_mapping"), F.col("order_mapping"))
    rows = rows.withColumn("variant_id", name)
    return told_records(rows, chat.spoken(F.col("pairs"), F.col("guidance"), lambda text: text), most, skip_first, tokenizer, texts=True)


def unplanned(plan: DataFrame, tasks: DataFrame, per_task: int) -> DataFrame:
    """Tasks without exactly ``per_task`` planned views, and planned tasks that aren't in the run."""
    counts = plan.groupBy("task_id").agg(F.count("*").alias("n"))
    both = tasks.select("task_id", F.lit(True).alias("__asked")).distinct().join(counts, "task_id", "full")
    return both.where(F.col("__asked").isNull() | (F.coalesce("n", F.lit(0)) != per_task)).select("task_id", F.coalesce("n", F.lit(0)).alias("n"))


def training_split(records: DataFrame, most: int, per_task: int, seed: int) -> DataFrame:
    """Sound records within ``most`` tokens, the ``per_task`` of smallest stable score per task with their rank: the length limit comes first."""
    return corpus.selected(corpus.fitting(records.where("status = 'ok'"), "sequence_length", most), per_task, seed)


def split_counts(records: DataFrame, most: int) -> DataFrame:
    """What a split is built from: records, unsound ones, those too long, and candidates."""
    sound = F.col("status") == "ok"
    fits = F.col("sequence_length") <= most
    return records.agg(F.count("*").alias("records"), F.count_if(~sound).alias("unsound"), F.count_if(sound & ~fits).alias("too_long"), F.count_if(sound & fits).alias("candidates"))


def validation_problems(records: DataFrame, most: int) -> DataFrame:
    """A validation split has one sound record per task, none too long: (task_id, problem) where it hasn't."""
    too_long = records.where((F.col("status") == "ok") & (F.col("sequence_length") > most)).select("task_id", F.lit("too_long").alias("problem"))
    unsound = records.where("status <> 'ok'").select("task_id", F.col("status").alias("problem"))
    twice = records.groupBy("task_id").agg(F.count("*").alias("n")).where("n > 1").select("task_id", F.lit("repeated").alias("problem"))
    return too_long.unionByName(unsound).unionByName(twice)


def write_cache(records: DataFrame, path: str, facts: dict[str, Any]) -> None:
    """records: split and the fields of a record. Parquet by split, with a manifest of facts and length statistics beside it."""
    write_tokens(records, path)
    spark = records.sparkSession
    stats = corpus.length_stats(spark.read.parquet(path), "sequence_length", "split")  # one row per split
    splits = {r["split"]: {k: r[k] for k in ("records", "shortest", "longest", "mean")} for r in stats.collect()}
    write_text(spark, f"{path}.manifest.json", json.dumps({**facts, "schema_version": 1, "splits": splits}, indent=2, sort_keys=True) + "\n")


SPLITS = ("training", "validation", "validation_augmented")


class OtherCache(ValueError):
    """A cache that was made for something else."""


def cache_problems(manifest: dict[str, Any], kind: str, contract: dict[str, Any], splits: tuple[str, ...] = SPLITS) -> list[str]:
    """Why a cache can't be used, from its manifest alone: version, kind, empty splits, and the settings that differ."""
    out = []
    if manifest.get("schema_version") != 1:
        out.append(f"version {manifest.get('schema_version')}")
    if manifest.get("kind") != kind:
        out.append(f"kind {manifest.get('kind')}")
    held = manifest.get("splits") or {}
    out += [f"no records of {s}" for s in splits if not (held.get(s) or {}).get("records")]
    return out + [f"other {at}" for at in different(manifest.get("contract"), contract)]


def different(a: Any, b: Any, at: str = "contract") -> list[str]:
    """The paths at which two values of JSON differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [x for k in sorted({*a, *b}) for x in different(a.get(k), b.get(k), f"{at}.{k}")]
    return [] if type(a) is type(b) and a == b else [at]


def read_cache(spark: SparkSession, path: str, split: str, kind: str, contract: dict[str, Any], splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """The records of one split of a cache that was made under a contract; other caches are refused before any record is read."""
    if not exists(spark, f"{path}.manifest.json"):
        raise OtherCache(f"{path} has no manifest")
    manifest = json.loads(spark.read.text(f"{path}.manifest.json", wholetext=True).first()[0])
    if problems := cache_problems(manifest, kind, contract, splits):
        raise OtherCache(f"{path}: {', '.join(problems)}")
    return read_tokens(spark, path).where(F.col("split") == split)
