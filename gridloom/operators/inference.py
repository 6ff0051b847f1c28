"""Batched inference: requests of mixed sampling in their order, and runs through adapters that can be taken up again.

A model is behind ``load``: a function of an adapter's name (None: the base model) that gives a
generator of (prompts, sampling) to completions, a list for each prompt.  A completion is a text, or a mapping of text,
token_ids, token_count and finish_reason; what it doesn't say is counted by ``count`` or left null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..plans.ranges import summed
from ..sources.shared import exists, written, write_text

Generate = Callable[[list[str], dict[str, Any]], list[list[Any]]]
Load = Callable[[str | None], Generate]
#: What requests must share to be one call of a model.
SAMPLING = ("temperature", "top_p", "max_tokens", "seed")
_output = pa.struct([("sample_index", pa.int32()), ("text", pa.string()), ("generated_token_count", pa.int64()), ("finish_reason", pa.string())])
OUTPUTS = "array<struct<sample_index:int,text:string,generated_token_count:bigint,finish_reason:string>>"


def byte_count(text: str) -> int:
    return len(text.encode())


def completion(index: int, value: Any, count: Callable[[str], int]) -> dict[str, Any]:
    """A completion as a record: its own count of tokens, or that of its ids, or its text counted anew."""
    said: Mapping = {"text": value} if isinstance(value, str) else value
    ids, n = said.get("token_ids"), said.get("token_count")
    n = n if n is not None else len(ids) if ids else count(said["text"])
    return {"sample_index": index, "text": said["text"], "generated_token_count": n, "finish_reason": said.get("finish_reason")}


def asked(generate: Generate, prompts: list[str], sampling: dict[str, Any], count: Callable[[str], int]) -> list[list[dict]]:
    """One call; an error if the model answers another number of prompts."""
    found = generate(prompts, sampling)
    if len(found) != len(prompts):
        raise RuntimeError(f"{len(found)} answers to {len(prompts)} prompts")
    return [[completion(k, c, count) for k, c in enumerate(cs)] for cs in found]


# --- requests of mixed sampling, in their order ------------------------------------------


def in_order(requests: DataFrame, load: Load, batch: int = 256, window: int = 4096, count: Callable[[str], int] = byte_count) -> DataFrame:
    """requests: request_id, prompt, sampling (temperature, top_p, max_tokens, seed). (request_id, outputs) in the order of the requests.

    A task looks at ``window`` requests at a time, calls the model for those of equal
    sampling together, and puts the answers back in place: there is no shuffle and no sort of the whole, and no
    sampling that most requests share makes one task of them.  Requests that
    leave their sampling to a provider are those that ``execution.provider_defaults`` finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate, kept, n = load(None), [], 0

        def answered() -> pa.RecordBatch:
            table = pa.Table.from_batches(kept)
            prompts, alike = table.column(1).to_pylist(), {}
            for k, sampling in enumerate(table.column(2).to_pylist()):
                alike.setdefault(tuple(sampling[s] for s in SAMPLING), []).append(k)
            outputs: list = [None] * len(prompts)
            for sampling, places in alike.items():
                given = {name: v for name, v in zip(SAMPLING, sampling) if v is not None}
                for at in range(0, len(places), batch):
                    some = places[at : at + batch]
                    for k, found in zip(some, asked(generate, [prompts[k] for k in some], given, count)):
                        outputs[k] = found
            return pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(outputs, pa.list_(_output))], names=["request_id", "outputs"])

        for part in batches:
            while part.num_rows:
                some = part.slice(0, window - n)
                kept.append(some)
                n, part = n + some.num_rows, part.slice(some.num_rows)
                if n == window:
                    yield answered()
                    kept, n = [], 0
        if n:
            yield answered()

    sampling = F.struct(*[F.col(f"sampling.{s}").alias(s) for s in SAMPLING]).alias("sampling")
    return requests.select("request_id", "prompt", sampling).mapInArrow(run, f"request_id string, outputs {OUTPUTS}")


# --- adapters ---------------------------------------------------------------------------


def slots(requests: DataFrame, cost: Column, most: float) -> DataFrame:
    """Written requests with ``slot``: stretches of about ``most`` cost in the order of adapters and request ids.

    An adapter with more than that is cut into several slots, small ones share one; a slot's adapters are neighbours.
    """
    found = summed(requests, ["adapter", "request_id"], cost, "__before")
    return found.withColumn("slot", F.floor(F.col("__before") / most).cast("long"))


def through_adapters(slotted: DataFrame, load: Load, batch: int = 256, count: Callable[[str], int] = byte_count) -> DataFrame:
    """slotted: request_id, adapter, prompt, samples, sampling, slot. Adds outputs, prompt_token_count, task and load.

    A task has whole slots in their order, so it loads each of its adapters once;
    ``load`` numbers the task's loads, and (task, load) counts them.
    """
    columns = ["request_id", "adapter", "prompt", "samples", "sampling"]
    form = f"request_id string, adapter string, prompt_token_count long, outputs {OUTPUTS}, task int, load int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, now, loads, generate = TaskContext.get().partitionId(), (), 0, None
        for part in batches:
            rows, out, at = part.to_pylist(), [], 0
            while at < len(rows):
                first, stop = rows[at], at + 1
                alike = lambda r: (r["adapter"], r["samples"], r["sampling"])
                while stop < min(len(rows), at + batch) and alike(rows[stop]) == alike(first):
                    stop += 1
                if now != (first["adapter"],):
                    generate, now, loads = load(first["adapter"]), (first["adapter"],), loads + 1
                some = rows[at:stop]
                given = {**{k: v for k, v in (first["sampling"] or {}).items() if v is not None}, "n": first["samples"]}
                for r, found in zip(some, asked(generate, [r["prompt"] for r in some], given, count)):
                    out.append((r["request_id"], r["adapter"], count(r["prompt"]), found, task, loads))
                at = stop
            if out:
                types = [pa.string(), pa.string(), pa.int64(), pa.list_(_output), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["request_id", "adapter", "prompt_token_count", "outputs", "task", "load"])

    dealt = slotted.repartitionByRange("slot").sortWithinPartitions("slot", "adapter", "request_id")
    return dealt.select(*columns).mapInArrow(run, form)


def records(asked_: DataFrame, found: DataFrame, facts: dict[str, Any]) -> DataFrame:
    """Prediction records: what was asked (all its columns but prompt and sampling), the prompt's digest, outputs and the run's facts."""
    kept = [c for c in asked_.columns if c not in ("prompt", "sampling", "slot", "samples", "adapter", "__before")]
    rows = asked_.select(*kept, sha256(F.col("prompt")).alias("prompt_sha256"), F.col("samples").alias("sample_count")).join(found, "request_id")
    constants = [F.lit(v).alias(k) for k, v in facts.items()]
    return rows.select(F.lit(1).alias("schema_version"), F.lit("prediction_candidates").alias("kind"), *kept, *constants, F.col("adapter").isNotNull().alias("adapter_used"), "adapter", "prompt_sha256", "prompt_token_count", "sample_count", "outputs", "task", "load")


def wrong_counts(made: DataFrame) -> DataFrame:
    """Records with another number of samples than was asked for."""
    return made.where(F.size("outputs") != F.col("sample_count")).select("request_id", F.size("outputs").alias("samples"), "sample_count")


def parts(spark: SparkSession, path: str) -> list[str]:
    """The committed parts of a run: those with a note of success."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*/_SUCCESS")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    return sorted(f.getPath().getParent().toString() for f in found or ())


def read_run(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of a run as far as it has come; None if it has none."""
    done = parts(spark, path)
    return spark.read.parquet(*done) if done else None


def adapter_run(requests: DataFrame, load: Load, path: str, facts: dict[str, Any], most: float = 1 << 20, waves: int = 4, batch: int = 256, count: Callable[[str], int] = byte_count) -> dict[str, Any]:
    """requests: request_id, adapter, prompt, samples, sampling and any others. Writes the records of a run, and its manifest when all are there.

    Slots are run in ``waves``, each a part that is committed whole. A run that was broken off is taken up by calling this again:
    requests that a committed part has are skipped.  The manifest's loads are those of all parts.
    """
    spark = requests.sparkSession
    if exists(spark, f"{path}/manifest.json"):
        raise FileExistsError(f"{path} is complete")
    done = read_run(spark, path)
    rest = requests if done is None else requests.join(done.select("request_id"), "request_id", "left_anti")
    cut = written(slots(rest, F.length("prompt") + 1 + F.col("samples"), most), "slots")
    last = cut.agg(F.max("slot")).first()[0]
    for wave in range(waves if last is not None else 0):
        own = cut.where((F.col("slot") * waves / F.lit(last + 1)).cast("long") == wave)
        records(own, through_adapters(own, load, batch, count), facts).write.parquet(f"{path}/part-{uuid.uuid4().hex}")
    made = read_run(spark, path)
    loads = made.select(F.input_file_name().alias("f"), "task", "load").select(F.element_at(F.split("f", "/"), -2).alias("part"), "task", "load").distinct()
    samples = F.aggregate("outputs", F.lit(0).cast("long"), lambda n, o: n + o["generated_token_count"])
    totals = made.agg(F.count("*").alias("request_count"), F.sum(F.size("outputs")).alias("candidate_count"), F.sum("prompt_token_count").alias("prompt_tokens"), F.sum(samples).alias("generated_tokens"), F.count_distinct("adapter").alias("adapter_count"), F.count_if(F.size("outputs") != F.col("sample_count")).alias("wrong_sample_counts")).first().asDict()
    manifest = {**facts, **totals, "load_count": loads.count(), "schema_version": 1, "kind": "prediction_inference_run", "parts": len(parts(spark, path))}
    if totals["wrong_sample_counts"]:
        raise ValueError(f"{totals['wrong_sample_counts']} records with another number of samples than asked for; they are kept in {path}")
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True) + "\n")
    return manifest
