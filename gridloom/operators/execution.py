"""The model boundary: a pluggable batch generator behind ``mapInPandas``.

A generator takes the prompts of one batch and a sample count and returns, per
prompt, that many completions.  ``echo`` is a deterministic stand-in.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import traces
from ..functions.text import sha256
from ..sources import files, schemas
from ..sources.shared import write_text
from . import guards, requests

Generator = Callable[[list[str], int], list[list[str]]]
OUTPUTS = "array<struct<sample_index:int,text:string,generated_token_count:bigint,finish_reason:string>>"


def echo(prompts: list[str], samples: int) -> list[list[str]]:
    """Digits drawn from a hash of prompt and sample number."""
    digits = lambda p, k: "".join(str(int(c, 16) % 10) for c in hashlib.sha256(f"{k}:{p}".encode()).hexdigest()[:6])
    return [[f"{d[:3]}\n{d[3:]}" for k in range(samples) for d in (digits(p, k),)] for p in prompts]


def generated(requests: DataFrame, generator: Generator, batch: int = 256, group: str | None = None) -> DataFrame:
    """requests: request_id, prompt, samples. Completions per request, in batches of prompts that ask for the same number; ``group`` (an adapter, say) keeps its requests together."""
    rows = requests.repartition(group) if group else requests

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for samples, same in frame.groupby("samples", sort=True):
                for k in range(0, len(same), batch):
                    some = same.iloc[k : k + batch]
                    texts = generator(list(some["prompt"]), int(samples))
                    outputs = [[{"sample_index": i, "text": t, "generated_token_count": len(t.encode()), "finish_reason": "stop"} for i, t in enumerate(ts)] for ts in texts]
                    yield pd.DataFrame({"request_id": some["request_id"].to_numpy(), "outputs": outputs})

    return rows.select("request_id", "prompt", "samples").mapInPandas(run, f"request_id string, outputs {OUTPUTS}")


def provider_defaults(asked: DataFrame) -> DataFrame:
    """Requests that leave their sampling to a provider, which a local engine can't know."""
    return asked.where("sampling.use_provider_defaults").select("request_id")


def local_results(asked: DataFrame, generator: Generator, model: str, batch: int = 256) -> DataFrame:
    """asked: request_id, task_id, stage, messages, sampling. One result per request, of its first completion; requests of one sampling run together."""
    prompts = requests.rendered(asked).withColumnRenamed("text", "prompt")
    keyed = asked.select("request_id", "task_id", "stage").join(prompts, "request_id").withColumn("samples", F.lit(1))
    found = generated(keyed, generator, batch).select("request_id", F.get("outputs", F.lit(0)).alias("o"))
    rows = found.join(asked.select("request_id", "task_id", "stage"), "request_id")
    return rows.select("request_id", "task_id", "stage", F.lit("local").alias("backend"), F.lit(model).alias("model"), F.col("o.text").alias("raw_output"), F.col("o.finish_reason").alias("finish_reason"))


def guidance_records(found: DataFrame) -> DataFrame:
    """found: request_id, task_id, prompt, outputs. Guidance records: the completion, its guidance, and what is wrong where there is none."""
    one = F.when(F.size("outputs") == 1, F.get("outputs", F.lit(0)))
    rows = found.withColumn("o", one).withColumn("guidance", traces.guidance(F.col("o.text")))
    wrong = F.when(F.col("o").isNull(), "not one completion").when(F.col("guidance").isNull(), "no valid guidance")
    return rows.select(
        F.lit(1).alias("schema_version"), F.lit("reasoning_guidance").alias("kind"), "request_id", "task_id", sha256(F.col("prompt")).alias("user_prompt_sha256"),
        F.col("o.text").alias("raw_output"), "guidance", wrong.alias("validation_error"), F.col("o.generated_token_count").alias("generated_token_count"), F.col("o.finish_reason").alias("finish_reason"),
    )


def reasoning_run(asked: DataFrame, generator: Generator, path: str, facts: dict) -> None:
    """asked: request_id, task_id, prompt. Runs a reasoning model once; malformed completions are kept and counted in the manifest, and only then an error."""
    spark = asked.sparkSession
    files.write_lines(guidance_records(asked.join(generated(asked.withColumn("samples", F.lit(1)), generator), "request_id")), path)
    written = files.read_lines(spark, path, f"{schemas.GUIDANCE}, generated_token_count long")
    bad = written.where("validation_error is not null").select("request_id", "validation_error")
    counts = written.agg(F.count("*").alias("record_count"), F.count("guidance").alias("valid_count"), F.coalesce(F.sum("generated_token_count"), F.lit(0)).alias("generated_tokens")).first()
    write_text(spark, f"{path}.manifest.json", json.dumps({**facts, **counts.asDict(), "schema_version": 1, "kind": "reasoning_guidance"}, indent=2, sort_keys=True) + "\n")
    guards.raise_if_any(bad, f"malformed completions, kept in {path}")
