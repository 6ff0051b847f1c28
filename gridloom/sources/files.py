"""Reading and writing the artifacts of a run: tasks, JSON lines, plans, guidance, manifests.

Data files are read and written by Spark, with stated schemas.  Manifests and
reports are single small JSON or Markdown files that the driver writes next to
them, first under a dotted name, then renamed; nothing is overwritten unless
asked for.
"""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, traces
from ..functions.grids import is_grid
from ..functions.text import is_blank, strip
from . import schemas


def file_stem(path: Column, suffix: str = ".json") -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.endswith(name, F.lit(suffix)), F.substr(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


# --- tasks --------------------------------------------------------------------------


def read_tasks(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """task_id, train, test of one JSON file per task; ids (task_id) choose tasks."""
    rows = spark.read.schema(schemas.TASK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.select(file_stem(F.col("_metadata.file_name")).alias("task_id"), "train", "test")
    return rows if ids is None else rows.join(ids.select("task_id").distinct(), "task_id", "left_semi")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(stem, record) of JSON files of any shape, as variants; a malformed file fails the read."""
    return spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_name")).alias("stem"), F.parse_json("value").alias("record"))


def malformed_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks without a list of train or of test pairs."""
    return tasks.where("train is null or test is null").select("task_id")


def long_form(tasks: DataFrame) -> DataFrame:
    """(task_id, split, pair_index, input, output), train pairs first."""
    side = lambda s: tasks.select("task_id", F.lit(s).alias("split"), F.posexplode(s).alias("pair_index", "pair"))
    return side("train").unionByName(side("test")).select("task_id", "split", "pair_index", "pair.input", "pair.output")


def all_pairs(tasks: DataFrame) -> DataFrame:
    """Train pairs followed by test pairs as one list per task."""
    return tasks.select("task_id", F.concat("train", "test").alias("pairs"))


def expected_outputs(tasks: DataFrame) -> DataFrame:
    return tasks.select("task_id", F.posexplode("test").alias("test_index", "pair")).select("task_id", "test_index", F.col("pair.output").alias("expected"))


def unlabelled_tests(tasks: DataFrame) -> DataFrame:
    return expected_outputs(tasks).where("expected is null").select("task_id", "test_index")


def bad_expected(tasks: DataFrame) -> DataFrame:
    """(task_id, test_index, problem): test outputs that are missing, no rectangle, or of other values than 0 to 9; and tasks without test pairs (no index)."""
    sound = is_grid(F.col("expected")) & F.forall("expected", lambda row: F.forall(row, lambda v: F.coalesce(v.between(0, 9), F.lit(False))))
    rows = expected_outputs(tasks).withColumn("problem", F.when(F.col("expected").isNull(), "no output").when(~F.coalesce(sound, F.lit(False)), "bad grid"))
    none = tasks.where(F.coalesce(F.size("test"), F.lit(0)) <= 0).select("task_id", F.lit(None).cast("int").alias("test_index"), F.lit("no test pairs").alias("problem"))
    return rows.where("problem is not null").select("task_id", "test_index", "problem").unionByName(none)


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """Task ids of a JSON list of file names: what stands before the first dot."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("name"))
    return rows.select(F.split_part("name", F.lit("."), F.lit(1)).alias("task_id"))


def stem(name: Column) -> Column:
    """The last part of a path without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*\z", "")


def read_listed_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task ids of JSON lines (objects with a task_id, taken as they are), or of a JSON list of task files (their stems)."""
    if path.endswith(".jsonl"):
        return read_lines(spark, path, "task_id string")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("name"))
    return rows.select(stem(F.col("name")).alias("task_id"))


def read_task_ids(spark: SparkSession, path: str) -> DataFrame:
    """Normalised task ids of a JSON list, or of JSON lines that are objects with a task_id or bare strings; '.json' is stripped."""
    if path.endswith(".jsonl"):
        line = strip(F.col("value"))
        rows = spark.read.text(path).where(~is_blank(F.col("value"))).select(F.when(F.startswith(line, F.lit("{")), F.get_json_object(line, "$.task_id")).otherwise(F.get(F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<string>"), F.lit(0))).alias("task_id"))
    else:
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("task_id"))
    return rows.select(F.regexp_replace(strip(F.col("task_id")), r"\.json\z", "").alias("task_id"))


def bad_task_ids(ids: DataFrame) -> DataFrame:
    """Ids that are empty, hold an underscore or occur twice."""
    counts = ids.groupBy("task_id").agg(F.count("*").alias("n"))
    return counts.where(F.col("task_id").isNull() | (F.col("task_id") == "") | F.contains("task_id", F.lit("_")) | (F.col("n") > 1)).select("task_id", "n")


# --- JSON lines ---------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped, malformed ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, text of lines that aren't JSON objects, for an error report."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.where(~is_blank(F.col("value")) & F.try_parse_json("value").isNull())


def read_existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Like ``read_lines``, but empty where nothing is at the path."""
    reader = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = reader.getFileSystem(spark._jsc.hadoopConfiguration()).exists(reader)
    return read_lines(spark, path, schema) if there else spark.createDataFrame([], schema)


def write_lines(df: DataFrame, path: str, replace: bool = False, compression: str | None = None) -> None:
    """JSON lines with null fields left out; compressed files (``gzip``) are read back alike, each by one task."""
    df.write.mode("overwrite" if replace else "errorifexists").option("ignoreNullFields", "true").json(path, compression=compression)


def sorted_json(*columns: str) -> Column:
    """A row as JSON with its keys in order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


# --- hints, traces and guidance -------------------------------------------------------

HINT_FIELDS = ("general", "inputs", "outputs", "transformation", "transformation_steps")


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    rows = read_lines(spark, path, schemas.HINT)
    return rows.withColumn("status", traces.hint_status(*[F.col(f) for f in HINT_FIELDS]))


def hint_statuses(hints: DataFrame) -> DataFrame:
    """Hints with their status, and the names of fields that are blank where some but not all are given."""
    status = traces.hint_status(*[F.col(f) for f in HINT_FIELDS])
    blank = F.filter(F.array(*[F.when(is_blank(F.col(f)), f) for f in HINT_FIELDS]), lambda f: f.isNotNull())
    return hints.withColumn("status", status).withColumn("missing_fields", F.when(F.col("status") == "incomplete", blank).otherwise(F.array().cast("array<string>")))


def read_hint_folder(spark: SparkSession, path: str) -> DataFrame:
    """Hints of one JSON file per task: an object, or a list whose first element counts. A file without any field is incomplete; fields that aren't texts are blank."""
    rows = spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_name")).alias("task_id"), F.parse_json("value").alias("v"))
    one = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$[0]", "variant")).otherwise(F.col("v"))
    rows = rows.select("task_id", one.alias("v"))

    def field(name: str) -> Column:
        value = F.try_variant_get("v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get("v", f"$.{name}", "string")).alias(name)

    found = hint_statuses(rows.select(F.lit(1).alias("schema_version"), "task_id", F.schema_of_variant("v").startswith("OBJECT").alias("is_object"), *map(field, HINT_FIELDS)))
    every = F.array(*map(F.lit, HINT_FIELDS))
    return found.withColumn("missing_fields", F.when(F.col("status") == "missing", every).otherwise(F.col("missing_fields"))).withColumn("status", F.when(F.col("status") == "missing", "incomplete").otherwise(F.col("status")))


def read_hint_source(spark: SparkSession, path: str) -> DataFrame:
    """Hints of JSON lines or of a folder of JSON files, with their status; a folder's files must hold objects."""
    return read_hints(spark, path) if path.endswith(".jsonl") else read_hint_folder(spark, path).drop("missing_fields", "is_object")


def bad_hints(hints: DataFrame) -> DataFrame:
    """Task ids with a hint of another version or with several."""
    return hints.groupBy("task_id").agg(F.count("*").alias("n"), F.bool_and(F.col("schema_version") == 1).alias("ok")).where("n > 1 or not ok or ok is null")


def with_hints(tasks: DataFrame, hints: DataFrame) -> DataFrame:
    """Tasks with their hint, if any, and its status."""
    hint = hints.select("task_id", F.struct(*HINT_FIELDS).alias("hint"), "status")
    return tasks.join(hint, "task_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def read_guidance(spark: SparkSession, path: str) -> DataFrame:
    """(key, guidance) of reasoning records: the first text among guidance, trace, normalised and raw output, reduced to its summary; null where that is invalid."""
    rows = read_lines(spark, path, schemas.GUIDANCE)
    text = F.coalesce("guidance", "trace", "normalized_output", "raw_output")
    return rows.select(F.coalesce("request_id", "key").alias("key"), traces.any_guidance(text).alias("guidance"))


def read_guidance_map(spark: SparkSession, path: str, wrappers: tuple[str, ...] = ("guidance", "guided", "predictions")) -> DataFrame:
    """The same of one JSON object, possibly under a wrapper; a value is a text, a record or a list of which the first counts; ``meta`` is skipped."""
    body = F.parse_json("value")
    inner = F.coalesce(*[F.try_variant_get(body, f"$.{w}", "map<string,variant>") for w in wrappers], F.try_variant_get(body, "$", "map<string,variant>"))
    rows = spark.read.text(path, wholetext=True).select(F.explode(inner).alias("key", "v")).where("key <> 'meta'")
    one = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$[0]", "variant")).otherwise(F.col("v"))
    rows = rows.select("key", one.alias("v"))
    fields = [F.try_variant_get("v", f"$.{f}", "string") for f in ("guidance", "trace", "normalized_output", "raw_output")]
    text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.coalesce(*fields))
    return rows.select("key", traces.any_guidance(text).alias("guidance"))


def read_adaptation_guidance(spark: SparkSession, path: str) -> DataFrame:
    """(key, guidance) for adaptation: of whole traces what follows the private block, of others the summary; blank ones are '', texts without both headings null."""
    rows = read_lines(spark, path, schemas.GUIDANCE)
    text = F.coalesce("guidance", "trace", "normalized_output", "raw_output")
    return rows.select(F.coalesce("request_id", "key").alias("key"), F.when(text.isNotNull() & is_blank(text), "").otherwise(traces.any_guidance(text)).alias("guidance"))


def bad_guidance(rows: DataFrame, augmented_only: bool = False) -> DataFrame:
    """Keys that are missing, repeated, without text or, if asked for, not augmented."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.count("guidance").alias("texts"))
    bad = F.col("key").isNull() | (F.col("key") == "") | (F.col("n") > 1) | (F.col("texts") < F.col("n"))
    return counts.where(bad | ~keys.is_augmented(F.col("key")) if augmented_only else bad).select("key", "n")


# --- plans ----------------------------------------------------------------------------


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, code, value_mapping, order_mapping, at) of a plan file: records under ``tasks``, or a map of lists of keys."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = text.select(F.explode(F.coalesce(F.try_variant_get("v", "$.tasks", "map<string,array<variant>>"), F.try_variant_get("v", "$", "map<string,array<variant>>"))).alias("owner", "planned"))
    each = rows.select("owner", F.posexplode("planned").alias("at", "p"))
    key = F.coalesce(F.try_variant_get("p", "$.augmented_key", "string"), F.when(F.schema_of_variant("p") == "STRING", F.try_variant_get("p", "$", "string")))
    return each.select(keys.parsed_key(key).alias("k"), "at", "owner").select(F.coalesce("k.task_id", "owner").alias("task_id"), "k.code", "k.value_mapping", "k.order_mapping", "at")


def plan_document(plan: DataFrame, seed: int) -> DataFrame:
    """One JSON document of a plan, in one row per task (tasks are independent; joined by the writer)."""
    record = F.struct(F.concat_ws("_", "task_id", "code", "value_mapping", "order_mapping").alias("augmented_key"), "task_id", F.col("code").alias("transformation_code"), "value_mapping", "order_mapping", "variant_index")
    rows = plan.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("variant_index", record.alias("r")))).alias("planned"))
    return rows.select("task_id", F.to_json(F.transform("planned", lambda p: p["r"])).alias("records"), F.lit(seed).alias("seed"))


def write_plan(plan: DataFrame, path: str, seed: int) -> None:
    """A plan file that ``read_plan`` reads; never over an existing one. Tasks stream through the driver one at a time."""
    refuse_existing(path)
    part = Path(path).with_name(f".{Path(path).name}.partial")
    with part.open("x", encoding="utf-8") as f:
        f.write(json.dumps({"schema_version": 1, "kind": "augmentation_plan", "seed": seed, "variants_per_transform": 8})[:-1] + ', "tasks": {')
        for k, row in enumerate(plan_document(plan, seed).orderBy("task_id").toLocalIterator()):
            f.write((", " if k else "") + json.dumps(row["task_id"]) + ": " + row["records"])
        f.write("}}\n")
    part.rename(path)


# --- single files on the driver ---------------------------------------------------------


def refuse_existing(*paths: str) -> None:
    """Fails before any work if an output, its manifest or a partial file is there."""
    for p in map(Path, paths):
        for q in (p, p.with_name(f".{p.name}.partial")):
            if q.exists():
                raise FileExistsError(f"{q} exists")


def manifest_path(path: str) -> str:
    if not path.lower().endswith(".jsonl"):
        raise ValueError("an artifact's name ends in .jsonl")
    return f"{path[: -len('.jsonl')]}.manifest.json"


def write_json(value: Any, path: str, replace: bool = False) -> None:
    """A JSON file, complete or not at all."""
    if not replace:
        refuse_existing(path)
    part = Path(path).with_name(f".{Path(path).name}.partial")
    part.write_text(json.dumps(value, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    os.replace(part, path)


def write_artifact(df: DataFrame, path: str, facts: dict[str, Any]) -> dict[str, Any]:
    """Rows as one JSON-lines file with a manifest of facts, count and digest. Rows stream through the driver in order."""
    refuse_existing(path, manifest_path(path))
    part, digest, n = Path(path).with_name(f".{Path(path).name}.partial"), hashlib.sha256(), 0
    with part.open("xb") as f:
        for row in df.select(sorted_json(*df.columns).alias("line")).toLocalIterator():
            line = row["line"].encode() + b"\n"
            digest.update(line)
            f.write(line)
            n += 1
    part.rename(path)
    manifest = {**facts, "schema_version": 1, "output_path": path, "record_count": n, "output_sha256": digest.hexdigest()}
    write_json(manifest, manifest_path(path))
    return manifest


def verified_manifest(spark: SparkSession, path: str, kind: str) -> dict[str, Any]:
    """The manifest of an artifact whose version, kind and digest are as stated."""
    found = json.loads(Path(manifest_path(path)).read_text(encoding="utf-8"))
    if found.get("schema_version") != 1 or found.get("kind") != kind:
        raise ValueError(f"{path} is no {kind} of version 1")
    actual = file_digests(spark, path).first()["sha256"]
    if found.get("output_sha256") != actual:
        raise ValueError(f"{path} isn't what its manifest states")
    return found


# --- digests --------------------------------------------------------------------------


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def source_facts(spark: SparkSession, path: str | None) -> dict[str, str | None]:
    """Path and digest of an optional input, for a manifest."""
    return {"path": path, "sha256": file_digests(spark, path).first()["sha256"] if path is not None else None}


def tasks_digest(spark: SparkSession, path: str, ids: DataFrame | None = None) -> str:
    """One digest over task files in order of task id: name, zero, content, zero. Contents stream through the driver."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").withColumn("task_id", file_stem(F.col("name")))
    if ids is not None:
        rows = rows.join(ids.select("task_id").distinct(), "task_id", "left_semi")
    digest = hashlib.sha256()
    for row in rows.orderBy("task_id").toLocalIterator():
        digest.update(row["name"].encode() + b"\0" + bytes(row["content"]) + b"\0")
    return digest.hexdigest()


# --- predictions ----------------------------------------------------------------------


def candidates(predictions: DataFrame) -> DataFrame:
    """One row per sample of prediction records, as the scoring operators take them."""
    rows = predictions.select("task_id", "test_index", "request_id", F.col("variant.transformation_code").alias("code"), F.col("variant.value_mapping").alias("value_mapping"), F.explode("outputs").alias("o"))
    return rows.select("task_id", "test_index", "request_id", "code", "value_mapping", F.col("o.sample_index").alias("sample_index"), F.col("o.text").alias("text"), F.col("o.generated_token_count").alias("generated_tokens"))


def inconsistent_variants(predictions: DataFrame) -> DataFrame:
    """Records whose variant contradicts itself: an original view that isn't the identity, or a key that its parts don't make."""
    v = F.col("variant")
    plain = ~v["is_augmented"] & (v["transformation_code"] == "ID") & (v["value_mapping"] == "0123456789") & v["order_mapping"].isNull() & v["variant_index"].isNull() & (v["key"] == v["task_id"])
    made = keys.made_key(v["task_id"], v["transformation_code"], v["value_mapping"], v["order_mapping"])
    full = v["is_augmented"] & (v["variant_index"] >= 0) & (made == v["key"])
    return predictions.where(~F.coalesce(plain | full, F.lit(False)) | (v["task_id"] != F.col("task_id"))).select("request_id")
