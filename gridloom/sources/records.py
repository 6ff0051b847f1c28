"""Loaders of the record kinds that take several forms, and token caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, traces
from ..functions.text import is_blank, strip
from . import files, schemas

VALIDATION = "schema_version int, split string, variant_id string, task_id string, trace string, augmentation struct<transformation_code:string,value_mapping:string,order_mapping:string>"
TOKENS = "split string, task_id string, variant_id string, input_ids array<int>, spans array<struct<start:int,end:int>>, sequence_length int"


def first_text(value: Column, key: Column) -> Column:
    """The trace of a JSON value: a text, the first entry of a list, the field of the key, or the first present of four fields."""
    one = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$[0]", "variant")).otherwise(value)
    fields = F.try_variant_get(one, "$", "map<string,variant>")
    named = [F.try_variant_get(F.try_element_at(fields, k), "$", "string") for k in (key, *map(F.lit, ("trace", "cot", "response", "final")))]
    plain = F.when(F.schema_of_variant(one) == "STRING", F.try_variant_get(one, "$", "string"))
    text = strip(F.coalesce(plain, *named))
    return F.when(text != "", text)


def traces_by_key(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, trace) of JSON lines; ``guards.repeated`` finds keys with several."""
    return files.read_lines(spark, path, "task_id string, trace string").select("task_id", strip(F.col("trace")).alias("trace"))


def trace_of_file(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The trace that a JSON or text file holds for a key, as one row; null if there is none."""
    whole = spark.read.text(path, wholetext=True)
    if not path.endswith(".json"):
        return whole.select(F.lit(key).alias("task_id"), F.when(~is_blank(F.col("value")), strip(F.col("value"))).alias("trace"))
    return whole.select(F.lit(key).alias("task_id"), first_text(F.parse_json("value"), F.lit(key)).alias("trace"))


def few_shot_pool(manifest: DataFrame, tasks: DataFrame, hints: DataFrame, found: DataFrame) -> DataFrame:
    """manifest: task_id, pool_order, trace (or null: looked up in ``found``). Pool order counts, so it is kept as a column."""
    given = manifest.select("task_id", "pool_order", F.when(~is_blank(F.col("trace")), strip(F.col("trace"))).alias("own"))
    rows = given.join(found.select("task_id", F.col("trace").alias("other")), "task_id", "left").join(tasks.select("task_id", "train"), "task_id", "left")
    return files.with_hints(rows.select("task_id", "pool_order", "train", F.coalesce("own", "other").alias("trace")), hints)


def bad_pool(pool: DataFrame) -> DataFrame:
    """Entries without a task, a trace, or with a task twice."""
    counts = pool.groupBy("task_id").agg(F.count("*").alias("n"), F.count("trace").alias("texts"), F.count("train").alias("puzzles"))
    return counts.where("n > 1 or texts < n or puzzles < n")


def base_traces(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, task_id, trace, accepted) of selected traces, normalised."""
    rows = files.read_lines(spark, path, "task_id string, trace string").withColumn("trace", traces.normalised(F.col("trace")))
    return rows.select(F.concat(F.lit("base-trace-"), F.col("task_id")).alias("source_id"), "task_id", "trace", traces.format_verdict(F.col("trace"))["accepted"].alias("accepted"))


def validation_variants(spark: SparkSession, path: str) -> DataFrame:
    return files.read_lines(spark, path, VALIDATION)


def bad_validation(rows: DataFrame, split: str) -> DataFrame:
    """Records of another version or split, with a malformed trace or augmentation, and variants or tasks that occur twice."""
    own = F.coalesce(traces.format_verdict(traces.normalised(F.col("trace")))["accepted"], F.lit(False)) & (F.col("schema_version") == 1) & (F.col("split") == split)
    aug = F.col("augmentation")
    good = own & (aug.isNull() | keys.made_key(F.col("task_id"), aug["transformation_code"], aug["value_mapping"], aug["order_mapping"]).isNotNull())
    single = rows.where(~F.coalesce(good, F.lit(False))).select("variant_id", "task_id")
    twice = [rows.groupBy(k).agg(F.count("*").alias("n")).where("n > 1").join(rows, k).select("variant_id", "task_id") for k in ("variant_id", "task_id")]
    return single.union(twice[0]).union(twice[1]).distinct()


def external_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, pair_index, input, output) of files that each hold a list of generated pairs."""
    rows = spark.read.text(path, wholetext=True).select(files.file_stem(F.col("_metadata.file_name")).alias("task_id"), F.from_json("value", f"array<struct<input:{schemas.GRID},output:{schemas.GRID}>>", {"mode": "FAILFAST"}).alias("pairs"))
    return rows.select("task_id", F.posexplode("pairs").alias("pair_index", "p")).select("task_id", "pair_index", "p.input", "p.output")


def bad_external(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, problem) of generated pair files that are no list, an empty one, or have an entry without input and output grids."""
    rows = spark.read.text(path, wholetext=True).select(files.file_stem(F.col("_metadata.file_name")).alias("task_id"), F.try_parse_json("value").alias("v"))
    entries = F.try_variant_get("v", "$", "array<variant>")
    whole = lambda e: F.try_variant_get(e, "$.input", schemas.GRID).isNotNull() & F.try_variant_get(e, "$.output", schemas.GRID).isNotNull()
    problem = F.when(entries.isNull(), "no list").when(F.size(entries) == 0, "empty").when(~F.forall(entries, whole), "no pair")
    return rows.select("task_id", problem.alias("problem")).where("problem is not null")


def write_tokens(rows: DataFrame, path: str) -> None:
    """A token cache: Parquet by split, never over an existing one. ``corpus.length_stats`` makes its manifest."""
    rows.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(path)


def contract_digest(contract: DataFrame) -> DataFrame:
    """One digest of what a cache was built under; caches with equal digests may be used for each other."""
    return contract.select(F.sha2(files.sorted_json(*contract.columns), 256).alias("digest"))
