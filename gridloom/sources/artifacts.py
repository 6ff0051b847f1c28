"""Artifacts of any size: parts in a stated order, one digest over all, committed in two steps.

Rows are JSON lines.  Their places are found by ranges, a part is ``ROWS`` of them, and each is a
folder of its own.  A part's digest is that of its lines' digests in order; parts' digests are folded
``FAN`` at a time until one is left.  Parts are written under a dotted name, their digest is taken from what is
written, and then the folder gets its name and the manifest its content: without a manifest there is no artifact.
The driver sees the last digest, counts and the manifest, whatever the number of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.ranges import numbered, summed
from ..functions.text import NOT_BLANK, bare, is_blank, strip
from .files import file_stem, sorted_json
from .shared import exists, renamed, write_text, written

ROWS, FAN = 10_000, 256


def folded(digests: DataFrame, fan: int = FAN) -> str | None:
    """One digest of many. digests: at (places from 0, without gaps) and digest (hex); in groups of ``fan``, level by level. None if there are none."""
    rows = digests.select("at", "digest")
    size = rows.count()
    while size > 1:
        group = F.floor(F.col("at") / fan)
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda d: d["digest"]), "\n")
        rows = rows.groupBy(group.alias("up")).agg(F.sha2(joined, 256).alias("digest")).select(F.col("up").alias("at"), "digest")
        size = -(-size // fan)
    found = rows.first()
    return found["digest"] if found else None


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(part, at, value): the lines of an artifact's parts, with their order in the part."""
    part = F.regexp_extract("_metadata.file_path", "/part=([0-9]+)/", 1).cast("long").alias("part")
    return spark.read.text(path).select(part, F.monotonically_increasing_id().alias("at"), "value")


def digest_of(lines: DataFrame, fan: int = FAN) -> tuple[str | None, int]:
    """The digest over parts of lines, and the number of lines. A part's lines are in one file, so ``at`` is their order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.sha2("value", 256).alias("d")))), lambda d: d["d"]), "\n")
    found = lines.groupBy("part").agg(F.sha2(joined, 256).alias("digest"), F.count("*").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    return folded(found.select(F.col("part").alias("at"), "digest"), fan), total


def write_artifact(df: DataFrame, path: str, facts: dict[str, Any], *order: str | Column, rows: int = ROWS, fan: int = FAN) -> dict[str, Any]:
    """Rows as an artifact, in the order of columns (without any: as they are read). Returns the manifest; nothing is overwritten."""
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(f"{path} exists")
    placed = numbered(df, *order, name="__ordinal")
    lines = placed.select(F.floor(F.col("__ordinal") / rows).cast("long").alias("part"), "__ordinal", sorted_json(*df.columns).alias("value"))
    part = f"{path}.writing-{uuid.uuid4().hex}"
    lines.repartition("part").sortWithinPartitions("part", "__ordinal").select("part", "value").write.partitionBy("part").text(f"{part}/rows")
    digest, n = digest_of(lines_of(spark, f"{part}/rows"), fan)
    manifest = {**facts, "schema_version": 1, "rows_per_part": rows, "fan": fan, "record_count": n, "output_sha256": digest}
    renamed(spark, part, path)
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True) + "\n")
    return manifest


def manifest_of(spark: SparkSession, path: str, **expected: Any) -> dict[str, Any]:
    """An artifact's manifest, checked before any row is read: version and the facts that are expected."""
    if not exists(spark, f"{path}/manifest.json"):
        raise FileNotFoundError(f"{path} has no manifest: it was never finished")
    found = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])
    other = {k: found.get(k) for k, v in {"schema_version": 1, **expected}.items() if found.get(k) != v}
    if other:
        raise ValueError(f"{path} is another artifact: {other}")
    return found


def verified(spark: SparkSession, path: str, **expected: Any) -> dict[str, Any]:
    """The manifest of an artifact whose rows are what it states."""
    found = manifest_of(spark, path, **expected)
    digest, n = digest_of(lines_of(spark, f"{path}/rows"), found["fan"])
    if (digest, n) != (found["output_sha256"], found["record_count"]):
        raise ValueError(f"{path} isn't what its manifest states")
    return found


def read_artifact(spark: SparkSession, path: str, schema: str, **expected: Any) -> DataFrame:
    """The rows of an artifact under a schema, with their ``ordinal``; expected: facts that its manifest must state."""
    found = manifest_of(spark, path, **expected)
    rows = lines_of(spark, f"{path}/rows")
    first = rows.groupBy("part").agg(F.min("at").alias("first"))
    placed = rows.join(first, "part").withColumn("ordinal", F.col("part") * found["rows_per_part"] + F.col("at") - F.col("first"))
    return placed.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "ordinal").select("r.*", "ordinal")


def files_digest(spark: SparkSession, path: str, fan: int = FAN) -> str | None:
    """One digest over the JSON files of a folder by stem, names and contents; a file is hashed where it is read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    own = rows.select(file_stem(name).alias("stem"), F.sha2(F.concat(F.encode(name, "utf-8"), F.lit(b"\0"), "content", F.lit(b"\0")), 256).alias("digest"))
    return folded(numbered(own, "stem", name="at"), fan)


def counted_write(df: DataFrame, write: Callable[[DataFrame], None], **conditions: Column) -> dict[str, int]:
    """Writes rows and returns, from the same pass, their number (``rows``) and how many meet each condition."""
    seen = Observation(f"write-{uuid.uuid4().hex}")
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()]))
    return seen.get


# --- lines and lists in their order ---------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): text lines with their number from 1 in their file, however files are split.

    A first pass counts the lines of each split; what stands before a split is the sum of the earlier ones of its file.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.expr("coalesce(sum(n) over (partition by file order by start rows between unbounded preceding and 1 preceding), 0)")
    blocks = blocks.select("file", "start", "first", earlier.alias("before"))
    return rows.join(blocks, ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def malformed_places(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of lines that aren't JSON objects."""
    rows = numbered_lines(spark, path)
    return rows.where(~is_blank(F.col("value")) & ~F.coalesce(F.startswith(strip(F.col("value")), F.lit("{")) & F.try_parse_json("value").isNotNull(), F.lit(False)))


def read_ordered_ids(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, ordinal): the ids of JSON lines (strings, or objects with a task_id) in the order of files and lines; '.json' is stripped."""
    rows = spark.read.text(path).where(F.col("value").rlike(NOT_BLANK))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), bare(F.col("value")).alias("line"))
    line = F.col("line")
    name = F.when(F.startswith(line, F.lit("{")), F.get_json_object(line, "$.task_id")).otherwise(F.get(F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<string>"), F.lit(0)))
    rows = rows.select("file", "start", name.alias("name"), F.monotonically_increasing_id().alias("at"))
    ids = written(rows.select("file", "start", "at", F.regexp_replace(strip(F.col("name")), r"\.json\z", "").alias("task_id")), "ids")  # texts are read once
    blocks = ids.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    placed = ids.join(summed(blocks, ["file", "start"], F.col("n")), ["file", "start"])
    return placed.select("task_id", (F.col("before") + F.col("at") - F.col("first")).alias("ordinal"))


def chosen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of listed tasks with their place in the list: ``rows`` joined with (task_id, ordinal), for readers that keep the list's order."""
    return rows.join(ids, "task_id")
