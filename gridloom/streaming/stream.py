"""Incremental runs: result files that arrive over time, counted once each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def arrivals(spark: SparkSession, folder: str, schema: str, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder, or those whose name fits a pattern, as a stream."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def once(stream: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Records by their first arrival; with an event time, keys are remembered only as long as records may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there, into Parquet in the shared folder, and reads the result."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))
