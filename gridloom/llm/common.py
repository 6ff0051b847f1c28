"""What the training-data operators share: table access and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words and is deleted for exact equality.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Pieces into which a hot key is dealt; see ``salt``.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests) is an own folder set: on a
    cluster, executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Parquet in the shared folder outlives executors, so a lost executor costs
    the tasks it was running and nothing upstream.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete written tables of which all that is needed has been written elsewhere."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that operators have left in the shared folder; frames that still read them can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gridloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def salt(*cols: Column) -> Column:
    """A row's piece number; rows of one hot key fall into ``SALTS`` pieces."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 512 rows and 32 MB, so that long texts don't add up in a worker; smaller settings of the session stay."""
    for name, most in (("maxRecordsPerBatch", 512), ("maxBytesPerBatch", 32 << 20)):
        known = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not known.isdigit() or not 0 < int(known) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def per_key(rows: DataFrame, key: list[str], aggregates: dict[str, tuple[str, str]], piece: str) -> DataFrame:
    """``rows`` with aggregates over ``key``, joined back without one task getting a hot key.

    ``aggregates`` maps a new column to (function, column), of functions that
    combine (min, max, sum).  ``piece`` is a column of ``rows`` with the row's
    salt.  Sums are made per (key, piece) and then per key, and meet the rows
    again on (key, piece), so a key's rows stay dealt over its pieces.
    """
    parts = rows.groupBy(*key, piece).agg(*[getattr(F, f)(c).alias(n) for n, (f, c) in aggregates.items()])
    whole = parts.groupBy(*key).agg(*[getattr(F, f)(n).alias(n) for n, (f, _) in aggregates.items()], F.collect_set(piece).alias("__pieces"))
    return rows.join(whole.withColumn(piece, F.explode("__pieces")).drop("__pieces"), [*key, piece])


def met(rows: DataFrame, table: DataFrame, key: list[str], piece: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row per key), without one task getting a hot key's rows.

    An entry of the table goes to the pieces in which its key has rows.
    """
    pieces = rows.groupBy(*key).agg(F.collect_set(piece).alias("__pieces"))
    return rows.join(table.join(pieces, key).withColumn(piece, F.explode("__pieces")).drop("__pieces"), [*key, piece], how)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
