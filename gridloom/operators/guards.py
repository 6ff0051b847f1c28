"""Guards: a violated rule is a set of rows, and an error only when asked for.

Each ``check`` returns the offending rows, so a guard is a query like any
other; ``raise_if_any`` runs it and fails with a preview.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREVIEW = 10


def raise_if_any(violations: DataFrame, message: str) -> None:
    rows = violations.limit(PREVIEW).collect()
    if rows:
        raise ValueError(f"{message}; first: {[r.asDict() for r in rows]}")


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def missing(required: DataFrame, found: DataFrame, *key: str) -> DataFrame:
    return required.select(*key).distinct().join(found.select(*key), list(key), "left_anti")


def set_difference(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Keys in one frame only, with the side."""
    a, b = (x.select(*key).distinct().withColumn(s, F.lit(True)) for x, s in ((left, "_left"), (right, "_right")))
    both = a.join(b, list(key), "full")
    return both.where("_left is null or _right is null").select(*key, F.when(F.col("_right").isNull(), "missing").otherwise("extra").alias("side"))


def conflicting(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """Keys whose rows don't agree on the fields."""
    print_ = F.sha2(F.to_json(F.struct(*fields)), 256)
    return df.groupBy(key).agg(F.count_distinct(print_).alias("n_versions")).where("n_versions > 1")


def deduplicated(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """One row per key; identical repetitions go, conflicting ones stay for ``conflicting`` to report."""
    return df.dropDuplicates([key, *fields])


def gaps(df: DataFrame, key: list[str], index: str) -> DataFrame:
    """Keys whose index isn't 0..n-1, each once."""
    seen = df.groupBy(*key).agg(F.array_sort(F.collect_list(index)).alias("seen"))
    want = F.transform(F.sequence(F.lit(0), F.size("seen") - 1), lambda i: i.cast("long"))
    return seen.where(F.transform("seen", lambda i: i.cast("long")) != want).select(*key)


def not_functional(df: DataFrame, key: list[str], *fields: str) -> DataFrame:
    """Keys with more than one combination of the fields."""
    return df.groupBy(*key).agg(F.count_distinct(F.struct(*fields)).alias("n")).where("n > 1")
