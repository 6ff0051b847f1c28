"""Places of rows in an order, without a task that sees them all.

Rows are sorted in ranges and written; a range's rows know their place in it,
and the ranges' sizes (one number each) are added up before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: The bits of ``monotonically_increasing_id`` that count within a partition.
INNER = 33


def before(sizes: DataFrame, part: str, size: str) -> DataFrame:
    """(part, offset): the sum of the sizes of earlier parts. sizes: one row for each part, which are few."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(part, F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("long").alias("__offset"))


def numbered(rows: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """Written rows with their place from 0, in the order of columns; without columns, in the order in which they are read."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    kept = written(sorted_.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__id", INNER), F.col("__id").bitwiseAND(F.lit((1 << INNER) - 1))
    kept = kept.withColumn("__part", part)
    offsets = before(kept.groupBy("__part").agg(F.count("*").alias("__n")), "__part", "__n")
    return kept.join(F.broadcast(offsets), "__part").select(*rows.columns, (F.col("__offset") + place).alias(name))


def summed(rows: DataFrame, order: list[str], value: Column, name: str = "before") -> DataFrame:
    """Written rows with the sum of a value over all rows before them in an order."""
    kept = written(rows.withColumn("__value", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "summed")
    kept = kept.withColumn("__part", F.shiftright("__id", INNER))
    offsets = before(kept.groupBy("__part").agg(F.sum("__value").alias("__n")), "__part", "__n")
    own = F.sum("__value").over(Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1))
    found = kept.withColumn(name, F.coalesce(own, F.lit(0)))
    return found.join(F.broadcast(offsets), "__part").select(*rows.columns, (F.col(name) + F.col("__offset")).cast("long").alias(name))
