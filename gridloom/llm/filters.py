"""Bitmap filters of bounded size, and keeping decided rows without moving their texts.

A filter holds the positions of hashed keys, ``BITS_PER_KEY`` bits for each, so
some 6 % of other rows pass.  It grows with its keys up to ``MOST_BITS`` bits
(128 MB, enough for 67 million keys at that rate): that bound is what makes it
broadcastable.  Only keys that decide something are held: those dropped, or
those that occur twice.  Beyond the bound it lets more rows through, which then
are shuffled: that costs time, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize

BITS_PER_KEY, MOST_BITS, BITMAP_BITS = 16, 1 << 30, 1 << 15


def bits_for(n: int) -> int:
    bits = BITMAP_BITS
    while bits < min(BITS_PER_KEY * n, MOST_BITS):
        bits *= 2
    return bits


def bitmaps(positions: DataFrame, label: str) -> DataFrame:
    """Bitmaps by bucket of a frame of distinct or repeated ``pos``."""
    bitmap = F.bitmap_construct_agg(F.col("pos") % BITMAP_BITS).alias("__bitmap")
    return materialize(positions.groupBy(F.floor(F.col("pos") / BITMAP_BITS).alias("__bucket")).agg(bitmap), label)


def position(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits))


def marked(rows: DataFrame, maps: DataFrame, bits: int, key: Column) -> DataFrame:
    """``rows`` with ``__held``: whether the filter holds the hashed key."""
    byte = F.expr(f"cast(conv(hex(substring(__bitmap, cast(floor(__pos % {BITMAP_BITS} / 8) as int) + 1, 1)), 16, 10) as int)")
    bit = F.call_function("shiftright", byte, F.expr("cast(__pos % 8 as int)")).bitwiseAND(F.lit(1)) == 1
    found = rows.withColumn("__pos", position(key, bits)).withColumn("__bucket", F.floor(F.col("__pos") / BITMAP_BITS))
    found = found.join(F.broadcast(maps), "__bucket", "left")
    return found.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias("__held"))


def keep_decided(rows: DataFrame, decided: DataFrame, key: list[str], unique: bool, first: Column | None = None) -> DataFrame:
    """The rows whose key was decided to stay.

    decided: the key and ``kept``, one row per row of ``rows``.  Rows that a
    filter of the dropped keys doesn't hold stay where they are; only the
    others, with their texts, are shuffled to meet the kept keys.  unique: of
    rows that repeat a key of which one was dropped, one stays, the first in
    the order ``first``.
    """
    hashed = F.xxhash64(*key)
    decided = materialize(decided.select(*key, "kept"), "decided")
    dropped = decided.where(~F.col("kept"))
    bits = bits_for(dropped.count())
    maps = bitmaps(dropped.select(position(hashed, bits).alias("pos")), "dropped")
    split = marked(rows, maps, bits, hashed)
    stay = marked(decided.where("kept"), maps, bits, hashed).where("__held").select(*[F.col(k).alias(f"__stay_{k}") for k in key]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__stay_{k}")) for k in key]
    chosen = split.where("__held").join(stay, same, "left_semi")
    if unique:
        chosen = chosen.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1) if first is None else first))).where("__rank = 1")
    return split.where(~F.col("__held")).select(*rows.columns).unionByName(chosen.select(*rows.columns))


def distinct_rows(rows: DataFrame, label: str) -> DataFrame:
    """The distinct rows of ``rows``; only rows that a filter of repeated hashes holds are shuffled, combined map-side first."""
    key = F.xxhash64(*rows.columns)
    hashes = materialize(rows.select(key.alias("h")).groupBy("h").agg(F.count("*").alias("n")), label)
    twice = hashes.where("n > 1")
    bits = bits_for(twice.count())
    maps = bitmaps(twice.select(position(F.col("h"), bits).alias("pos")), f"{label}-repeated")
    split = marked(rows, maps, bits, key)
    return split.where(~F.col("__held")).select(*rows.columns).unionByName(split.where("__held").select(*rows.columns).distinct())
