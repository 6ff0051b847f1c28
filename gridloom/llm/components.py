"""Connected components of a graph given by links, by alternating stars.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) until no link changes.  A step is one minimum per
node, combined map-side, joined back on (node, salt) so that a hub's links stay
dealt over tasks.  Each round is written to the shared folder, which cuts the
lineage; only the number of links that changed comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, per_key, salt


def large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = per_key(both.withColumn("piece", salt(F.col("b"))), ["a"], {"low": ("min", "b")}, "piece")
    return least.where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = per_key(down.withColumn("piece", salt(F.col("b"))), ["a"], {"low": ("min", "b")}, "piece")
    own = least.select("a", F.col("low").alias("b"))
    others = least.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return own.union(others).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): each linked node but a component's smallest, with that smallest node. links: pairs (a, b), in any order, repeated or not."""
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = materialize(small_star(large_star(now)), "stars")
        # equal counts and sums of hashes mean equal sets, but for odds of about 2**-64
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark:
            return now
        mark = new
