"""Exact dedup by a log-structured merge index over text digests (native).

Every scan task is a memtable: it flushes one run, sorted by digest, of
``(digest, n_chars, doc_id, seq, salt)`` to the shared folder, with no shuffle.
Compaction merges the runs: each is combined by digest before it is shuffled,
and what is kept of a digest is its smallest identifier, where identifiers are
ordered by (code points descending, doc_id, flush order).  Digests of more than
one row are the compacted level: written in ranges of digests, sorted, with a
filter of their positions.  A text whose digest the filter doesn't hold is a
singleton and never moves.  Hits receive byte verification: their texts are grouped by
(digest, text), and a digest with two different texts is settled by the texts
themselves.

Hot groups: rows of one digest carry 64 salts; compaction collapses a group
map-side and emits the index entry once per salt that occurs, so the join back
deals the group over 64 pieces.

Defined results: null text is the empty text; null doc_ids sort after others
and may stay only if the group has no other; repeated rows are rows of their
own, one of which stays; very long texts are taken whole; an empty table gives an
empty result; other columns are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import filters
from .common import SPACE, materialize, salt, whole_text


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush_runs(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Each task's rows as a sorted run in the shared folder."""
    rows = docs.select("doc_id", F.length(whole_text()).alias("n_chars"), digest(normalised(whole_text())).alias("digest"))
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    return materialize(rows.withColumn("salt", salt(F.col("seq"))).sortWithinPartitions("digest"), "runs")


def passing(rows: DataFrame, level: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose digest the filter of a level holds."""
    return filters.marked(rows, *level, F.xxhash64("digest")).where("__held").select(*rows.columns)


def identifier() -> Column:
    """Smallest for the row that stays."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "seq")


def compact(runs: DataFrame) -> DataFrame:
    """One entry per digest of more than one row: its size, smallest identifier and the salts in use; in sorted ranges."""
    merged = runs.groupBy("digest").agg(F.count("*").alias("n"), F.min(identifier()).alias("best"), F.collect_set("salt").alias("salts"))
    return materialize(merged.where("n > 1").repartitionByRange("digest").sortWithinPartitions("digest"), "compacted")


def level_filter(index: DataFrame) -> tuple[DataFrame, int]:
    """Bitmaps by bucket of the positions of a level's digests, and the filter's size in bits."""
    bits = filters.bits_for(index.count())
    return filters.bitmaps(index.select(filters.position(F.xxhash64("digest"), bits).alias("pos")), "filter"), bits


def collided(docs: DataFrame, level: tuple[DataFrame, int], digest: Callable[[Column], Column]) -> DataFrame:
    """Byte verification: digests that stand for more than one text."""
    rows = docs.select(normalised(whole_text()).alias("norm")).withColumn("digest", digest(F.col("norm")))
    texts = passing(rows, level).groupBy("digest", "norm").agg(F.count("*").alias("n"))
    return texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    runs = flush_runs(docs, digest)
    index = compact(runs)
    false = materialize(collided(docs, level_filter(index), digest), "collided")
    entries = index.select("digest", "n", "best", F.explode("salts").alias("salt"))
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.lit(None).cast("string")
    found = runs.join(entries, ["digest", "salt"], "left")
    out = lambda keep, size, kept, sha: ["doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), sha.alias("text_sha256")]
    one = F.col("n").isNull()
    columns = out(F.when(one, F.col("doc_id")).otherwise(F.col("best.doc_id")), F.coalesce("n", F.lit(1).cast("long")), one | (F.col("seq") == F.col("best.seq")), sha)
    if false.isEmpty():
        return found.select(*columns)
    return found.join(false, "digest", "left_anti").select(*columns).unionByName(by_text(docs, false, digest, out))


def by_text(docs: DataFrame, false: DataFrame, digest: Callable[[Column], Column], out: Callable) -> DataFrame:
    """The groups of colliding digests, by the texts themselves. No SHA-256 collision is known, so this stays empty but for weak digests."""
    rows = docs.select("doc_id", F.length(whole_text()).alias("n_chars"), normalised(whole_text()).alias("norm")).withColumn("digest", digest(F.col("norm")))
    rows = rows.withColumn("seq", F.lit(0)).join(false, "digest", "left_semi")
    groups = rows.groupBy("norm").agg(F.count("*").alias("n"), F.min(identifier()).alias("best"))
    ranked = rows.join(groups, "norm").withColumn("rank", F.row_number().over(Window.partitionBy("norm").orderBy(identifier())))
    return ranked.select(*out(F.col("best.doc_id"), F.col("n"), F.col("rank") == 1, F.sha2("norm", 256)))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows are matched on (doc_id, digest); of rows that repeat both, the longest stays.
    """
    decided = exact_dedup(docs).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("__id"), F.sha2(normalised(whole_text()), 256).alias("__sha"))
    return filters.keep_decided(rows, decided, ["__id", "__sha"], True, F.length("row.text").desc_nulls_last()).select("row.*")
