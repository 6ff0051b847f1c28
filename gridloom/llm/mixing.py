"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (native).

1.  Every document gets a key, a hash of the seed, its id and text; rows that
    repeat both are told apart by a number written with them.
2.  Targets: sources share the total by weight; a source stops at ``most``
    times its size, the excess goes to the others by weight.  With sources in
    order of cap / weight this water level has a closed form, so there is no
    loop.
3.  Blocks: a source of n words has n / ``block_words`` blocks, and a
    document's key says in which one it lies, so blocks are random parts of
    about equal words and their number grows with the source.  A source's quota is
    all its blocks for each full pass over it, and of the last pass the blocks
    (they are in random order) up to the target; the block in which the target
    lies is taken up to the nearest document border.
4.  The tree deals the quotas' blocks to shards: a node halves its shards and
    draws at random, without replacement, which half of its blocks goes left, so
    the counts by source are multivariate hypergeometric, at every node exactly
    half.  All draws are order statistics of one uniform number a block: the
    left half is that of the lower ranks, so a block's rank among all blocks
    spells its path.  The ``shards`` leaves grow with the mix, a leaf for each
    ``SHARD_BLOCKS`` blocks, 16 at least.
5.  A document is taken as often as its block is drawn, into these draws'
    shards, and gets a random order in each for the local shuffle.

Nothing is ordered in one task: running sums over sources and over blocks are
taken by range partitions (``running``), those inside a source over groups of
4096 blocks, then inside one group, then inside one block.  Rows meet a source
table of checked size where they are, a larger one by (source, piece), and their
block by (source, block).  Texts are not
moved by any of this; ``mixed`` writes them once, with their keys.

Defined results: a null text has size 0; the null source comes last, as a
source of its own; documents without a word, and everything if all sizes are
0, are not taken; repeated ids and rows are drawn each for itself; reruns
agree (of rows that repeat id and text any may be the one that is taken); very
long documents are taken whole; an empty table gives an empty result; extra
columns are kept by ``mixed`` and not looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, materialize, met, salt, whole_text

BLOCK_WORDS, SHARD_BLOCKS, LEAST_SHARDS, MOST, WEIGHTS, SEED = 4096, 4096, 16, 3, (1, 2, 3), 17
#: Most sources, and characters of their names, that are broadcast.
BROADCAST, BROADCAST_CHARS = 100_000, 16 << 20
#: Keys are non-negative 52-bit integers: exact as doubles.
KEY_BITS = 52
#: Blocks whose words are summed in one step of the search for a border.
GROUP_BITS = 12
BY = ["__src", "__none"]


def running(rows: DataFrame, order: list, sums: dict[str, Column], label: str) -> DataFrame:
    """``rows`` with, for each new column, the sum over all rows before this one in the order, by range partitions; only one row a partition is put in order as a whole."""
    dealt = rows.withColumns({f"__own_{n}": c for n, c in sums.items()}).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, label)
    whole = dealt.groupBy("__part").agg(*[F.sum(f"__own_{n}").alias(f"__all_{n}") for n in sums])
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("__part", *[F.coalesce(F.sum(f"__all_{n}").over(upto), F.lit(0)).alias(f"__before_{n}") for n in sums])
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(F.broadcast(before), "__part")  # a row for each partition
    found = found.withColumns({n: F.col(f"__before_{n}") + F.coalesce(F.sum(f"__own_{n}").over(own), F.lit(0)) for n in sums})
    return found.select(*rows.columns, *sums)


def keyed(docs: DataFrame, seed: int, columns: list[str]) -> DataFrame:
    """Written rows with source, size, a number of their own (seq), piece and key, and ``columns`` as a struct ``row``."""
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    kept = F.struct(*[F.col(c) for c in columns]).alias("row")
    rows = docs.select(F.coalesce("source", F.lit("")).alias("__src"), F.col("source").isNull().alias("__none"), size.alias("__size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("__hash"), F.monotonically_increasing_id().alias("__seq"), kept)
    rows = materialize(rows.withColumn("__piece", salt(F.col("__seq"))), "mix-rows")
    repeated = rows.groupBy("__hash").agg(F.count("*").alias("__n")).where("__n > 1").select("__hash", F.lit(True).alias("__again"))
    told = met(rows.select("__hash", "__piece", "__seq"), repeated, ["__hash"], "__piece").select("__seq", "__again")
    hashed = F.when(F.col("__again"), F.xxhash64("__hash", "__seq")).otherwise(F.col("__hash"))
    told = materialize(told, "mix-repeated")
    if told.isEmpty():
        return rows.withColumn("__key", F.shiftrightunsigned("__hash", 64 - KEY_BITS)).drop("__hash")
    return rows.join(told, "__seq", "left").withColumn("__key", F.shiftrightunsigned(hashed, 64 - KEY_BITS)).drop("__hash", "__again")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds weight and target to a table of (__src, __none, size), one row per source."""
    rows = running(sources, ["__none", "__src"], {"__rank": F.lit(1)}, "mix-ranked")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("__cap", most * F.col("size").cast("double")).withColumn("__full", F.col("__cap") / F.col("weight"))
    rows = materialize(running(rows, ["__full", *reversed(BY)], {"__below": F.col("__cap"), "__lighter": F.col("weight")}, "mix-levels"), "mix-water")
    every = rows.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    # Levels rise up to the first source that isn't filled and fall after it.
    level = (F.lit(float(every["size"] or 0)) - F.col("__below")) / (F.lit(float(every["weight"] or 0)) - F.col("__lighter"))
    highest = max(0.0, rows.agg(F.max(level)).first()[0] or 0.0)
    return rows.select(*BY, "size", "weight", F.least("__cap", F.col("weight") * highest).alias("target"))


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns: a source table of checked size is broadcast, so rows stay where they are; a larger one is met by piece."""
    n, chars = sources.agg(F.count("*"), F.sum(F.length("__src"))).first()
    if n <= BROADCAST and (chars or 0) <= BROADCAST_CHARS:
        return rows.join(F.broadcast(sources), BY)
    return met(rows, sources, BY, "__piece")


def block_of(words: int) -> Column:
    """A row's block; its source's number of blocks is that of its words."""
    blocks = F.ceil(F.col("size") / words)
    return F.least(F.floor(F.col("__key") / F.lit(float(1 << KEY_BITS)) * blocks), blocks - 1).cast("long")


def with_offsets(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds start, the words before a row within its group."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0)))


def borders(rows: DataFrame, blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source with a last, partial pass: the block in which its target lies, and the largest (key, seq) that is taken of it."""
    left = sources.select(*BY, (F.col("target") - F.col("passes") * F.col("size")).alias("left")).where("left > 0")
    lies = (F.col("start") < F.col("left")) & (F.col("left") <= F.col("start") + F.col("words"))
    groups = blocks.groupBy(*BY, F.shiftright("block", GROUP_BITS).alias("group")).agg(F.sum("words").alias("words"))
    group = with_offsets(groups, BY, "group").join(left, BY).where(lies).select(*BY, "group", (F.col("left") - F.col("start")).alias("left"))
    inside = blocks.withColumn("group", F.shiftright("block", GROUP_BITS)).join(group, [*BY, "group"])
    border = with_offsets(inside, BY, "block").where(lies).select(*BY, "block", (F.col("left") - F.col("start")).alias("left"))
    border = materialize(border, "mix-borders")
    within = Window.partitionBy(*BY, "block").orderBy("__key", "__seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.where("__size > 0").join(border, [*BY, "block"]).withColumn("end", F.sum("__size").over(within))
    # a document is in if its middle lies before the border: the nearest document border
    last = ends.where(F.col("end") - F.col("__size") / 2 <= F.col("left")).groupBy(*BY).agg(F.max(F.struct("__key", "__seq")).alias("cut"))
    return border.join(last, BY, "left").select(*BY, F.col("block").alias("border"), "cut")


def splitting_tree(slots: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """Slots (__src, __none, block, pass) with the shard of each.

    shards: a power of two.  A slot's uniform number says where it stands among
    all slots; the tree's node of its first d splits holds the ranks with the
    same first d bits, in shards, so every split is into exact halves.
    """
    drawn = slots.withColumn("__u", F.xxhash64(F.lit(seed), *BY, "block", "pass"))
    ranked = materialize(running(drawn, ["__u", *BY, "block", "pass"], {"__rank": F.lit(1)}, "mix-drawn"), "mix-tree")
    n = ranked.count()
    if shards is None:
        shards = max(LEAST_SHARDS, 1 << math.ceil(math.log2(max(1, n / SHARD_BLOCKS))))
    return ranked.select(*slots.columns, F.floor(F.col("__rank") * shards / max(1, n)).cast("int").alias("shard"))


def plan(docs: DataFrame, columns: list[str], seed: int = SEED, words: int = BLOCK_WORDS, shards: int | None = None, most: int = MOST, weights: tuple = WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyed rows, the source table (size, target, passes, border and cut), and the drawn blocks with their shards by pass."""
    rows = keyed(docs, seed, columns)
    sources = targets(rows.groupBy(*BY).agg(F.sum("__size").alias("size")), weights, most)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int")
    sources = materialize(sources.withColumn("passes", F.least(whole, F.lit(most))), "mix-targets")
    bare = with_source(rows.drop("row"), sources.select(*BY, "size")).withColumn("block", block_of(words))
    bare = materialize(bare.where("__size > 0").select(*BY, "block", "__key", "__seq", "__size"), "mix-keys")
    blocks = materialize(bare.groupBy(*BY, "block").agg(F.sum("__size").alias("words")), "mix-blocks")
    sources = materialize(sources.join(borders(bare, blocks, sources), BY, "left"), "mix-sources")
    times = F.col("passes") + F.when(F.coalesce(F.col("block") < F.col("border"), F.lit(False)) | F.coalesce((F.col("block") == F.col("border")) & F.col("cut").isNotNull(), F.lit(False)), 1).otherwise(0)
    slots = with_source(blocks.withColumn("__piece", salt(F.col("block"))), sources.select(*BY, "passes", "border", "cut")).withColumn("times", times).where("times > 0")
    slots = slots.select(*BY, "block", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass"))
    tree = splitting_tree(slots, shards, seed)
    drawn = tree.groupBy(*BY, "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda s: s["shard"]).alias("shards"))
    return rows, sources, materialize(drawn, "mix-shards")


def placed(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """The rows with their source's size and target and ``copies``: (copy, shard, order) of each copy taken."""
    rows, sources, drawn = plan(docs, columns, **options)
    found = with_source(rows, sources).withColumn("block", F.when(F.col("__size") > 0, block_of(options.get("words", BLOCK_WORDS))))
    found = found.join(drawn, [*BY, "block"], "left")
    here = F.struct("__key", "__seq") <= F.col("cut")
    last = F.coalesce((F.col("block") < F.col("border")) | ((F.col("block") == F.col("border")) & here), F.lit(False))
    times = F.when(F.col("__size") == 0, 0).otherwise(F.col("passes") + F.when(last, 1).otherwise(0))
    order = lambda p: F.xxhash64(F.lit(options.get("seed", SEED) + 1), p, "__key")
    copies = F.transform(F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), times), lambda s, p: F.struct(p.alias("copy"), s.alias("shard"), order(p).alias("order")))
    return found.withColumn("copies", copies)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies."""
    found = placed(docs, ["doc_id"], **options)
    taken = F.size("copies") * F.col("__size")
    return found.select("row.doc_id", F.col("__size").alias("size"), F.col("size").alias("source_size"), "target", taken.cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, once per copy, with all their columns and ``__shard`` and ``__order``: write by shard, sorted by order, for shuffled shards."""
    found = placed(docs, docs.columns, **options).withColumn("__copy", F.explode("copies"))
    return found.select("row.*", F.col("__copy.shard").alias("__shard"), F.col("__copy.order").alias("__order"))
