"""Orders of demonstrations and the keys of augmented task views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grids
from .text import BLANK, is_blank, strip

KEY = "struct<task_id:string,code:string,value_mapping:string,order_mapping:string>"


def order_indices(order: Column) -> Column:
    """Indices of an order, which is separated by commas, by white space or not at all; null unless they permute 0..n-1."""
    def of(bare: Column) -> Column:
        parts = F.when(F.contains(bare, F.lit(",")), F.transform(F.split(bare, ","), strip)).when(bare.rlike(BLANK), F.split(bare, f"{BLANK}+")).otherwise(F.split(bare, ""))
        return grids.let(parts, lambda p: F.when((bare != "") & F.forall(p, lambda x: x.rlike(r"\A[0-9]{1,9}\z")), F.transform(p, lambda x: x.try_cast("int"))))

    indices = grids.let(strip(order), of)
    other = grids.let(indices, lambda i: F.when(F.array_sort(i) == F.sequence(F.lit(0), F.size(i) - 1), i))
    return F.when(is_plain(order), F.transform(F.split(order, ""), lambda x: x.cast("int"))).otherwise(other)


def is_plain(order: Column) -> Column:
    """Whether an order is of single digits without separators, as keys mostly have them: as many characters, and all the digits below that number."""
    size = F.length(order)
    plain = size.between(1, len(grids.IDENTITY))
    for k, digit in enumerate(grids.IDENTITY):
        plain = plain & ((size <= k) | F.contains(order, F.lit(digit)))
    return F.coalesce(plain, F.lit(False))


def is_order(order: Column) -> Column:
    """Whether ``order_indices`` finds an order."""
    return is_plain(order) | order_indices(order).isNotNull()


def order_text(indices: Column) -> Column:
    """Without separators up to ten indices, else with commas."""
    words = F.transform(indices, lambda i: i.cast("string"))
    return F.when(F.size(indices) <= 10, F.array_join(words, "")).otherwise(F.array_join(words, ","))


def ordered(pairs: Column, order: Column) -> Column:
    """The pairs in the order; as they are for a null or blank order, null where lengths differ."""
    moved = lambda indices: F.when(F.size(indices) == F.size(pairs), F.transform(indices, lambda i: F.get(pairs, i)))
    plain = F.when(F.length(order) == F.size(pairs), F.transform(F.split(order, ""), lambda x: F.get(pairs, x.cast("int"))))
    return F.when(is_plain(order), plain).when(is_blank(order), pairs).otherwise(grids.let(order_indices(order), moved))


def augmented_pairs(pairs: Column, code: Column, mapping: Column, order: Column) -> Column:
    return grids.let(grids.digits(mapping), lambda to: F.transform(ordered(pairs, order), lambda p: grids.turned_pair(p, code, to)))


def parsed_key(key: Column) -> Column:
    """``task`` or ``task_CODE_mapping_order``; null for anything else. Codes are case-sensitive here."""

    def of(parts: Column) -> Column:
        at = lambda k: F.get(parts, F.lit(k))
        plain = F.struct(at(0).alias("task_id"), *[F.lit(None).cast("string").alias(c) for c in ("code", "value_mapping", "order_mapping")])
        full = F.struct(at(0).alias("task_id"), at(1).alias("code"), at(2).alias("value_mapping"), at(3).alias("order_mapping"))
        good = at(1).isin(*grids.CODES) & grids.let(at(2), grids.is_permutation) & grids.let(at(3), is_order) & (at(0) != "")
        return F.when((F.size(parts) == 1) & (at(0) != ""), plain).when((F.size(parts) == 4) & good, full)

    return grids.let(F.split(key, "_", -1), of)


def is_augmented(key: Column) -> Column:
    return F.coalesce(parsed_key(key)["code"].isNotNull(), F.lit(False))


def made_key(task: Column, code: Column, mapping: Column, order: Column) -> Column:
    """The key, or null if its parts don't make a valid one: parts are judged before they are joined, so the key isn't taken apart. The code is put in upper case."""
    name = F.when(code.isin(*grids.CODES), code).otherwise(F.upper(code))
    sound = ~F.contains(task, F.lit("_")) & (task != "") & name.isin(*grids.CODES) & grids.is_permutation(mapping) & is_order(order)
    return F.when(sound, F.concat_ws("_", task, name, mapping, order))
