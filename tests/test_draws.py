"""Drawn values, not their counts: every seeded stream against loops over Python's generator, for two seeds."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.grids import CODES
from gridloom.operators.requests import STYLES
from gridloom.plans import variants

SEEDS = [20, 987654321]


def rng(seed, *parts, size=16):
    return random.Random(int.from_bytes(hashlib.sha256(":".join([str(seed), *parts]).encode()).digest()[:size], "big"))


def mapping(r):
    digits = list("0123456789")
    r.shuffle(digits)
    return "".join(digits)


def order(r, n):
    own = list(range(n))
    r.shuffle(own)
    return "".join(map(str, own)) if n <= 10 else ",".join(map(str, own))


@pytest.mark.parametrize("seed", SEEDS)
def test_plan(spark, seed):
    sizes = {"a1": 2, "b2": 3, "c3": 11}
    got = {(r["task_id"], r["variant_index"]): (r["code"], r["value_mapping"], r["order_mapping"]) for r in variants.augmentation_plan(spark.createDataFrame(list(sizes.items()), "task_id string, n_pairs int"), seed).collect()}
    want = {}
    for task, n in sizes.items():
        k = 0
        for code in CODES:
            r, seen = rng(seed, "ttt-plan", task, code), []
            while len(seen) < 8:
                m = mapping(r)
                o = order(r, n)
                if (m, o) not in seen:
                    seen.append((m, o))
                    want[task, k] = (code, m, o)
                    k += 1
    assert got == want


@pytest.mark.parametrize("seed", SEEDS)
def test_rewrites(spark, seed):
    sources = [("s1", "t1", 3, 2, [], -1), ("s2", "t1", 2, 9, [("ID", "0123456789", "01")], 4), ("s3", "t2", 12, 0, [], 0)]
    form = "source_id string, task_id string, n_pairs int, accepted long, used array<struct<code:string,value_mapping:string,order_mapping:string>>, last_index int"
    got = {(r["source_id"], r["variant_index"]): (r["code"], r["value_mapping"], r["order_mapping"], r["style"]) for r in variants.rewrite_plan(spark.createDataFrame(sources, form), 10, seed).collect()}
    want = {}
    for source, task, n, accepted, used, last in sources:
        r, seen = rng(seed, task, source, size=8), {tuple(u) for u in used}
        k = last + 1
        while k < last + 1 + 10 - accepted:
            code = r.choice(CODES)
            m = mapping(r)
            o = order(r, n)
            style = r.choice(tuple(STYLES))
            if (code, m, o) not in seen:
                seen.add((code, m, o))
                want[source, k] = (code, m, o, style)
                k += 1
    assert got == want and len(got) == 8 + 1 + 10


@pytest.mark.parametrize("seed", SEEDS)
def test_few_shots(spark, seed):
    pool, tasks = [f"p{k}" for k in range(9)], ["p3", "x1", "x2"]
    got = {(r["task_id"], r["candidate"]): r["few_shot_ids"] for r in variants.few_shots(spark.createDataFrame([(t, k) for t in tasks for k in range(3)], "task_id string, candidate int"), pool, 4, seed).collect()}
    for t in tasks:
        start = (seed + int(hashlib.sha256(t.encode()).hexdigest()[:8], 16)) % 2**32
        for k in range(3):
            assert got[t, k] == random.Random(start + k).sample([p for p in pool if p != t], 4)


@pytest.mark.parametrize("seed", SEEDS)
def test_pair_orders(spark, seed):
    rows = [("v1", 2), ("v2", 5), ("v3", 30)]
    got = {r["variant_id"]: r["places"] for r in variants.shuffled_places(spark.createDataFrame(rows, "variant_id string, n_pairs int"), seed).collect()}
    for v, n in rows:
        want = list(range(n))
        rng(seed, "pair-order", v).shuffle(want)
        assert got[v] == want


@pytest.mark.parametrize("seed", SEEDS)
def test_packing(spark, seed):
    lengths = {"t1": [30, 80, 45], "t2": [10] * 7, "t3": [200, 15]}
    got = {}
    for r in variants.packing(spark.createDataFrame(list(lengths.items()), "task_id string, lengths array<int>"), 5, 4, 150, 5, seed).orderBy("task_id", "place").collect():
        got.setdefault(r["task_id"], []).append((r["variant_id"], r["pair_indices"], r["codes"], r["value_mappings"], r["length"]))
    for task, sizes in lengths.items():
        r, at, want = rng(seed, "rearc-augmentation", task), 0, []
        for k in range(5):
            taken = []
            while len(taken) < 4:
                pair, code = at % len(sizes), r.choice(CODES)
                m = mapping(r)
                at += 1
                if 5 + sum(sizes[p] for p, _, _ in taken) + sizes[pair] <= 150:
                    taken.append((pair, code, m))
                elif taken:
                    break
            want.append((f"rearc:{task}:{k:03d}", [p for p, _, _ in taken], [c for _, c, _ in taken], [m for _, _, m in taken], 5 + sum(sizes[p] for p, _, _ in taken)))
        rng(seed, "rearc-variant-order", task).shuffle(want)
        assert got[task] == want


def test_seeds_by_value():
    """Two seeds, as SHA-256 gives them."""
    assert variants.seeded(7, "a", "b") == int(hashlib.sha256(b"7:a:b").hexdigest()[:32], 16)
    assert variants.seeded(7, "a", "b", size=8) == int(hashlib.sha256(b"7:a:b").hexdigest()[:16], 16)


def test_plan_draws_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"t{k}", 2 + k % 4) for k in range(40)], "task_id string, n_pairs int")
    one, many = (sorted(map(tuple, variants.augmentation_plan(x, 3).collect())) for x in (df.coalesce(1), df.repartition(9, F.col("n_pairs"))))
    assert one == many and len(one) == 40 * 64
