"""Splits, runs, artifacts and orders against plain versions."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import queries, queries_runs
from gridloom.functions import chat, grids
from gridloom.functions.tokens import from_loader
from gridloom.operators import inference
from gridloom.plans import external, ranges, variants
from gridloom.sources import artifacts
from gridloom.sources.shared import new_folder

RANKED = queries_runs.ranked()


# --- external splits ---------------------------------------------------------------------


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["'", "'r", "e", "ll", " ", "\n", "\n\n", "012", "<|im_end|>", "a", "é", "!", "漢"]), min_size=1, max_size=6).map("".join), st.booleans()), max_size=8))
def test_growing_ids(parts):
    """Ids of a growing text are those of the whole, at every step, whatever is tried and left out."""
    growing, text = external.Growing(RANKED), ""
    for part, keep in parts:
        assert growing.offered(part) == len(RANKED.encode(text + part))
        if keep:
            growing.take()
            text += part
            assert growing.ids() == RANKED.encode(text)


def turned(grid, code):
    rows = [list(r) for r in grid]
    quarter = lambda g: [list(r) for r in zip(*g[::-1])]
    return {
        "ID": rows, "R90": quarter(rows), "R180": quarter(quarter(rows)), "R270": quarter(quarter(quarter(rows))),
        "FH": rows[::-1], "FV": [r[::-1] for r in rows], "FD1": [list(r) for r in zip(*rows)], "FD2": [list(r) for r in zip(*[r[::-1] for r in rows[::-1]])],
    }[code]


def rng_of(seed, *parts):
    return random.Random(int.from_bytes(hashlib.sha256(":".join([str(seed), *parts]).encode()).digest()[:16], "big"))


def split_brute(task, pairs, encode, n_variants, most_pairs, most_tokens, seed):
    """Each offer's whole conversation is encoded anew."""
    rng, cursor, out = rng_of(seed, "rearc-augmentation", task), 0, []
    for k in range(n_variants):
        text, ids, taken, skipped = "", None, [], 0
        while len(taken) < most_pairs:
            p = cursor % len(pairs)
            cursor += 1
            code, digits = rng.choice(grids.CODES), list("0123456789")
            rng.shuffle(digits)
            show = lambda g: "\n".join("".join(digits[c] for c in r) for r in turned(g, code))  # noqa: B023, E731
            more = text + f"{chat.USER}{show(pairs[p][0])}{chat.END}{chat.ASSISTANT}{show(pairs[p][1])}{chat.END}"
            found = encode(more)
            if len(found) > most_tokens:
                if taken:
                    break
                skipped += 1
                assert skipped < len(pairs)
                continue
            text, ids = more, found
            taken.append(f"{p}:{code}:{''.join(digits)}")
        out.append((f"rearc:{task}:{k:03d}", ids, ",".join(taken), skipped))
    rng_of(seed, "rearc-variant-order", task).shuffle(out)
    return out


def test_external_split_table(spark, sf):
    """All tasks, ids by digest, against encoding everything again; spans decode to the answers."""
    got = {(r["task_id"], r["place"]): r for r in queries.QUERIES["external_split"](spark, sf).collect()}
    given_ = queries.tasks(spark, sf).select("task_id", F.concat("train", "test").alias("pairs")).collect()
    assert len(got) == 4 * len(given_)
    lengths = set()
    for t in given_:
        pairs = [(p["input"], p["output"]) for p in t["pairs"]]
        for place, (name, ids, taken, skipped) in enumerate(split_brute(t["task_id"], pairs, RANKED.encode, 4, 6, 260, queries.SEED)):
            r = got[t["task_id"], place]
            assert (r["variant_id"], r["pairs"], r["skipped"], r["status"], r["sequence_length"]) == (name, taken, skipped, "ok", len(ids))
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            lengths.add(r["n_pairs"])
            whole = RANKED.known.decode(ids)
            said = [RANKED.known.decode(ids[a:b]) for a, b in (map(int, s.split("-")) for s in r["spans"].split(","))]
            assert said == [x.split(chat.END)[0] for x in whole.split(chat.ASSISTANT)[1:]]
    assert 1 < max(lengths) < 6  # the tokens set the limit, not the pairs


def test_external_split_odd_tasks(spark):
    """Pairs that are too long are passed over; a task in which none fits, one without pairs, and one with a ragged grid say so."""
    small, large = {"input": [[1, 2]], "output": [[3]]}, {"input": [[k % 10 for k in range(30)] for _ in range(30)], "output": [[1]]}
    data = [("a", [small, large, small]), ("b", [large, large]), ("c", []), ("d", None), ("e", [{"input": [[1], [1, 2]], "output": [[1]]}]), ("f", [large, small])]
    df = spark.createDataFrame(data, "task_id string, pairs array<struct<input:array<array<int>>,output:array<array<int>>>>")
    found = external.external_split(df, queries_runs.ranked, 3, 2, 120, 5, from_loader(queries_runs.ranked))
    by = {}
    for r in sorted(found.collect(), key=lambda r: (r["task_id"], r["place"])):
        by.setdefault(r["task_id"], []).append(r)
    assert [r["status"] for r in by["b"]] == ["no_pair_fits"] and by["b"][0]["input_ids"] is None and by["b"][0]["skipped"] == 2
    assert [[r["status"] for r in by[k]] for k in "cde"] == [["bad_grid"]] * 3
    for k in "af":
        pairs = [(p["input"], p["output"]) for p in dict(data)[k]]
        want = split_brute(k, pairs, RANKED.encode, 3, 2, 120, 5)
        assert [(r["variant_id"], r["input_ids"], r["skipped"]) for r in by[k]] == [(n, i, s) for n, i, _, s in want]
    problems = {(r["task_id"], r["problem"]) for r in external.split_problems(found, df, 2).collect()}
    assert problems >= {("b", "no_pair_fits"), ("c", "bad_grid"), ("a", "other_pair_count")} and ("f", "other_pair_count") not in problems
    stats = external.split_statistics(found).first()
    assert stats["source_pairs"] == 3 + 2 + 1 + 2 and stats["skipped_oversized_pairs"] == sum(r["skipped"] for rs in by.values() for r in rs)


# --- inference --------------------------------------------------------------------------


def requests(spark, n=900, adapters=4, hot=0.7):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        adapter = "a0" if rng.random() < hot else f"a{rng.randrange(1, adapters)}"
        rows.append((f"q{k:05d}", adapter, f"prompt {k} " + "x" * rng.randrange(50), 1 + k % 2, (float(k % 2 + 1), 1.0, 10 + k % 3, None if k % 4 == 0 else k % 2)))
    form = "request_id string, adapter string, prompt string, samples int, sampling struct<temperature:double,top_p:double,max_tokens:int,seed:long>"
    return rows, spark.createDataFrame(rows, form)


def test_in_order(spark):
    rows, df = requests(spark)
    seen = spark.sparkContext.accumulator(0)

    def load(adapter):
        inner = queries_runs.digesting(adapter)

        def generate(prompts, sampling):
            seen.add(1)
            assert len(prompts) <= 16
            return inner(prompts, sampling)

        return generate

    found = inference.in_order(df, load, batch=16, window=100).collect()
    assert [r["request_id"] for r in found] == [r[0] for r in rows]
    for r, (_, _, prompt, _, (temperature, _, tokens, seed)) in zip(found, rows):
        said = f"|{round(10 * temperature)}|{tokens}|{'' if seed is None else seed}|0|{prompt}"
        assert r["outputs"][0]["text"] == hashlib.sha256(said.encode()).hexdigest()
    assert seen.value < 300  # far fewer calls than requests


def test_completions():
    assert inference.completion(1, "é", inference.byte_count) == {"sample_index": 1, "text": "é", "generated_token_count": 2, "finish_reason": None}
    assert inference.completion(0, {"text": "abc", "token_ids": [1, 2], "finish_reason": "stop"}, len)["generated_token_count"] == 2
    assert inference.completion(0, {"text": "abc", "token_ids": [], "token_count": None}, len)["generated_token_count"] == 3
    with pytest.raises(RuntimeError):
        inference.asked(lambda p, s: [], ["x"], {}, len)


def test_slots_cut_hot_adapters(spark):
    rows, df = requests(spark)
    got = {r["request_id"]: r["slot"] for r in inference.slots(df, F.length("prompt"), 2000).collect()}
    total, want = 0, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        want[r[0]] = total // 2000
        total += len(r[2])
    assert got == want and len({want[r[0]] for r in rows if r[1] == "a0"}) > 5


def test_adapter_run_is_taken_up(spark):
    """A run that breaks off keeps its parts; the next call runs the rest only, and the manifest counts the loads of both."""
    rows, df = requests(spark)
    path = new_folder(spark, "run")

    def broken(adapter):
        if adapter == "a3":
            raise OSError("adapter is missing")
        return queries_runs.digesting(adapter)

    with pytest.raises(Exception, match="adapter is missing"):
        inference.adapter_run(df, broken, path, {"protocol": "p"}, most=3000, waves=4)
    kept = inference.read_run(spark, path).count()
    assert 0 < kept < len(rows)
    before = set(inference.parts(spark, path))
    manifest = inference.adapter_run(df, queries_runs.digesting, path, {"protocol": "p"}, most=3000, waves=4)
    assert before < set(inference.parts(spark, path))
    found = {r["request_id"]: r for r in inference.read_run(spark, path).collect()}
    assert len(found) == manifest["request_count"] == len(rows)
    for name, adapter, prompt, samples, (temperature, _, tokens, seed) in rows:
        said = f"{adapter}|{round(10 * temperature)}|{tokens}|{'' if seed is None else seed}"
        assert [o["text"] for o in found[name]["outputs"]] == [hashlib.sha256(f"{said}|{k}|{prompt}".encode()).hexdigest() for k in range(samples)]
        assert found[name]["prompt_sha256"] == hashlib.sha256(prompt.encode()).hexdigest() and found[name]["adapter_used"] and found[name]["protocol"] == "p"
    assert manifest["candidate_count"] == sum(r[3] for r in rows) and manifest["adapter_count"] == 4 and manifest["load_count"] < 60
    with pytest.raises(FileExistsError):
        inference.adapter_run(df, queries_runs.digesting, path, {})


def test_wrong_number_of_samples(spark):
    _, df = requests(spark, 20)
    path = new_folder(spark, "run")
    with pytest.raises(ValueError, match="another number of samples"):
        inference.adapter_run(df, lambda a: lambda ps, s: [["one"] for _ in ps], path, {}, waves=1)
    assert inference.wrong_counts(inference.read_run(spark, path)).count() == 10


# --- places, artifacts, lines --------------------------------------------------------------


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    assert [(r["a"], r["b"]) for r in sorted(ranges.numbered(df, "a", "b").collect(), key=lambda r: r["ordinal"])] == sorted(rows)
    assert sorted(r["ordinal"] for r in ranges.numbered(df).collect()) == list(range(3000))
    assert ranges.numbered(df.limit(0), "a").count() == 0
    got, total = {(r["a"], r["b"]): r["before"] for r in ranges.summed(df, ["a", "b"], F.col("a") + 1).collect()}, 0
    for a, b in sorted(rows):
        assert got[a, b] == total
        total += a + 1


def tree(lines, rows, fan):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [sha("\n".join(map(sha, lines[k : k + rows]))) for k in range(0, len(lines), rows)]
    while len(level) > 1:
        level = [sha("\n".join(level[k : k + fan])) for k in range(0, len(level), fan)]
    return level[0] if level else None


@pytest.mark.parametrize("n", [0, 1, 10, 11, 1234])
def test_artifact(spark, n):
    """The digest is a tree's over the lines in order; parts that change are noticed, other artifacts refused."""
    path = new_folder(spark, "artifact")
    df = spark.createDataFrame([(k, f"é{k}\n\"x" if k % 3 else None) for k in range(n)], "k int, t string").repartition(5)
    manifest = artifacts.write_artifact(df, path, {"kind": "things"}, "k", rows=10, fan=4)
    lines = [json.dumps({"k": k, "t": f"é{k}\n\"x"} if k % 3 else {"k": k}, ensure_ascii=False, separators=(",", ":")) for k in range(n)]
    assert manifest["record_count"] == n and manifest["output_sha256"] == tree(lines, 10, 4)
    assert artifacts.verified(spark, path, kind="things") == manifest
    back = sorted(artifacts.read_artifact(spark, path, "k int, t string", kind="things").collect(), key=lambda r: r["ordinal"])
    assert [(r["k"], r["ordinal"]) for r in back] == [(k, k) for k in range(n)] and all(r["t"] == (f"é{r['k']}\n\"x" if r["k"] % 3 else None) for r in back)
    with pytest.raises(FileExistsError):
        artifacts.write_artifact(df, path, {})
    with pytest.raises(ValueError, match="another artifact"):
        artifacts.read_artifact(spark, path, "k int", kind="others")
    with pytest.raises(FileNotFoundError, match="never finished"):
        artifacts.manifest_of(spark, new_folder(spark, "none"))
    if n > 20:
        import pathlib

        one = next(p for p in sorted(pathlib.Path(path.removeprefix("file:")).glob("rows/part=3/part-*")))
        one.write_text(one.read_text().replace('"k":31', '"k":32'))
        (one.parent / f".{one.name}.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError, match="isn't what"):
            artifacts.verified(spark, path, kind="things")


def test_lines_of_split_files(spark, tmp_path):
    """Numbers of lines in files that are read in many pieces; blank and broken lines count."""
    rng, want, bad = random.Random(5), {}, set()
    for f in range(3):
        lines = [("" if rng.random() < 0.1 else json.dumps({"v": "x" * rng.randrange(200), "k": k})) for k in range(2000)]
        for k in rng.sample(range(2000), 15):
            lines[k] = ["{broken", "[1]", "7", '{"a":}'][k % 4]
            bad.add((f, k + 1))
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(lines) + "\n" * (f % 2))
        want |= {(f, k + 1): line for k, line in enumerate(lines) if line or k < len(lines) - 1 or f % 2}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = artifacts.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 8
        number = lambda r: int(r["file"][-7])
        assert {(number(r), r["line"]): r["value"] for r in rows.collect()} == want
        assert {(number(r), r["line"]) for r in artifacts.malformed_places(spark, str(tmp_path)).collect()} == bad
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_digest(spark, tmp_path):
    for k in (3, 1, 2):
        (tmp_path / f"t{k}.json").write_text(json.dumps(k))
    own = [hashlib.sha256(f"t{k}.json".encode() + b"\0" + str(k).encode() + b"\0").hexdigest() for k in (1, 2, 3)]
    assert artifacts.files_digest(spark, str(tmp_path)) == hashlib.sha256("\n".join(own).encode()).hexdigest()


@pytest.mark.parametrize("seed", [0, 20, 12345])
def test_seeded_order(spark, seed):
    names = [f"t{k}é" for k in range(700)]
    got = variants.seeded_order(spark.createDataFrame([(n,) for n in names * 2], "task_id string"), seed, batch=64).collect()
    want = sorted(names)
    random.Random(seed).shuffle(want)
    assert [r["task_id"] for r in sorted(got, key=lambda r: r["place"])] == want


def test_golden_order(spark):
    """The order of ten names for one seed, as any interpreter draws it."""
    got = variants.seeded_order(spark.createDataFrame([(c,) for c in "abcdefghij"], "task_id string"), 42)
    assert "".join(r["task_id"] for r in sorted(got.collect(), key=lambda r: r["place"])) == "hdcifgjeab"
