"""Record rules and cache contracts, fault by fault."""

import json

import pytest

from gridloom.operators import token_records
from gridloom.sources import files, invariants, records

SOUND = {
    "request_id": "r", "task_id": "t", "stage": "rewrite", "messages": [{"role": "user", "content": "x"}], "prompt_version": "1", "hint_mode": "none", "few_shot_task_ids": ["a"],
    "sampling": {"temperature": 0, "top_p": 1.0, "max_tokens": 5, "seed": 3}, "metadata": {"any": [1, {"x": None}]},
    "augmentation": {"source_trace_id": "s", "transformation_code": "R90", "value_mapping": "0123456789", "order_mapping": "01", "style": "plain", "variant_index": 0},
}


def changed(**fields):
    out = json.loads(json.dumps(SOUND))
    for path, v in fields.items():
        *above, last = path.split("__")
        at = out
        for name in above:
            at = at[int(name) if name.isdigit() else name]
        if v is Ellipsis:
            del at[last]
        else:
            at[last] = v
    return out


CASES = [
    (SOUND, []), (changed(request_id=" "), ["blank:request_id"]), (changed(task_id=...), ["missing:task_id"]), (changed(stage="x"), ["unknown_value:stage"]), (changed(stage=3), ["kind:stage"]),
    (changed(messages=[]), ["empty:messages"]), (changed(messages="no"), ["kind:messages"]), (changed(messages__0__role="robot", messages__0__content=""), ["blank:messages[].content", "unknown_value:messages[].role"]),
    (changed(messages=["x", {"role": "user"}]), ["kind:messages[]", "missing:messages[].content"]), (changed(messages__0__name="n"), ["unknown:messages[].name"]),
    (changed(sampling__top_p=0), ["out_of_range:sampling.top_p"]), (changed(sampling__temperature=-0.5, sampling__max_tokens=0), ["negative:sampling.temperature", "not_positive:sampling.max_tokens"]),
    (changed(sampling__seed="3"), ["kind:sampling.seed"]), (changed(sampling__seed=None), []), (changed(sampling__max_tokens=1.5), ["kind:sampling.max_tokens"]), (changed(sampling=7), ["kind:sampling"]),
    (changed(augmentation=...), ["missing:augmentation"]), (changed(augmentation=None, stage="judge"), []), (changed(augmentation__transformation_code="R45"), ["unknown_value:augmentation.transformation_code"]),
    (changed(augmentation__variant_index=-1, extra=1), ["negative:augmentation.variant_index", "unknown:extra"]), (changed(few_shot_task_ids=["a", 1, 2]), ["kind:few_shot_task_ids[]"]),
    (changed(metadata=[]), ["kind:metadata"]), ([1], ["kind:record", "missing:augmentation"][:1]), (changed(hint_mode="maybe", prompt_version=""), ["blank:prompt_version", "unknown_value:hint_mode"]),
]


def test_requests(spark, tmp_path):
    lines = [json.dumps(r) for r, _ in CASES] + ["{broken", "", "  "]
    (tmp_path / "requests.jsonl").write_text("\n".join(lines) + "\n")
    found = {r["line"]: r["violations"] for r in invariants.checked_lines(spark, str(tmp_path), invariants.REQUEST, invariants.REWRITE).collect()}
    for k, (_, want) in enumerate(CASES, 1):
        assert found[k] == want, CASES[k - 1]
    assert found[len(CASES) + 1] == ["no_json"] and len(found) == len(CASES) + 1
    bad = {r["line"] for r in invariants.bad_requests(spark, str(tmp_path)).collect()}
    assert bad == {k for k, v in found.items() if v}


def test_rules_stay_in_the_jvm(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("{}\n")
    plan = invariants.bad_results(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cache_problems():
    contract = {"seed": 1, "data": {"length": 5, "header": "h"}}
    good = {"schema_version": 1, "kind": "k", "splits": {"training": {"records": 1}}, "contract": contract}
    problems = lambda **other: token_records.cache_problems({**good, **other}, "k", contract, ("training",))
    assert problems() == []
    assert problems(schema_version=2) == ["version 2"] and problems(kind="o") == ["kind o"] and problems(splits={}) == ["no records of training"] == problems(splits={"training": {"records": 0}})
    assert problems(contract={**contract, "data": {"length": 6, "header": "h", "more": 1}}) == ["other contract.data.length", "other contract.data.more"]
    assert problems(contract=None) == ["other contract"] and problems(contract={**contract, "seed": True}) == ["other contract.seed"]


def test_cache_reads_one_split(spark, tmp_path):
    rows = spark.createDataFrame([(s, f"t{k}", "v", [1, 2], [(0, 1)], 2) for k, s in enumerate(["training", "validation", "training"])], "split string, task_id string, variant_id string, input_ids array<int>, spans array<struct<start:int,end:int>>, sequence_length int")
    path = f"file://{tmp_path}/cache"
    token_records.write_cache(rows, path, {"kind": "k", "contract": {"a": 1}})
    found = token_records.read_cache(spark, path, "training", "k", {"a": 1}, ("training", "validation"))
    assert sorted(r["task_id"] for r in found.collect()) == ["t0", "t2"]
    assert "PartitionFilters: [isnotnull(split" in found._jdf.queryExecution().executedPlan().toString()
    for kind, contract, splits in (("o", {"a": 1}, ()), ("k", {"a": 2}, ()), ("k", {"a": 1}, token_records.SPLITS)):
        with pytest.raises(token_records.OtherCache):
            token_records.read_cache(spark, path, "training", kind, contract, splits)
    with pytest.raises(token_records.OtherCache, match="no manifest"):
        token_records.read_cache(spark, f"{path}2", "training", "k", {})


def test_lists_and_pair_files(spark, tmp_path):
    (tmp_path / "list.json").write_text('["dir/a.json", "b.json", "c.d.json", "e", ".hidden"]')
    assert [r[0] for r in files.read_listed_tasks(spark, str(tmp_path / "list.json")).collect()] == ["a", "b", "c.d", "e", ".hidden"]
    (tmp_path / "list.jsonl").write_text('{"task_id": "x.json"}\n\n{"task_id": "y"}\n')
    assert [r[0] for r in files.read_listed_tasks(spark, str(tmp_path / "list.jsonl")).collect()] == ["x.json", "y"]
    (tmp_path / "pairs").mkdir()
    pair = {"input": [[1]], "output": [[2]]}
    for name, value in {"good": [pair], "empty": [], "object": pair, "half": [pair, {"input": [[1]]}], "text": ["x"]}.items():
        (tmp_path / "pairs" / f"{name}.json").write_text(json.dumps(value))
    assert {tuple(r) for r in records.bad_external(spark, str(tmp_path / "pairs")).collect()} == {("empty", "empty"), ("object", "no list"), ("half", "no pair"), ("text", "no pair")}


def test_expected_outputs(spark):
    grid = "array<array<int>>"
    tasks = spark.createDataFrame([("a", [([[1]], [[2]]), ([[1]], None)]), ("b", [([[1]], [[10]]), ([[1]], [[1], [1, 2]])]), ("c", []), ("d", None), ("e", [([[1]], [[0, 9]])])], f"task_id string, test array<struct<input:{grid},output:{grid}>>")
    assert {tuple(r) for r in files.bad_expected(tasks).collect()} == {("a", 1, "no output"), ("b", 0, "bad grid"), ("b", 1, "bad grid"), ("c", None, "no test pairs"), ("d", None, "no test pairs")}
