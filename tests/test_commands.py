import json

import pytest
from pyspark.sql import functions as F

from gridloom import cli, config
from gridloom.functions import chat, traces
from gridloom.operators import corpus, migration
from gridloom.sources import files, records, schemas

TRACE = "\n".join(["<think>", "1) INPUT ANALYSIS", "a", "2) OUTPUT ANALYSIS", "b", "3) TRANSFORMATION ANALYSIS", "c", "4) STEPS FOR THE TRANSFORMATION", "d", "</think>", "General natural language description:", "e", "General steps:", "f"])
TASK = {"train": [{"input": [[1, 2]], "output": [[2, 1]]}, {"input": [[3]], "output": [[3]]}], "test": [{"input": [[5, 6]], "output": [[6, 5]]}]}


def lines(folder):
    return [json.loads(x) for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def tasks(tmp_path):
    (tmp_path / "tasks").mkdir()
    for t in ("a", "b"):
        (tmp_path / "tasks" / f"{t}.json").write_text(json.dumps(TASK))
    (tmp_path / "ids.json").write_text('["a.json", "b.json"]')
    return tmp_path


def test_generation_flow(spark, tasks):
    p = lambda name: str(tasks / name)
    run = lambda *a: cli.main(list(a), spark)
    hint = {"schema_version": 1, "task_id": "a", **{f: "x" for f in files.HINT_FIELDS}}
    (tasks / "hints.jsonl").write_text(json.dumps(hint))
    assert run("prepare-initial", "--tasks", p("tasks"), "--task-ids", p("ids.json"), "--hints", p("hints.jsonl"), "--candidates", "2", "--output", p("initial")) == 0
    asked = lines(tasks / "initial")
    assert len(asked) == 4 and len({r["request_id"] for r in asked}) == 4 and {(r["task_id"], r["hint_mode"]) for r in asked} == {("a", "hinted"), ("b", "unhinted")}
    (tasks / "results.jsonl").write_text("\n".join(json.dumps({"request_id": r["request_id"], "task_id": r["task_id"], "stage": "initial", "raw_output": TRACE if r["task_id"] == "a" else "bad"}) for r in asked))
    assert run("validate-static", "--input", p("results.jsonl"), "--output", p("static")) == 0
    assert sorted(r["validation"]["static"]["accepted"] for r in lines(tasks / "static")) == [False, False, True, True]
    assert run("prepare-judge", "--input", p("static"), "--tasks", p("tasks"), "--output", p("judge")) == 0
    judges = lines(tasks / "judge")
    assert len(judges) == 10
    said = [{"request_id": j["request_id"], "raw_output": '{"verdict": "pass"}'} for j in judges]
    said[0]["raw_output"] = "no"
    (tasks / "votes.jsonl").write_text("\n".join(map(json.dumps, said)))
    assert run("evaluate-judges", "--judge-requests", p("judge"), "--judge-results", p("votes.jsonl"), "--output", p("judged")) == 0
    judged = lines(tasks / "judged")
    assert sorted(r["accepted"] for r in judged) == [False, True]
    loser = next(r["request_id"] for r in judged if not r["accepted"])
    (tasks / "decisions.jsonl").write_text(json.dumps({"request_id": loser, "accepted": True, "reviewer_note": "fine"}))
    assert run("apply-reviews", "--input", p("judged"), "--decisions", p("decisions.jsonl"), "--output", p("final")) == 0
    assert {r["route"] for r in lines(tasks / "final") if r["request_id"] == loser} == {"manual_review"}
    # whole results: what judges and reviewers decide is added, nothing is lost
    assert run("evaluate-judges", "--judge-requests", p("judge"), "--judge-results", p("votes.jsonl"), "--sources", p("static"), "--output", p("whole")) == 0
    before, after = ({r["request_id"]: r for r in lines(tasks / f)} for f in ("static", "whole"))
    assert len(after) == 2 and all({**r, "validation": None} == {**before[k], "validation": None} and r["validation"]["static"] == before[k]["validation"]["static"] for k, r in after.items())
    assert after[loser]["validation"]["quality"] == {"accepted": False, "route": "judge_5_of_5", "pass_count": 4, "vote_count": 5} and after[loser]["validation"]["judge_parse_errors"] == [judges[0]["request_id"]]
    assert run("apply-reviews", "--input", p("whole"), "--whole", "--decisions", p("decisions.jsonl"), "--output", p("reviewed")) == 0
    last = {r["request_id"]: r for r in lines(tasks / "reviewed")}
    assert last[loser]["validation"]["quality"] == {"accepted": True, "route": "manual_review", "reviewer_note": "fine"} and last[loser]["raw_output"] == TRACE
    winner = next(k for k in last if k != loser)
    assert last[winner] == after[winner]
    assert run("prepare-judge", "--input", p("static"), "--tasks", p("tasks"), "--judge-seed", "40", "--output", p("seeded")) == 0
    seeded = lines(tasks / "seeded")
    assert sorted((j["judge_index"], j["sampling"]["seed"]) for j in seeded) == [(k, 40 + k) for k in range(5) for _ in range(2)]
    assert {j["request_id"] for j in seeded}.isdisjoint(j["request_id"] for j in judges) and all("seed" not in j["sampling"] for j in judges)
    assert run("render-requests", "--input", p("initial"), "--output", p("texts")) == 0
    assert run("evaluate-judges", "--judge-requests", p("judge"), "--judge-results", p("results.jsonl"), "--output", p("x")) == 2


def test_batches_plans_scores_and_costs(spark, tasks):
    p = lambda name: str(tasks / name)
    (tasks / "requests.jsonl").write_text(json.dumps({"request_id": "k", "task_id": "a", "messages": [{"role": "user", "content": "u"}], "sampling": {"temperature": 0.5, "max_tokens": 4}}))
    assert cli.main(["export-batch", "--input", p("requests.jsonl"), "--output", p("batch")], spark) == 0
    assert json.loads(next((tasks / "batch").glob("part-*")).read_text())["key"] == "k"
    (tasks / "answers.jsonl").write_text('{"key":"k","response":{"candidates":[{"content":{"parts":[{"text":"t"}]}}]}}\n')
    assert cli.main(["import-batch", "--input", p("answers.jsonl"), "--requests", p("requests.jsonl"), "--output", p("imported")], spark) == 0
    assert lines(tasks / "imported")[0]["raw_output"] == "t"
    assert cli.main(["build-plan", "--tasks", p("tasks"), "--seed", "3", "--output", p("plan.json")], spark) == 0
    assert {k: len(v) for k, v in json.loads((tasks / "plan.json").read_text())["tasks"].items()} == {"a": 64, "b": 64}
    assert cli.main(["build-plan", "--tasks", p("tasks"), "--output", p("plan.json")], spark) == 2
    plain = {"key": "a", "task_id": "a", "is_augmented": False, "transformation_code": "ID", "value_mapping": "0123456789"}
    (tasks / "p.jsonl").write_text(json.dumps({"request_id": "a__0", "task_id": "a", "test_index": 0, "variant": plain, "outputs": [{"sample_index": 0, "text": "65"}, {"sample_index": 1, "text": "56"}]}))
    assert cli.main(["evaluate", "--predictions", p("p.jsonl"), "--tasks", p("tasks"), "--output", p("all")], spark) == 2  # task b has no candidates
    (tasks / "ids.json").write_text('["a"]')
    assert cli.main(["evaluate", "--predictions", p("p.jsonl"), "--tasks", p("tasks"), "--task-ids", p("ids.json"), "--output", p("score")], spark) == 0
    (tasks / "gap.jsonl").write_text(json.dumps({"request_id": "a__0", "task_id": "a", "test_index": 0, "variant": plain, "outputs": [{"sample_index": 5, "text": "65"}]}))
    assert cli.main(["evaluate", "--predictions", p("gap.jsonl"), "--tasks", p("tasks"), "--task-ids", p("ids.json"), "--output", p("gapped")], spark) == 2
    assert json.loads((tasks / "score.json").read_text())["sample_accuracy"] == {"correct": 1, "total": 2, "rate": 0.5} and "50.00%" in (tasks / "score.md").read_text()
    (tasks / "runs.jsonl").write_text('{"kind":"prediction","prompt_tokens":5000,"generated_tokens":75}')
    assert cli.main(["summarize-compute", "--runs", p("runs.jsonl"), "--output", p("cost.json")], spark) == 0
    assert json.loads((tasks / "cost.json").read_text())["total_seconds"] == 2.0


def test_trace_forms(spark, tmp_path):
    cases = {"text.txt": (" t ", "t"), "s.json": ('"t"', "t"), "l.json": ('[{"cot": "t"}]', "t"), "k.json": ('{"me": "t", "trace": "u"}', "t"), "f.json": ('{"final": "z", "response": "t"}', "t"), "n.json": ('{"x": 1}', None), "b.txt": (" \n", None)}
    for name, (body, want) in cases.items():
        (tmp_path / name).write_text(body)
        assert records.trace_of_file(spark, str(tmp_path / name), "me").first()["trace"] == want, name


def test_pools_and_base_traces(spark, tasks):
    (tasks / "base.jsonl").write_text("\n".join(json.dumps({"task_id": t, "trace": x}) for t, x in (("a", TRACE), ("b", "bad"))))
    assert {(r["source_id"], r["accepted"]) for r in records.base_traces(spark, str(tasks / "base.jsonl")).collect()} == {("base-trace-a", True), ("base-trace-b", False)}
    manifest = spark.createDataFrame([("b", 0, None), ("a", 1, " own "), ("z", 2, "t")], "task_id string, pool_order int, trace string")
    none = spark.createDataFrame([], "task_id string, " + ", ".join(f"{f} string" for f in (*files.HINT_FIELDS, "status")))
    pool = records.few_shot_pool(manifest, files.read_tasks(spark, str(tasks / "tasks")), none, records.traces_by_key(spark, str(tasks / "base.jsonl")))
    assert rows(pool.select("task_id", "trace", "status")) == [("a", "own", "missing"), ("b", "bad", "missing"), ("z", "t", "missing")]
    assert [r["task_id"] for r in records.bad_pool(pool).collect()] == ["z"]


def test_validation_and_caches(spark, tmp_path):
    good = {"schema_version": 1, "split": "validation", "variant_id": "a", "task_id": "a", "trace": TRACE}
    (tmp_path / "v.jsonl").write_text("\n".join(json.dumps(x) for x in (good, {**good, "variant_id": "b", "task_id": "b", "trace": "bad"}, {**good, "variant_id": "c", "task_id": "c", "augmentation": {"transformation_code": "R90", "value_mapping": "0123456789", "order_mapping": "0,2"}})))
    assert rows(records.bad_validation(records.validation_variants(spark, str(tmp_path / "v.jsonl")), "validation")) == [("b", "b"), ("c", "c")]
    (tmp_path / "ext").mkdir()
    (tmp_path / "ext" / "t.json").write_text(json.dumps([{"input": [[1]], "output": [[2]]}]))
    assert rows(records.external_pairs(spark, str(tmp_path / "ext"))) == [("t", 0, [[1]], [[2]])]
    df = spark.createDataFrame([("train", "a", "a:1", "xy"), ("validation", "b", "b:1", "z")], "split string, task_id string, variant_id string, text string")
    tokens = df.withColumn("input_ids", chat.byte_tokens(F.col("text"))).withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")))).withColumn("sequence_length", F.size("input_ids")).drop("text")
    records.write_tokens(tokens, str(tmp_path / "cache"))
    read = records.read_tokens(spark, str(tmp_path / "cache"))
    assert rows(corpus.length_stats(read, "sequence_length", "split").select("split", "longest")) == [("train", 2), ("validation", 1)]
    with pytest.raises(Exception, match="(?i)exists"):
        records.write_tokens(tokens, str(tmp_path / "cache"))
    digest = lambda n: records.contract_digest(spark.createDataFrame([(n, "m")], "length int, model string")).first()[0]
    assert digest(1) == digest(1) != digest(2)


def test_migrations(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "task_id string")
    hints = spark.createDataFrame([("a", "complete"), ("b", "incomplete")], "task_id string, status string")
    found = spark.createDataFrame([("a", TRACE), ("b", TRACE.replace("</think>\n", "")), ("x", "bad")], "task_id string, trace string")
    made = {r["task_id"]: r for r in migration.task_manifest(ids("a", "b", "c"), ids("a"), hints, ids("a")).collect()}
    assert made["a"]["corpus_partition"].startswith("legacy") and made["a"]["few_shot_pool"] and made["b"]["hint_mode"] == "none" and made["c"]["hint_status"] == "missing"
    problems = rows(migration.manifest_problems(ids("a", "b", "c"), ids("a", "q"), hints, ids("b"), found))
    assert problems == sorted([("q", "not in the corpus"), ("c", "no trace"), ("x", "no task"), ("x", "trace can't be repaired"), ("b", "no complete hint")], key=str)
    fixed = {r["task_id"]: r for r in migration.repaired_traces(found).collect()}
    assert fixed["b"]["repair"] == "insert_missing_think_close" and fixed["a"]["repair"] is None
    original = spark.createDataFrame([("a", "t"), ("b", "t"), ("d_x", "t")], "key string, trace string")
    augmented = spark.createDataFrame([("a_R90_0123456789_10", "t"), ("c_R90_0123456789_10", "t"), ("bad_key", "t")], "key string, trace string")
    bad = set(rows(migration.validation_problems(original, augmented, ids("a"))))
    assert {("a", "in training"), ("b", "in one view only"), ("c", "in one view only"), ("d_x", "not a plain key"), ("bad_key", "not an augmented key")} <= bad


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("schema_version: 1\ncompute:\n  prefill_tokens_per_second: 10.0\n")
    assert config.load(config.Evaluation, str(path)).compute.prefill_tokens_per_second == 10.0
    path.write_text("epochs: 5\nprofiles:\n  small:\n    epochs: 2\n")
    assert config.load(config.Training, str(path), "small").epochs == 2 and config.load(config.Training, str(path)).epochs == 5
    for text in ("compute:\n  prefill_tokens_per_second: 0\n", "unknown: 1\n", "schema_version: 2\n", "- 1\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            config.load(config.Evaluation, str(path))
    with pytest.raises(ValueError):
        config.Training(epochs=200)
    with pytest.raises(ValueError):
        config.Protocols(guidance_budgets=(0, 7))


def test_nothing_is_inferred(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"request_id": "a"}\nnot json\n')
    with pytest.raises(Exception):
        files.read_lines(spark, str(tmp_path / "x.jsonl"), schemas.RESULT).collect()
    assert [r["value"] for r in files.malformed_lines(spark, str(tmp_path / "x.jsonl")).collect()] == ["not json"]
    assert traces.VOTES == 5
