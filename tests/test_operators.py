import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import grids, traces
from gridloom.operators import corpus, cost, execution, guards, judging, requests, scoring
from gridloom.plans import variants
from gridloom.sources import files, schemas
from gridloom.streaming import stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_two_tests_one_solved(spark):
    """Loosely solved, not strictly; a quarter of the samples right, three quarters parsed."""
    given = [("t", 0, "t__0", 0, "ID", grids.IDENTITY, "12"), ("t", 0, "t__0", 1, "ID", grids.IDENTITY, "13"), ("t", 1, "t__1", 0, "ID", grids.IDENTITY, "1\n3"), ("t", 1, "t__1", 1, "ID", grids.IDENTITY, "no")]
    candidates = spark.createDataFrame(given, "task_id string, test_index int, request_id string, sample_index int, code string, value_mapping string, text string")
    expected = spark.createDataFrame([("t", 0, [[1, 2]]), ("t", 1, [[1], [2]])], f"task_id string, test_index int, expected {grids.GRID}")
    found = scoring.metrics(scoring.by_task(scoring.by_test(scoring.scored(candidates, expected))))
    assert {r["metric"]: r["rate"] for r in found.collect()} == {"thesis_solve": 1.0, "all_test_inputs_solve": 0.0, "test_input_solve": 0.5, "request_solve": 0.5, "sample_accuracy": 0.25, "parse_success": 0.75}
    text = scoring.report(found, {"Protocol": "standard32"})
    assert "| Thesis Solve | 1 | 1 | 100.00% |" in text and "| Sample Accuracy | 1 | 4 | 25.00% |" in text
    none = scoring.metrics(scoring.by_task(scoring.by_test(scoring.scored(candidates.limit(0), expected))))
    assert {r["rate"] for r in none.collect()} == {0.0}


def test_cost(spark):
    runs = spark.createDataFrame([("reasoning", 100, 200, 0), ("prediction", 300, 400, 0), ("adaptation", 0, 0, 300)], "kind string, prompt_tokens long, generated_tokens long, trained_tokens long")
    row = cost.summary(runs).first()
    assert (row["prefill_seconds"], row["training_seconds"], row["decode_seconds"]) == pytest.approx((0.08, 0.18, 8.0)) and row["total_seconds"] == pytest.approx(8.26)


def test_guards(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1)], "k string, i int")
    assert rows(guards.repeated(df, "k", "i")) == [("b", 1, 2)] and rows(guards.gaps(df, ["k"], "i")) == [("b",)]
    guards.raise_if_any(df.limit(0), "fine")
    with pytest.raises(ValueError, match="repeated"):
        guards.raise_if_any(guards.repeated(df, "k", "i"), "repeated")


def test_judges_and_reviews(spark):
    asked = spark.createDataFrame([(f"j{s}{k}", s, k) for s in "ab" for k in range(5)], "request_id string, source_request_id string, judge_index int")
    said = spark.createDataFrame([(f"j{s}{k}", '{"verdict": "pass"}' if s == "a" or k else "bad json") for s in "ab" for k in range(5)], "request_id string, raw_output string")
    counts = judging.unanimous(judging.judged(asked, said))
    assert rows(counts.select("source_request_id", "pass_count", "accepted", "parse_errors")) == [("a", 5, True, []), ("b", 4, False, ["jb0"])]
    results = counts.select(F.col("source_request_id").alias("request_id"), "accepted", "route")
    decisions = spark.createDataFrame([("b", True, " ok ")], "request_id string, decision boolean, note string")
    assert rows(judging.reviewed(results, decisions)) == [("a", True, "judge_5_of_5", None), ("b", True, "manual_review", "ok")]
    assert judging.notes_missing(decisions.withColumn("note", F.lit(" \t"))).count() == 1
    assert judging.wrong_vote_counts(judging.judged(asked.where("request_id <> 'ja0'"), said)).count() == 1


def test_budgets_are_nested_and_balanced(spark):
    slots = variants.slots(spark.createDataFrame([("t",)], "task_id string"))
    last = set()
    for budget in variants.BUDGETS:
        own = {r["variant_index"] for r in variants.budget_subset(slots, budget).collect()}
        assert len(own) == budget and last <= own
        last = own
    assert sorted(r["variant_index"] for r in variants.budget_subset(slots, 8).collect()) == list(range(7, 64, 8))
    assert [variants.samples_per_prompt(*a) for a in (("standard32",), ("augmented64",), ("budgeted64", 0), ("budgeted64", 16))] == [32, 1, 64, 4]
    for bad in (("budgeted64", None), ("standard32", 8), ("budgeted64", 7), ("other", None)):
        with pytest.raises(ValueError):
            variants.check_protocol(*bad)


def test_plan_draws(spark):
    plan = variants.task_plan("t", 3, 5)
    assert plan == variants.task_plan("t", 3, 5) and len(set(plan)) == 64
    rng = random.Random(variants.seeded(5, "ttt-plan", "t", "ID"))
    digits = list("0123456789")
    rng.shuffle(digits)
    places = [0, 1, 2]
    rng.shuffle(places)
    assert plan[0] == ("ID", "".join(digits), "".join(map(str, places)), 0)
    tasks = spark.createDataFrame([("t", 3), ("u", 12)], "task_id string, n_pairs int")
    assert rows(variants.augmentation_plan(tasks.repartition(5), 5)) == rows(variants.augmentation_plan(tasks.orderBy(F.desc("task_id")), 5))
    assert variants.drawn_order(12, random.Random(1)).count(",") == 11


def test_rewrite_specs_skip_what_is_known():
    first = variants.rewrite_specs(2, 3, set(), 0, 9)
    again = variants.rewrite_specs(2, 3, {f[:3] for f in first[:1]}, 5, 9)
    assert [f[:4] for f in again[:2]] == [f[:4] for f in first[1:]] and [f[4] for f in again] == [5, 6, 7]
    assert variants.rewrite_specs(2, 0, set(), 0, 9) == []


def test_packing():
    lengths = [50, 500, 30, 40]
    out = variants.packed("t", lengths, 3, 3, 120, 10, 1)
    assert all(1 <= len(pairs) <= 3 and 1 not in pairs and size <= 120 for _, pairs, _, _, size in out)
    order = sorted(out)
    assert order[0][1] == [0]  # pair 1 ended the first variant, and was consumed
    assert order[1][1] == [2, 3]
    with pytest.raises(ValueError):
        variants.packed("t", [500], 1, 3, 120, 10, 1)


def test_few_shots_leave_out_the_task(spark):
    tasks = spark.createDataFrame([("a", 0), ("a", 1), ("z", 0)], "task_id string, candidate int")
    got = {(r[0], r[1]): r[2] for r in variants.few_shots(tasks, ["a", "b", "c"], 2, 1).collect()}
    assert all(len(set(v)) == 2 and k[0] not in v for k, v in got.items())


def test_provider_lines(spark):
    chat = F.from_json(F.lit('[{"role":"system","content":"s"},{"role":"user","content":"u"},{"role":"assistant","content":"a"}]'), schemas.MESSAGES)
    line = spark.range(1).select(requests.provider_record(F.lit("k"), chat, F.lit(0.7), F.lit(1.0), F.lit(5), F.lit(None).cast("long"))).first()[0]
    assert json.loads(line) == {"key": "k", "request": {"contents": [{"parts": [{"text": "u"}], "role": "user"}, {"parts": [{"text": "a"}], "role": "model"}], "generationConfig": {"maxOutputTokens": 5, "temperature": 0.7, "topP": 1.0}, "systemInstruction": {"parts": [{"text": "s"}]}}}
    back = spark.createDataFrame([('{"key":"k","response":{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]},"finishReason":"STOP"}]}}',), ('{"key":"e","error":"quota"}',)], "l string").select(requests.provider_result(F.col("l")).alias("r")).select("r.*")
    assert rows(back) == [("e", "", None, 0, 0, "quota"), ("k", "ab", "STOP", 0, 0, None)]


def test_generation_boundary(spark):
    asked = spark.createDataFrame([("a", "p", 2), ("b", "q", 1)], "request_id string, prompt string, samples int")
    got = {r["request_id"]: [o["text"] for o in r["outputs"]] for r in execution.generated(asked, execution.echo, 1, "request_id").collect()}
    assert got == {"a": execution.echo(["p"], 2)[0], "b": execution.echo(["q"], 1)[0]}


TASK = {"train": [{"input": [[1, 2]], "output": [[2, 1]]}, {"input": [[3]], "output": [[4]]}], "test": [{"input": [[5]]}, {"input": [[6]], "output": [[7]]}]}


def test_files(spark, tmp_path):
    folder = tmp_path / "tasks"
    folder.mkdir()
    for name in ("b", "a-b", "a"):
        (folder / f"{name}.json").write_text(json.dumps(TASK))
    tasks = files.read_tasks(spark, str(folder))
    assert {r["task_id"] for r in tasks.collect()} == {"a", "a-b", "b"} and files.malformed_tasks(tasks).count() == 0
    assert files.long_form(tasks).count() == 12 and files.unlabelled_tests(tasks).count() == 3
    assert {len(r["pairs"]) for r in files.all_pairs(tasks).collect()} == {4}
    import hashlib

    want = hashlib.sha256(b"".join(f"{n}.json".encode() + b"\0" + (folder / f"{n}.json").read_bytes() + b"\0" for n in ("a", "a-b", "b"))).hexdigest()
    assert files.tasks_digest(spark, str(folder)) == want
    (tmp_path / "subset.json").write_text('["a.json", "b.x.json"]')
    assert rows(files.read_subset(spark, str(tmp_path / "subset.json"))) == [("a",), ("b",)]
    (tmp_path / "ids.jsonl").write_text('{"task_id": "a"}\n\n"b.json"\n"x_y"\n"a"\n')
    ids = files.read_task_ids(spark, str(tmp_path / "ids.jsonl"))
    assert rows(ids) == [("a",), ("a",), ("b",), ("x_y",)] and rows(files.bad_task_ids(ids)) == [("a", 2), ("x_y", 1)]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, None)], "n int, a string").coalesce(1)
    path = str(tmp_path / "out.jsonl")
    manifest = files.write_artifact(df, path, {"kind": "rows"})
    assert open(path).read() == '{"a":"é","n":2}\n{"n":1}\n' and manifest["record_count"] == 2
    assert files.verified_manifest(spark, path, "rows")["output_sha256"] == manifest["output_sha256"]
    with pytest.raises(FileExistsError):
        files.write_artifact(df, path, {"kind": "rows"})
    with open(path, "a") as f:
        f.write("{}\n")
    with pytest.raises(ValueError):
        files.verified_manifest(spark, path, "rows")
    with pytest.raises(ValueError):
        files.manifest_path("x.json")
    assert rows(files.malformed_lines(spark, path)) == [] and files.read_existing(spark, str(tmp_path / "none"), "n int").count() == 0


def test_plans_and_guidance(spark, tmp_path):
    plan = variants.augmentation_plan(spark.createDataFrame([("t", 2), ("u", 3)], "task_id string, n_pairs int"), 1)
    path = str(tmp_path / "plan.json")
    files.write_plan(plan, path, 1)
    read = variants.renumbered(files.read_plan(spark, path)).select("task_id", "code", "value_mapping", "order_mapping", "variant_index")
    assert rows(read) == rows(plan) and variants.incomplete_plans(read).count() == 0
    legacy = {"t": ["t_ID_0123456789_10", "t_ID_1234567890_01"]}
    (tmp_path / "old.json").write_text(json.dumps(legacy))
    assert [r["variant_index"] for r in variants.renumbered(files.read_plan(spark, str(tmp_path / "old.json"))).orderBy("at").collect()] == [0, 1]
    tail = "General natural language description:\na\nGeneral steps:\nb"
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(x) for x in ({"request_id": "t", "raw_output": f"</think>{tail}"}, {"key": "u", "guidance": "bad"}, {"key": "v", "trace": "  "})))
    assert rows(files.read_guidance(spark, str(tmp_path / "g.jsonl"))) == sorted([("t", tail), ("u", None), ("v", None)], key=str)
    assert ("v", "") in rows(files.read_adaptation_guidance(spark, str(tmp_path / "g.jsonl")))
    (tmp_path / "m.json").write_text(json.dumps({"guided": {"t": tail, "u": [{"trace": f"</think>{tail}"}], "meta": {"x": 1}}}))
    found = files.read_guidance_map(spark, str(tmp_path / "m.json"))
    assert rows(found) == [("t", tail), ("u", tail)] and files.bad_guidance(found).count() == 0 and files.bad_guidance(found, True).count() == 2


def test_predictions(spark, tmp_path):
    variant = {"key": "t_R90_0123456789_10", "task_id": "t", "is_augmented": True, "transformation_code": "R90", "value_mapping": "0123456789", "order_mapping": "10", "variant_index": 8}
    record = {"request_id": "t_R90_0123456789_10__0", "task_id": "t", "test_index": 0, "variant": variant, "outputs": [{"sample_index": 0, "text": "1", "generated_token_count": 1}]}
    broken = {**record, "request_id": "x", "variant": {**variant, "key": "t"}}
    (tmp_path / "p.jsonl").write_text(json.dumps(record) + "\n" + json.dumps(broken))
    found = files.read_lines(spark, str(tmp_path / "p.jsonl"), schemas.PREDICTION)
    assert rows(files.inconsistent_variants(found)) == [("x",)] and files.candidates(found).count() == 2


def test_hints(spark, tmp_path):
    hint = {"schema_version": 1, "task_id": "a", **{f: "x" for f in files.HINT_FIELDS}}
    (tmp_path / "h.jsonl").write_text("\n".join(json.dumps(x) for x in (hint, {**hint, "task_id": "b", "inputs": " "})))
    hints = files.read_hints(spark, str(tmp_path / "h.jsonl"))
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task_id string")
    assert rows(files.with_hints(tasks, hints).select("task_id", "status")) == [("a", "complete"), ("b", "incomplete"), ("c", "missing")]
    assert files.bad_hints(hints.union(hints)).count() == 2


def test_stream_counts_each_record_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(k % 5, "a") for k in range(10)], "event_id long, event_type string").write.parquet(folder)
    arrived = stream.once(stream.arrivals(spark, folder, "event_id long, event_type string"), "event_id")
    assert rows(stream.counts(stream.finished(arrived, "test"), "event_type")) == [("a", 5)]


def test_request_ids_are_those_of_ascii_json(spark):
    texts = ["plain", "é", "🎉 x", "a\tb\x01\x1f\"\\", "\\u00e9", "\u2028\x7f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(requests.request_id(F.lit("s"), F.col("t"), {"k": F.col("t")})).collect()]
    payload = lambda t: json.dumps({"identity": {"k": t}, "stage": "s", "task_id": t}, sort_keys=True, separators=(",", ":"))
    assert got == [f"s-{t}-{hashlib.sha256(payload(t).encode()).hexdigest()[:16]}" for t in texts]


def test_provider_lines_of_either_spelling(spark):
    lines = [
        '{"key":"a","response":{"candidates":[{"content":{"parts":[{"text":"x"}]},"finish_reason":"STOP"}],"usage_metadata":{"prompt_token_count":3,"candidates_token_count":4}}}',
        '{"key":"b","error":{"message":"no","status":"BAD"}}',
        '{"key":"c","error":{"status":"BAD"}}',
        '{"key":"d","error":"plain"}',
        '{"key":"e","error":{"code":7}}',
        '{"key":"f","response":{"usageMetadata":{"promptTokenCount":1}}}',
    ]
    got = [tuple(r[0]) for r in spark.createDataFrame([(x,) for x in lines], "line string").select(requests.provider_result(F.col("line"))).collect()]
    assert got == [("a", "x", "STOP", 3, 4, None), ("b", "", None, 0, 0, "no"), ("c", "", None, 0, 0, "BAD"), ("d", "", None, 0, 0, "plain"), ("e", "", None, 0, 0, '{"code":7}'), ("f", "", None, 1, 0, None)]


def test_verdicts_are_strict_json(spark):
    cases = {'{"verdict":"pass"} x': None, '{"verdict":"fail","verdict":" PASS\\n"}': "pass", '{"verdict":1}': None, "{'verdict':'pass'}": None, '{"verdict":"pass"},{}': None, '["pass"]': None, "": None, '{"verdict":null}': None, ' {"a":[1,{}],"verdict":"Fail"}\n': "fail", '{"verdict":"maybe"}': None, "x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", traces.verdict(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == cases


def test_results_that_name_another_task_are_reported(spark):
    asked = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c")], "request_id string, task_id string")
    results = spark.createDataFrame([("q1", "a"), ("q2", "x"), ("q3", None)], "request_id string, task_id string")
    assert [tuple(r) for r in corpus.disagreeing(results, asked).collect()] == [("q2", "x", "b")]


def test_adaptation_guidance_holds_no_private_reasoning(spark, tmp_path):
    summary = "General natural language description:\nd\nGeneral steps:\ns"
    lines = [{"request_id": "a", "raw_output": f"<think>\nsecret\n</think>\n{summary} "}, {"request_id": "b", "guidance": "\n\t"}, {"request_id": "c", "guidance": "no headings"}, {"request_id": "d", "guidance": f" {summary}"}]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r["key"]: r["guidance"] for r in files.read_adaptation_guidance(spark, str(tmp_path / "g.jsonl")).collect()}
    assert got == {"a": summary, "b": "", "c": None, "d": summary}


def test_guidance_of_white_space_only_is_missing(spark):
    rows = spark.createDataFrame([("t", "ID", "0123456789", None, 0)], "task_id string, code string, value_mapping string, order_mapping string, variant_index int")
    key = rows.select(variants.view_key()).first()[0]
    for text, want in (("\n\t", "missing"), (" x", "provided")):
        found = variants.resolved_guidance(rows, spark.createDataFrame([(key, text)], "key string, guidance string"), 64).first()
        assert found["status"] == want
