import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import chat, tokens
from gridloom.operators import corpus, token_records

IDS = "ids array<int>"
PAIR = "struct<input:array<array<int>>,output:array<array<int>>>"


def words():
    """Pieces of a text: markers whole, anything else by character. Local, so that workers get it by value."""
    marks = ("<|im_start|>", "<|im_end|>", "system", "user", "assistant")

    class Words:
        def encode(self, text):
            out = []
            while text:
                piece = next((m for m in marks if text.startswith(m)), text[0])
                out.append(5_000_000 + marks.index(piece) if piece in marks else ord(piece))
                text = text[len(piece) :]
            return out

    return lambda: Words()


def found_after(ids, marker, start):
    return next((k + len(marker) for k in range(start, len(ids) - len(marker) + 1) if ids[k : k + len(marker)] == marker), -1) if marker and start >= 0 else -1


def test_places_of_markers(spark):
    rng, marker = random.Random(3), [1, 2, 1]
    rows = [[rng.choice((1, 2, 12, 21, 9_999_999)) for _ in range(rng.randrange(30))] for _ in range(300)]
    for start in (0, 1, 5):
        got = spark.createDataFrame([(r,) for r in rows], IDS).select(tokens.place_after(tokens.searchable(F.col("ids")), marker, start)).collect()
        assert [r[0] for r in got] == [found_after(r, marker, start) for r in rows]
    bad = spark.createDataFrame([([1, -1],), ([10**7],), ([None],)], IDS).select(tokens.searchable(F.col("ids")).alias("t")).collect()
    assert all(r["t"] is None for r in bad)


@pytest.mark.parametrize("name", ["bytes", "words"])
def test_scan_equals_running_lengths(spark, name):
    tokenizer = tokens.BYTES if name == "bytes" else tokens.from_loader(words())
    rng = random.Random(5)
    grid = lambda: [[rng.randrange(10) for _ in range(rng.randrange(1, 4))]]
    rows = [([(grid(), grid()) for _ in range(rng.randrange(1, 5))], rng.choice([None, "", "rule é"])) for _ in range(60)]
    df = spark.createDataFrame(rows, f"pairs array<{PAIR}>, guidance string").withColumn("task_id", F.lit("t")).withColumn("variant_id", F.lit("v"))
    records = token_records.adaptation_records(df, 10_000, tokenizer=tokenizer)
    for r in records.collect():
        spans = [r["input_ids"][s["start"] : s["end"]] for s in r["assistant_spans"]]
        want = ["".join(map(str, p["output"][0])) for p in r["pairs"]]
        assert [bytes(s).decode() if name == "bytes" else "".join(map(chr, s)) for s in spans] == want
        assert r["status"] == ("ok" if len(want) > 1 else "too_few_pairs")
        assert r["target_token_count"] == sum(map(len, want[1:]))
    if name == "bytes":
        same = records.where(F.col("assistant_spans") != chat.assistant_spans(F.col("pairs"), F.col("guidance")))
        assert same.count() == 0


def test_what_a_scan_reports(spark):
    system, user, answer = chat.SYSTEM + "s" + chat.END, chat.USER + "u" + chat.END, chat.ASSISTANT + "a" + chat.END
    texts = {
        "ok": (user + answer, 1, False), "no_system": (user + answer, 1, True), "open_system": (chat.SYSTEM + "s", 1, True), "no_user": (user + answer, 2, False),
        "open_user": (chat.USER + "u", 1, False), "no_assistant": (user, 1, False), "empty_target": (user + chat.ASSISTANT + chat.END, 1, False), "trailing": (system + user + answer + "x", 1, True),
    }
    df = spark.createDataFrame([(k, *v) for k, v in texts.items()], "name string, text string, turns int, system boolean").withColumn("ids", chat.byte_tokens(F.col("text")))
    got = df.select("name", tokens.scanned_spans(F.col("text"), F.col("ids"), F.col("turns"), F.col("system"), tokens.BYTES)["status"].alias("status")).collect()
    assert {r["name"]: r["status"] for r in got} == {k: k for k in texts}
    assert spark.createDataFrame([([1, None],)], IDS).select(tokens.scanned_spans(F.lit(""), F.col("ids"), F.lit(1), F.lit(False), tokens.Tokenizer(chat.byte_tokens, lambda text: list(text.encode())))["status"]).first()[0] == "bad_ids"


def test_tokenizers_must_give_flat_integers():
    assert tokens.flat_ids([1, 2]) == [1, 2]
    for bad in ([True], [1.0], [[1]], "12", None):
        with pytest.raises(TypeError):
            tokens.flat_ids(bad)


def test_spans_out_of_place(spark):
    cases = [([(0, 2), (2, 4)], False), ([(0, 2), (1, 4)], True), ([(2, 2)], True), ([(0, 9)], True), ([], False), ([(-1, 2)], True)]
    df = spark.createDataFrame([([{"start": a, "end": b} for a, b in s],) for s, _ in cases], f"spans {chat.SPAN}")
    assert [r[0] for r in df.select(tokens.misplaced(F.col("spans"), F.lit(8))).collect()] == [w for _, w in cases]


def test_prediction_records_keep_to_their_profile(spark):
    rows = [("a", [([[1]], [[2]], "train"), ([[3]], [[4]], "test")], None), ("b", [([[1]], [[2]], "train")], "g"), ("c", [], None)]
    df = spark.createDataFrame(rows, "task_id string, pairs array<struct<input:array<array<int>>,output:array<array<int>>,split:string>>, guidance string").withColumn("variant_id", F.col("task_id"))
    out = {r["task_id"]: r for r in token_records.prediction_records(df, False).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"a": "ok", "b": "other_profile", "c": "no_pairs"}
    assert (out["a"]["n_pairs_total"], out["a"]["n_pairs_train"], out["a"]["n_pairs_test"], out["a"]["guided"]) == (2, 1, 1, False)
    assert {r["task_id"] for r in token_records.wrong_records(token_records.prediction_records(df, True)).collect()} == {"a", "c"}


def test_reasoning_records(spark):
    rows = [("a", [([[1, 2]], [[3]])], "because"), ("b", [([[1]], [[3]])], None)]
    df = spark.createDataFrame(rows, f"task_id string, pairs array<{PAIR}>, trace string").withColumn("variant_id", F.col("task_id"))
    a, b = token_records.reasoning_records(df).orderBy("task_id").collect()
    assert bytes(a["input_ids"][a["assistant_start"] :]).decode() == "because" + chat.END and a["status"] == "ok"
    assert b["status"] == "empty"


def test_plans_and_splits(spark, tmp_path):
    tasks = spark.createDataFrame([("t", [([[1, 2]], [[2, 1]]), ([[3]], [[4]])]), ("u", [([[1]], [[2]]), ([[3]], [[4]])])], f"task_id string, train array<{PAIR}>")
    plan = spark.createDataFrame([("t", "R90", "1234567890", "10", 0), ("t", "ID", "0123456789", "01", 1), ("u", "ID", "0123456789", "01", 0)], "task_id string, code string, value_mapping string, order_mapping string, variant_index int")
    said = plan.select("task_id", "variant_index", F.lit("missing").alias("status"), F.lit(None).cast("string").alias("content"))
    records = token_records.planned_records(plan, tasks, said, 10_000)
    first = records.where("variant_index = 0 and task_id = 't'").first()
    assert first["variant_id"] == "t_R90_1234567890_10" and first["status"] == "ok" and first["guidance_status"] == "missing"
    assert bytes(first["input_ids"]).decode().split("\n")[1] == "4<|im_end|>"
    assert [r["task_id"] for r in token_records.unplanned(plan, tasks, 2).collect()] == ["u"]
    assert token_records.split_counts(records, 170).first().asDict() == {"records": 3, "unsound": 0, "too_long": records.where("sequence_length > 170").count(), "candidates": records.where("sequence_length <= 170").count()}
    token_records.write_cache(records.drop("pairs").withColumn("split", F.lit("training")), str(tmp_path / "cache"), {"kind": "token_cache"})
    stated = json.loads((tmp_path / "cache.manifest.json").read_text())
    assert stated["kind"] == "token_cache" and stated["splits"]["training"]["records"] == 3
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 3


def test_labelled_pairs_and_views(spark):
    tasks = spark.createDataFrame([("t", [([[1, 2]], [[2, 1]])], [([[5]], [[6]])]), ("u", [([[1]], None)], [])], f"task_id string, train array<{PAIR}>, test array<{PAIR}>")
    assert [r["task_id"] for r in corpus.unlabelled(tasks).collect()] == ["u"]
    views = spark.createDataFrame([("t", "FV", "1234567890"), ("t", None, None)], "task_id string, code string, value_mapping string")
    got = {r["code"]: [(p["input"], p["output"], p["split"]) for p in r["pairs"]] for r in corpus.whole_views(views, tasks).collect()}
    assert got == {"FV": [([[3, 2]], [[2, 3]], "train"), ([[6]], [[7]], "test")], None: [([[1, 2]], [[2, 1]], "train"), ([[5]], [[6]], "test")]}
