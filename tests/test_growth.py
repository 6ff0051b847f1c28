"""Steps whose work must grow no faster than the input: how often rows are shuffled, scanned, parsed or encoded."""

import re

import pytest
from pyspark.sql import functions as F

from gridloom import queries, queries_files, queries_runs  # noqa: F401
from gridloom.functions import chat, grids, keys, tokens, traces
from gridloom.operators import cost, migration, requests, token_records
from gridloom.plans import external, variants
from gridloom.sources import artifacts, files


def plan(spark, sf, name):
    return queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["guidance_state", "missing_guidance", "samples_per_prompt", "unsound_adapters"])
def test_views_are_not_shuffled_once_made(spark, sf, name):
    """Views of a task meet by task and key where the plan has put them."""
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(spark, sf, name))
    assert dealt and not [d for d in dealt if re.search(r"\b(status|key|code|step|variant_id|variant_index|n_train)#", d)]


@pytest.mark.parametrize("name", ["plan_renumber", "plan_lines"])
def test_keys_are_taken_apart_once_a_row(spark, sf, name):
    """a filter on a key's parts doesn't parse the key again."""
    assert "Generate inline" in plan(spark, sf, name)


def test_plans_need_no_sorted_lines(spark, sf):
    """a plan takes counts of lines only."""
    assert "Window" not in plan(spark, sf, "guidance_state")


def test_views_pass_by_the_turned_texts_of_their_part(spark, sf):
    """views aren't sorted with their task's texts."""
    assert "ShuffledHashJoin" in plan(spark, sf, "planned_records")


def test_mappings_and_orders_as_before(spark):
    texts = ["0123456789", "9876543210", "0123456788", "012345678", "01234567890", "", None, "012345678９", "a123456789", "10", "0", "1", "00", "0,1", " 10 ", "1 0", "021\n", "10,9,8,7,6,5,4,3,2,1,0", "02", "-1", "012345678910"]
    slow = lambda c: F.coalesce(c.rlike(r"\A[0-9]{10}\z") & (F.size(F.array_distinct(F.split(c, ""))) == 10), F.lit(False))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", grids.is_permutation(F.col("t")).alias("got"), slow(F.col("t")).alias("want"), keys.order_indices(F.col("t")).alias("order"), keys.is_order(F.col("t")).alias("is_order")).collect()
    orders = {"0123456789": list(range(10)), "9876543210": list(range(9, -1, -1)), "10": [1, 0], "0": [0], "0,1": [0, 1], " 10 ": [1, 0], "1 0": [1, 0], "021\n": [0, 2, 1], "10,9,8,7,6,5,4,3,2,1,0": list(range(10, -1, -1)), "012345678": list(range(9))}
    for r in rows:
        assert r["got"] == r["want"] and r["order"] == orders.get(r["t"]) and r["is_order"] == (r["t"] in orders), r


def test_adapters_with_a_step_twice_or_out_of_range(spark):
    """F8: bits tell the same as distinct counts, also where the plan isn't a multiple of 32."""
    step = {"good": lambda k: k, "twice": lambda k: 39 if k == 40 else k, "beyond": lambda k: 41 if k == 40 else k, "none": lambda k: None if k == 7 else k}
    rows = [(t, f(k), f"v{k}", f"c{k % 4}", "provided") for t, f in step.items() for k in range(1, 41)]
    found = cost.unsound_adapters(spark.createDataFrame(rows, "task_id string, step int, variant_id string, code string, guidance_status string"), 40, 4)
    assert {r[0] for r in found.collect()} == {"twice", "beyond", "none"}


def test_validation_problems_count_rows_in_one_pass(spark, sf):
    """a problem is said for each row that has it, and keys without a task match nothing."""
    view = lambda *ks: spark.createDataFrame([(k, "t") for k in ks], "key string, trace string")
    full = lambda t: f"{t}_ID_0123456789_0"
    found = migration.validation_problems(view("a", "b", "b", "c", None), view(full("a"), full("d"), full("d"), "e", "x_y"), spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "task_id string"))
    want = [("a", "in training"), ("b", "twice"), ("b", "in one view only"), ("b", "in one view only"), ("b", "in training"), ("b", "in training"), ("c", "in one view only"), (None, "in one view only"), ("d", "twice"), ("d", "in one view only"), ("d", "in one view only"), ("e", "not an augmented key"), ("e", "in one view only"), ("x_y", "not an augmented key"), (None, "in one view only")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert plan(spark, sf, "validation_pairs").count("FileScan") <= 5


def test_settled_text_is_encoded_once():
    """of a part that is taken, only the open rest is encoded again."""

    class Counting:
        seen = 0

        def encode(self, text):
            self.seen += len(text)
            return list(text.encode())

        def settled(self, text):
            return max(0, len(text) - 3)

    known = Counting()
    growing = external.Growing(known)
    for _ in range(5):
        growing.offered("x" * 100)
        growing.take()
    assert growing.ids() == [120] * 500 and known.seen < 5 * 110


def test_settled_by_pieces_without_gaps_or_with():
    known = queries_runs.ranked()
    for text in ("", "a", "one two", "12\n34 it's\n\n x", "<|im_end|>\n<|im_start|>user\n123\n456"):
        ends = [0, 0, 0, 0, *[m.end() for m in known.pieces.finditer(text)]]
        assert known.settled(text) == ends[-4]


ODD_TEXTS = ["123\n456", "7", "12\n34\n56", "0123456789", "", "12\n3", "1\n", "\n1", "1\n\n2", None]


def test_texts_are_turned_as_their_grids(spark):
    """the eight texts are those of the eight grids, also where a text is no grid."""
    rows = spark.createDataFrame([(t,) for t in ODD_TEXTS], "t string")
    slow = F.array(*[grids.grid_text(grids.symmetry(grids.parsed_grid(F.expr("try_cast(t as string)")), F.lit(code)), "") for code in grids.CODES])
    whole = rows.where("t is null or t rlike r'\\A[0-9]+(\\n[0-9]+)*\\z'")
    assert whole.count() == 6
    for r in whole.select("t", grids.symmetric_texts(F.col("t")).alias("got"), slow.alias("want"), grids.is_grid_text(F.col("t")).alias("even")).collect():
        assert (r["got"] or [None] * 8) == r["want"] and r["even"] == (r["t"] is not None and r["t"] != "12\n3"), r


@pytest.mark.parametrize("name", ["puzzle_text", "prediction_tokens", "solve_by_task", "run_metrics"])
def test_lines_are_shuffled_once_for_all_that_follows_by_task(spark, sf, name):
    """What is grouped or joined by task stays where its lines were dealt."""
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(spark, sf, name))
    assert dealt and all(d.startswith("dealt#") for d in dealt), dealt


@pytest.mark.parametrize("name", ["reasoning_prompts", "mixed_metadata", "prediction_lines", "rewrite_plan_props"])
def test_few_bytes_are_shuffled(spark, sf, name):
    """neither turned texts, candidates nor specifications are shuffled."""
    found = plan(spark, sf, name)
    dealt = [d for d in re.findall(r"Exchange (?:hashpartitioning|RoundRobinPartitioning)\(([^)]*)\)", found)]
    assert not [d for d in dealt if not re.match(r"(dealt|l_orderkey|task_id)#\d+L?, \d+$", d)], dealt
    assert not re.search(r"Exchange[^\n]*\n[^\n]*(__turned|specs)", found)


def test_one_symmetry_of_a_text(spark):
    """The text under a code, in any case, is that of the eight."""
    rows = spark.createDataFrame([(t, c) for t in ("123\n456", "7", "12\n34\n56") for c in [*grids.CODES, "r90", "XX"]], "t string, c string")
    for r in rows.select("c", grids.turned_text(F.col("t"), F.col("c")).alias("got"), grids.symmetric_texts(F.col("t")).alias("all"), grids.turned_texts(grids.parsed_grid(F.col("t"))).alias("of_grid")).collect():
        code = r["c"].upper()
        assert r["got"] == (r["all"][grids.CODES.index(code)] if code in grids.CODES else None) and r["all"] == r["of_grid"], r


def test_grids_of_completions_with_and_without_patterns(spark):
    """plain digits are taken without patterns and judged the same as beside white space that needs them."""
    texts = ["12\n34", "\n\n12\n34\n\n", "12\n\n34", "12\n3", "", "\n", "\n\n", "assistant\n12\n34\n", "assistant\n\n12", "assistant\n", "assistant", "ASSISTANT\n12", "1" * 31, "1\n" * 31, "12\r\n34", "12 \n34", "x\n12", "12\nx"]
    shown = lambda t: traces.predicted_grid(t)
    spaced = F.concat(F.lit("\t"), F.col("t"), F.lit("\t"))  # a blank at the ends keeps the patterns' way
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", shown(F.col("t")).alias("got"), shown(spaced).alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == []
    status = {r["t"]: r["got"]["status"] for r in rows}
    assert status["12\n34"] == status["\n\n12\n34\n\n"] == status["12\n\n34"] == status["ASSISTANT\n12"] == "ok" and status["assistant\n\n12"] == status["assistant\n"] == "no_leading_grid"
    assert status["12\n3"] == "ragged_grid" and status[""] == status["\n\n"] == "empty_output" and status["1" * 31] == "grid_too_wide" and status["1\n" * 31] == "grid_too_tall"


def test_ids_in_order_of_lines(spark, tmp_path):
    """blank lines have no place, files and lines give the order, and the texts aren't sorted."""
    for name, text in (("b.txt", '"t3.json"\n\n  \n{"task_id": "t4.json"}\n'), ("a.txt", '{"task_id": " t1 "}\n\t"t2"  \n{"task_id"\n')):
        (tmp_path / name).write_text(text)
    found = artifacts.read_ordered_ids(spark, str(tmp_path))
    assert sorted(((r["ordinal"], r["task_id"]) for r in found.collect())) == [(0, "t1"), (1, "t2"), (2, None), (3, "t3"), (4, "t4")]
    assert "FileScan text" not in found._jdf.queryExecution().executedPlan().toString()


def test_lines_of_packed_texts_are_encoded_once(spark):
    """lines that come again aren't searched for pieces or encoded again, and ids stay those of the whole text."""
    known, asked = queries_runs.ranked.__wrapped__(), []
    encode = known.encode
    known.encode = lambda text: asked.append(text) or encode(text)
    growing, text = external.Growing(known), ""
    for k in range(40):
        part = f"{chat.USER}12{k % 4}\n34\n\n \n5{chat.END}{chat.ASSISTANT}6{chat.END}"
        assert growing.offered(part) == len(encode(text + part))
        growing.take()
        text += part
    assert growing.ids() == encode(text) and len(asked) < 20


def test_spans_are_found_in_python_as_by_expressions(spark):
    """the same spans and status, also of ids that are no conversation."""
    known = queries_runs.ranked()
    turn = lambda u, a: f"{chat.USER}{u}{chat.END}{chat.ASSISTANT}{a}{chat.END}"
    texts = [("", 0), ("", 1), (turn("1", "2"), 1), (turn("1", "2") * 3, 3), (turn("1", "2") * 3, 2), (turn("1", "2"), 2), (turn("1", ""), 1), (chat.USER + "1", 1), (chat.USER + "1" + chat.END, 1), (chat.USER + "1" + chat.END + chat.ASSISTANT + "2", 1), ("x" + turn("1", "2") + "y", 1)]
    rows = [(known.encode(t), n) for t, n in texts] + [([1, -1], 1), ([10**7], 0), ([10**7 - 1], 0)]
    found = tokens.spans_finder(known.encode)
    df = spark.createDataFrame(rows, "ids array<int>, n int")
    scan = tokens.scanned_spans(F.lit(None).cast("string"), F.col("ids"), F.col("n"), F.lit(False), tokens.from_loader(queries_runs.ranked))
    for r in df.select("ids", "n", scan.alias("s")).collect():
        assert found(r["ids"], r["n"]) == ([tuple(x) for x in r["s"]["spans"]], r["s"]["status"])


def test_turned_texts_are_not_shuffled_to_be_packed(spark, sf):
    """tasks are dealt as they are, and what is found of a record isn't searched for again in the JVM."""
    found = plan(spark, sf, "external_split")
    dealt = re.search(r"Exchange RoundRobinPartitioning\(\d+\)[^\n]*\n([^\n]*)", found)[1]
    assert "MapInArrow" in found and "turned" not in dealt and "__scan" not in found and "reverse" not in dealt


def test_a_plan_is_not_joined_with_itself(spark, sf):
    """views have their guidance when records are made; no table of views is broadcast or sorted to meet it by number."""
    assert not re.search(r"Join \[task_id#\d+, variant_index#\d+\]", plan(spark, sf, "planned_records"))


def test_spans_of_plain_texts_are_those_of_a_scan(spark):
    """lengths say the same as a scan for markers, and texts that could hold a marker are scanned."""
    sides = [("1", "2"), ("12\n3", "é"), ("", "7"), ("1", ""), ("<", "2"), ("1", f"2{chat.END}3"), (f"1{chat.END}", "2"), (None, "2"), ("1", None)]
    told = [None, "", "say", "a < b", f"x{chat.END}y", f"漢{chat.USER}"]
    rows = [(i, [s] * n + [("1", "2")] * m, g) for i, (s, n, m, g) in enumerate((s, n, m, g) for s in sides for n in (0, 1, 2) for m in (0, 2) for g in told)] + [(-1, None, None)]
    df = spark.createDataFrame(rows, "i int, pairs array<struct<input:string,output:string>>, guidance string")
    text = chat.spoken(F.col("pairs"), F.col("guidance"), lambda t: t)
    for skip in (True, False):
        found = [{r["i"]: (r["assistant_spans"], r["target_token_count"], r["status"], r["sequence_length"]) for r in token_records.told_records(df, text, 150, skip, tokens.BYTES, texts=x).collect()} for x in (True, False)]
        assert found[0] == found[1] and {x[2] for x in found[0].values()} >= {"ok", "empty_target", "too_long", "too_few_pairs", "trailing"}
    assert df.where(chat.is_plain(F.col("pairs"), F.col("guidance"))).count() > 20


def test_keys_are_judged_by_their_parts(spark):
    """a key is made where taking it apart again would find the same parts."""
    cases = [(t, c, m, o) for t in ("a", "a_b", "", None) for c in ("ID", "r90", "XX", None) for m in ("1234567890", "1234", None) for o in ("10", "0,1", "11", "1_0", "", None)]
    df = spark.createDataFrame(cases, "t string, c string, m string, o string")
    key = F.concat_ws("_", "t", F.upper("c"), "m", "o")
    slow = F.when(~F.contains("t", F.lit("_")) & keys.is_augmented(key), key)
    rows = df.select(keys.made_key(F.col("t"), F.col("c"), F.col("m"), F.col("o")).alias("got"), slow.alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == [] and sum(r["got"] is not None for r in rows) == 4


def test_views_are_made_over_many_parts(spark, sf):
    """Tasks are dealt once before they become views, by an exchange that adaptive execution leaves as it is."""
    found = queries.rotated_plan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(task_id#\d+, \d+\), (\w+)", found) == ["REPARTITION_BY_NUM"]


def test_plan_lines_are_small_on_disk(spark, sf):
    """lines are written compressed, and keys are shuffled without the parts that are taken from them."""
    found = plan(spark, sf, "plan_lines")
    assert re.findall(r"Exchange hashpartitioning\((substring_index\(key#\d+, _, 1\)), \d+\)[^\n]*\n[^\n]*FileScan json \[key#\d+,at#\d+\]", found) and found.count("Exchange") == 1
    written = queries.QUERIES["plan_lines"](spark, sf)
    assert written.count() and all(f.endswith(".json.gz") for f in written.inputFiles())


def test_keys_that_are_no_keys_have_no_number(spark, tmp_path):
    """compressed lines are read like others, and a broken key stays without a number."""
    rows = spark.createDataFrame([("a_ID_0123456789_10", 3), ("a_ID_1234567890_10", 1), ("a_XX_0123456789_10", 2), ("b", 0)], "key string, at int")
    files.write_lines(rows, str(tmp_path / "x"), compression="gzip")
    back = files.read_lines(spark, str(tmp_path / "x"), "key string, at int")
    back = back.select("key", "at", F.substring_index("key", "_", 1).alias("task_id"), keys.parsed_key(F.col("key"))["code"].alias("code"))
    assert {r["key"]: r["variant_index"] for r in variants.renumbered(back).collect()} == {"a_ID_0123456789_10": 1, "a_ID_1234567890_10": 0, "a_XX_0123456789_10": None, "b": None}


@pytest.mark.parametrize("name", ["guidance_state", "missing_guidance", "planned_records"])
def test_guidance_is_met_by_task_alone(spark, sf, name):
    """F8: views meet guidance where they are also if nothing is small enough to be broadcast; none is shuffled by its key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(spark, sf, name))
        assert dealt and not [d for d in dealt if re.search(r"\b(status|key|variant_index)#", d)], dealt
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_guidance_by_task_is_that_of_a_join(spark):
    """F8: keys that come twice, come for no view or are null count as in a left join."""
    views = spark.createDataFrame([(t, k, c, m, "10") for t in ("a", "b", "c") for k, (c, m) in enumerate([("ID", "0123456789"), ("R90", "1234567890")])], "task_id string, variant_index int, code string, value_mapping string, order_mapping string")
    said = spark.createDataFrame([("a", "a_ID_0123456789_10", "x"), ("a", "a_ID_0123456789_10", "y"), ("a", None, "z"), ("b", "b_R90_1234567890_10", None), ("b", "b_none", "q"), ("d", "d", "r"), (None, "c_ID_0123456789_10", "n")], "task_id string, key string, guidance string")
    keyed = views.withColumn("key", variants.view_key())
    want = keyed.join(said, ["task_id", "key"], "left").select("key", "guidance")
    assert sorted(map(str, variants.met_by_task(keyed, said).select("key", "guidance").collect())) == sorted(map(str, want.collect()))
    left = keyed.join(said, ["task_id", "key"], "left_anti").select("key").collect()
    assert sorted(variants.missing_guidance(views, said).collect()) == sorted(left) and len(left) == 4


def test_plans_are_drawn_from_many_generators_at_once(monkeypatch):
    """the same draws as one generator after the other; few tasks are left to these, and those of long orders are whole."""
    left, slow = [], variants.task_plan
    monkeypatch.setattr(variants, "task_plan", lambda *a: left.append(a) or slow(*a))
    names = [f"o{k}" for k in range(300)]
    for n in (2, 6, 10, 11):
        left.clear()
        rows = variants.plans_of(names, n, 7).to_pylist()
        assert [(r["code"], v["value_mapping"], v["order_mapping"], v["variant_index"]) for r in rows for v in r["variants"]] == [v for t in names for v in slow(t, n, 7)]
        assert [r["task_id"] for r in rows[::8]] == names and len(left) < 30 or n == 11


def test_variants_are_not_shuffled_to_be_counted(spark, sf):
    """only tasks and eight counts a part are shuffled."""
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(spark, sf, "plan_rng_props"))
    assert dealt and not [d for d in dealt if "task_id" in d]


def test_rewrites_of_a_task_share_its_texts(spark, sf):
    """requests by a task's turned texts are those by grids, and views aren't shuffled or broadcast to meet what was tried."""
    pair = "struct<input:array<array<int>>,output:array<array<int>>>"
    tasks_ = spark.createDataFrame([("a", [([[1, 2], [3, 4]], [[5]]), ([[6, 7, 8]], [[9]])]), ("b", [([[1]], [[2]])])], f"task_id string, train array<{pair}>")
    specs = [(t, t, c, m, o, "neutral", k, "t") for t in "ab" for k, (c, m, o) in enumerate([("ID", "0123456789", "10"), ("r90", "1234567890", "01"), ("FD2", "9876543210", "0"), ("XX", "0123456789", "10"), ("FH", "12", "10"), ("FV", "0123456789", "7")])]
    rows = spark.createDataFrame(specs, "task_id string, source_request_id string, code string, value_mapping string, order_mapping string, style string, variant_index int, trace string")
    want = requests.rewrite_requests(rows.join(tasks_.withColumnRenamed("train", "pairs"), "task_id"))
    got = requests.rewrite_requests_of(rows, tasks_)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    used = spark.createDataFrame([("a", "a", "ID", "0123456789", "10"), ("b", "b", "ID", None, "10"), ("a", "b", "FD2", "9876543210", "0")], "task_id string, source_request_id string, code string, value_mapping string, order_mapping string")
    left = requests.new_augmentations(rows, used)
    assert left.columns == rows.columns and left.count() == len(specs) - 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(spark, sf, "rewrite_requests"))
        assert dealt and not [d for d in dealt if re.search(r"\b(code|source_request_id)#", d)], dealt
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
