import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.functions import chat, grids, keys, schedules, text, traces
from gridloom.operators import requests


def column(spark, values, kind, body):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in rows.select("i", body(F.col("v")).alias("out")).orderBy("i").collect()]


GRID = [[1, 2, 3], [4, 5, 6]]
TURNED = {"ID": GRID, "R90": [[4, 1], [5, 2], [6, 3]], "R180": [[6, 5, 4], [3, 2, 1]], "R270": [[3, 6], [2, 5], [1, 4]], "FH": [[4, 5, 6], [1, 2, 3]], "FV": [[3, 2, 1], [6, 5, 4]], "FD1": [[1, 4], [2, 5], [3, 6]], "FD2": [[6, 3], [5, 2], [4, 1]]}


@pytest.mark.parametrize("code", grids.CODES)
def test_symmetries(spark, code):
    assert column(spark, [GRID], grids.GRID, lambda g: grids.symmetry(g, F.lit(code.lower()))) == [TURNED[code]]
    back = column(spark, [GRID, [[0]], [[9, 8]]], grids.GRID, lambda g: grids.restored(grids.augmented(g, F.lit(code), F.lit("2479185036")), F.lit(code), F.lit("2479185036")))
    assert back == [GRID, [[0]], [[9, 8]]]


def test_rotations_and_flips(spark):
    for k in range(-5, 6):
        assert column(spark, [GRID], grids.GRID, lambda g: grids.rotated(g, k)) == [TURNED[("ID", "R90", "R180", "R270")[k % 4]]]
    assert column(spark, [GRID], grids.GRID, lambda g: grids.flipped(g, "horizontal")) == [[[4, 5, 6], [1, 2, 3]]]


def test_invalid_grids_are_null(spark):
    bad = [[], [[]], [[1], [1, 2]], None]
    assert column(spark, bad, grids.GRID, grids.is_grid) == [False] * 4
    assert column(spark, bad, grids.GRID, lambda g: grids.symmetry(g, F.lit("R90"))) == [None] * 4
    assert column(spark, [[[10]], [[-1]], [[None]]], grids.GRID, lambda g: grids.remapped(g, F.lit(grids.IDENTITY))) == [None] * 3
    assert column(spark, [GRID], grids.GRID, lambda g: grids.symmetry(g, F.lit("R45"))) == [None]
    with pytest.raises(Exception, match="ragged"):
        column(spark, [[[1], [1, 2]]], grids.GRID, lambda g: grids.checked(grids.symmetry(g, F.lit("ID")), "ragged"))


def test_mappings(spark):
    assert column(spark, ["2479185036", "012345678", "0123456788", "012345678a", None], "string", grids.inverted) == ["".join(str("2479185036".index(str(v))) for v in range(10)), None, None, None, None]


def test_orders(spark):
    cases = {"210": [2, 1, 0], " 1,0 ": [1, 0], "0 , 1,2": [0, 1, 2], "1 0\t2": [1, 0, 2], "": None, " ": None, "0,2": None, "00": None, "1,a": None, "0,": None, ",": None, "10,9,8,7,6,5,4,3,2,1,0": list(range(10, -1, -1))}
    assert column(spark, list(cases), "string", keys.order_indices) == list(cases.values())


def test_texts(spark):
    assert column(spark, [GRID], grids.GRID, lambda g: grids.grid_text(g)) == ["1 2 3\n4 5 6"]
    pair = "array<struct<input:array<array<int>>,output:array<array<int>>>>"
    two = [{"input": [[1]], "output": [[2]]}, {"input": [[3]], "output": [[4]]}]
    assert column(spark, [two, []], pair, grids.examples_text) == ["Example 1\nInput:\n1\nOutput:\n2\n\nExample 2\nInput:\n3\nOutput:\n4", None]


# --- white space, traces and grids against plain Python ----------------------------------

BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　"


def test_strip_is_unicode(spark):
    values = [f"{b}x{b}y{b}" for b in BLANKS] + ["", BLANKS, "​x"]
    assert column(spark, values, "string", text.strip) == [v.strip() for v in values]


def plain_normalised(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub("[\xa0  ]", " ", t).strip()
    if t.startswith("```") and t.endswith("```") and len(t.splitlines()) >= 2:
        t = "\n".join(t.splitlines()[1:-1]).strip()
    for s in traces.SECTIONS:
        t = re.sub(rf"(?m)^\s*(?:\*\*|__)?\s*{re.escape(s)}\s*(?:\*\*|__)?\s*$", s, t)
    t = re.sub("(?m)^\\s*[•–—]\\s+", "- ", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", t)).strip()


def plain_accepted(t):
    at = [t.find(s) for s in traces.SECTIONS]
    return min(at) >= 0 and at == sorted(at) and all(t.count(s) == 1 for s in traces.SECTIONS) and t.startswith("<think>")


def fuzzed_traces(n, seed):
    rng, out = random.Random(seed), []
    pieces = ["\n", "\n\n\n", " ", "\r\n", "\xa0", " ", "\x85", "text", "• item", "- x", "**", "```", "\t", "1) INPUT ANALYSIS"]
    for _ in range(n):
        sections = list(traces.SECTIONS)
        if rng.random() < 0.2:
            i, j = rng.randrange(8), rng.randrange(8)
            sections[i], sections[j] = sections[j], sections[i]
        if rng.random() < 0.2:
            sections.pop(rng.randrange(8))
        body = "\n".join(rng.choice(["", "**", "__", "  "]) + s + rng.choice(["", "**", "__", "  "]) + "\n" + "".join(rng.choice(pieces) for _ in range(rng.randrange(3))) for s in sections)
        out.append(f"```\n{body}\n```" if rng.random() < 0.2 else body)
    return out


def test_traces_like_plain_python(spark):
    values = fuzzed_traces(1500, 1)
    got = column(spark, values, "string", traces.normalised)
    want = [plain_normalised(v) for v in values]
    assert got == want
    verdicts = [v["accepted"] for v in column(spark, values, "string", lambda v: traces.format_verdict(traces.normalised(v)))]
    assert verdicts == [plain_accepted(w) for w in want] and 100 < sum(verdicts) < 1400


def plain_grid(t):
    for m in traces.CHAT_MARKERS:
        t = t.replace(m, "")
    t = t.strip()
    if not t:
        return "empty_output", None
    lines = t.splitlines()
    if lines[0].strip().lower() == "assistant":
        lines = lines[1:]
    rows = []
    for line in lines:
        if not re.fullmatch("[0-9]+", line.strip()):
            break
        rows.append(line.strip())
    if not rows:
        return "no_leading_grid", None
    if len(rows) > 30:
        return "grid_too_tall", None
    if len(rows[0]) > 30:
        return "grid_too_wide", None
    if len({len(r) for r in rows}) > 1:
        return "ragged_grid", None
    return "ok", [[int(c) for c in r] for r in rows]


def test_grids_like_plain_python(spark):
    rng = random.Random(2)
    pieces = ["12", "34", "1", "5" * 31, "\n", "\r\n", "\x0b", " ", " ", "assistant\n", "ASSISTANT\n\n", "<|im_end|>", "<|im_start|>", "x", "12\n34\n", "7\n" * 31, "\xa0"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(4000)] + ["12\n3", "12\n34\n\nwhy", "", "assistant"]
    got = [(r["status"], r["grid"]) for r in column(spark, values, "string", traces.predicted_grid)]
    assert got == [plain_grid(v) for v in values]
    assert {s for s, _ in got} == {"ok", "empty_output", "no_leading_grid", "grid_too_tall", "grid_too_wide", "ragged_grid"}


def test_verdicts(spark):
    cases = {'{"verdict": "pass"}': "pass", '{"verdict": " FAIL "}': "fail", '{"verdict": "maybe"}': None, '{"verdict": 1}': None, '["pass"]': None, "pass": None, "": None, None: None, '{"x": 1}': None, '{"verdict": null}': None}
    assert column(spark, list(cases), "string", traces.verdict) == list(cases.values())


def test_guidance(spark):
    tail = "General natural language description:\na\nGeneral steps:\nb"
    cases = {f"<think></think>\n{tail} ": tail, f"</think>x</think>{tail}": tail, tail: None, "</think>  ": None, "</think>General steps:": None}
    assert column(spark, list(cases), "string", traces.guidance) == list(cases.values())
    assert column(spark, [tail, "no"], "string", traces.any_guidance) == [tail, None]


# --- conversations ------------------------------------------------------------------------

PAIRS = "array<struct<input:array<array<int>>,output:array<array<int>>>>"


def test_spans_like_a_scan(spark):
    rng, values = random.Random(3), []
    for _ in range(200):
        grid = lambda: [[rng.randrange(10) for _ in range(w)] for w in [rng.randrange(1, 5)] for _ in range(rng.randrange(1, 4))]
        values.append([{"input": grid(), "output": grid()} for _ in range(rng.randrange(0, 5))])
    for guidance in (None, "rule é"):
        g = F.lit(guidance).cast("string")
        texts = column(spark, values, PAIRS, lambda p: chat.conversation(p, g))
        spans = column(spark, values, PAIRS, lambda p: chat.assistant_spans(p, g))
        for t, s in zip(texts, spans):
            raw, at, found = t.encode(), 0, []
            while (k := raw.find(chat.ASSISTANT.encode(), at)) >= 0:
                start = k + len(chat.ASSISTANT)
                at = raw.find(chat.END.encode(), start)
                found.append((start, at))
            assert [(x["start"], x["end"]) for x in s] == found


def test_labels_and_padding(spark):
    ids = spark.createDataFrame([(list(range(10, 20)),)], "ids array<int>")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((2, 4), (6, 8))])
    n = chat.padded_length(F.size("ids"), 4)
    row = ids.select(chat.labels_in(F.col("ids"), spans, n, True).alias("a"), chat.padded(F.col("ids"), n, 0).alias("b"), chat.labels_from(F.col("ids"), F.lit(7), n).alias("c"), chat.attention_mask(F.col("ids"), n).alias("d"), chat.target_tokens(spans, True).alias("e")).first()
    assert row["a"] == [-100] * 6 + [16, 17] + [-100] * 4 and row["b"] == [*range(10, 20), 0, 0]
    assert row["c"] == [-100] * 7 + [17, 18, 19, -100, -100] and row["d"] == [1] * 10 + [0] * 2 and row["e"] == 2
    assert column(spark, ["aé", ""], "string", chat.byte_tokens) == [list("aé".encode()), []]


def test_schedules(spark):
    steps = spark.createDataFrame([(0,), (32,), (64,)], "s int")
    got = [r[0] for r in steps.select(schedules.adaptation_rate(F.col("s"), 64, 0.5, 0.0, 1.25e-4, 5e-6)).collect()]
    assert got == pytest.approx([0, 1.25e-4, 5e-6])
    assert column(spark, [624, 625], "int", lambda t: schedules.steps_per_epoch(t, 2, 8)) == [39, 40]


def test_request_id_is_the_digest_of_canonical_json(spark):
    import hashlib
    import json

    identity = {"temperature": 0.7, "task": "t1", "n": 3}
    want = hashlib.sha256(json.dumps({"stage": "initial", "task_id": "t1", "identity": identity}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    got = spark.range(1).select(requests.request_id(F.lit("initial"), F.lit("t1"), {k: F.lit(v) for k, v in identity.items()})).first()[0]
    assert got == f"initial-t1-{want}"
