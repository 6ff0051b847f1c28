"""Generation requests: prompts as message arrays, stable ids, provider formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grids, keys
from ..functions.text import sha256, strip
from . import corpus

MESSAGES = "array<struct<role:string,content:string>>"
#: Styles of a rewrite (fixed names, in order) and what each asks for.
STYLES = {
    "neutral": "Keep the wording plain.",
    "reflective": "Let the reasoning doubt and check itself as it goes.",
    "concise": "Say each thing once, in few words.",
    "analytical": "Name what stays the same in all examples, and what differs.",
    "elaborate": "Spell out every step and why it follows.",
}
#: The eight symmetries in words.
GEOMETRY = {
    "ID": "the layout stays as it is",
    "R90": "grids turn a quarter clockwise",
    "R180": "grids turn by half",
    "R270": "grids turn a quarter counterclockwise",
    "FH": "the order of rows is reversed",
    "FV": "each row is reversed",
    "FD1": "rows become columns",
    "FD2": "rows become columns, mirrored on the other diagonal",
}
CRITERIA = ("inputs", "outputs", "rule", "steps", "consistency", "generality", "format", "clarity")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def hint_text(hint: Column) -> Column:
    """A hint's five fields under their labels; null without a hint."""
    labels = {"General": "general", "Inputs": "inputs", "Outputs": "outputs", "Transformation": "transformation", "Transformation Steps": "transformation_steps"}
    lines = [x for label, name in labels.items() for x in (F.lit(f"{label}:"), strip(hint[name]))]
    return F.when(hint.isNotNull(), F.concat_ws("\n", *lines))


def initial_prompt(puzzle: Column, hint: Column, few_shots: Column) -> Column:
    """Puzzle text, hint text (or null) and few-shot texts as one prompt; its opening depends on whether there is a hint."""
    opening = F.when(hint.isNull(), "Find the rule that turns each input into its output.").otherwise("Find the rule that turns each input into its output. A hint is given; check it against the examples.")
    shots = F.when(F.size(few_shots) > 0, F.concat(F.lit("Worked examples:\n\n"), F.array_join(few_shots, "\n\n")))
    return F.concat_ws("\n\n", opening, shots, F.concat(F.lit("Hint:\n"), hint), F.concat(F.lit("Puzzle:\n"), puzzle))


def judge_prompt(puzzle: Column, trace: Column, hint: Column) -> Column:
    ask = f'Judge the reasoning by these criteria: {", ".join(CRITERIA)}. Answer with a JSON object whose "verdict" is "pass" or "fail".'
    return F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Hint:\n"), hint), F.concat(F.lit("Puzzle:\n"), puzzle), F.concat(F.lit("Reasoning:\n"), trace))


def augmentation_words(code: Column, mapping: Column, order: Column) -> Column:
    """An augmentation described in words."""
    geometry = F.create_map(*[F.lit(x) for pair in GEOMETRY.items() for x in pair])
    values = F.concat(F.lit("the colours 0 to 9 are painted as "), F.array_join(F.split(mapping, ""), " "))
    places = F.concat(F.lit("the examples now come in the order "), F.array_join(F.transform(keys.order_indices(order), lambda old: (old + 1).cast("string")), ", "), F.lit(" of the old ones"))
    return F.concat_ws("\n", F.concat(F.lit("Geometry: "), F.try_element_at(geometry, code), F.lit(".")), F.concat(F.lit("Colours: "), values, F.lit(".")), F.concat(F.lit("Order: "), places, F.lit(".")))


def rewrite_prompt(old: Column, trace: Column, new: Column, words: Column, style: Column) -> Column:
    styles = F.create_map(*[F.lit(x) for pair in STYLES.items() for x in pair])
    return F.concat_ws("\n\n", F.lit("Rewrite the reasoning so that it fits the changed puzzle."), F.try_element_at(styles, style), words, F.concat(F.lit("Old puzzle:\n"), old), F.concat(F.lit("Reasoning:\n"), trace), F.concat(F.lit("New puzzle:\n"), new))


def messages(system: str, prompt: Column) -> Column:
    return F.array(message("system", F.lit(system)), message("user", prompt))


def ascii_json(payload: Column) -> Column:
    """A JSON text with only ASCII in it: other code points and control characters as lower-case escapes, in surrogate pairs beyond U+FFFF."""
    unit = lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))

    def shown(c: Column) -> Column:
        point, above = F.ascii(c).cast("long"), F.ascii(c).cast("long") - 0x10000
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(above, 10)), unit(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))))
        known = F.when(F.startswith(c, F.lit("\\u")), F.lower(c)).when(point < 127, c)
        return known.when(point < 0x10000, unit(point)).otherwise(pair)

    parts = F.regexp_extract_all(payload, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\.|."), F.lit(0))
    return F.when(payload.rlike(r"[^\x00-\x7E]|\\u"), F.array_join(F.transform(parts, shown), "")).otherwise(payload)


def request_id(stage: Column, task: Column, identity: dict[str, Column]) -> Column:
    """``stage-task-`` and 16 hex digits of the SHA-256 of compact ASCII JSON with sorted keys. Fields must not be null."""
    inner = F.struct(*[c.alias(k) for k, c in sorted(identity.items())])
    payload = F.to_json(F.struct(inner.alias("identity"), stage.alias("stage"), task.alias("task_id")), {"ignoreNullFields": "false"})
    return F.concat_ws("-", stage, task, F.substring(sha256(ascii_json(payload)), 1, 16))


def provider_record(key: Column, chat: Column, temperature: Column, top_p: Column, max_tokens: Column, seed: Column) -> Column:
    """A batch line of the provider: assistant becomes model, system texts are joined, a seed only where one is set."""
    part = lambda m: F.struct(F.array(F.struct(m["content"].alias("text"))).alias("parts"), F.when(m["role"] == "assistant", "model").otherwise(m["role"]).alias("role"))
    system = F.filter(chat, lambda m: m["role"] == "system")
    spoken = F.when(F.size(system) > 0, F.struct(F.array(F.struct(F.array_join(F.transform(system, lambda m: m["content"]), "\n\n").alias("text"))).alias("parts")))
    config = F.struct(max_tokens.alias("maxOutputTokens"), seed.alias("seed"), temperature.alias("temperature"), top_p.alias("topP"))
    request = F.struct(F.transform(F.filter(chat, lambda m: m["role"] != "system"), part).alias("contents"), config.alias("generationConfig"), spoken.alias("systemInstruction"))
    return F.to_json(F.struct(key.alias("key"), request.alias("request")))


#: What is read of a provider's batch response, under either of two spellings.
RESPONSE = (
    "key string, error variant, response struct<candidates array<struct<content struct<parts array<struct<text string>>>, finishReason string, finish_reason string>>, "
    "usageMetadata struct<promptTokenCount bigint, prompt_token_count bigint, candidatesTokenCount bigint, candidates_token_count bigint>, "
    "usage_metadata struct<promptTokenCount bigint, prompt_token_count bigint, candidatesTokenCount bigint, candidates_token_count bigint>>"
)


def provider_error(error: Column) -> Column:
    """An error's message, else its status, else its JSON; a text as it is; null for none."""
    whole = F.when(F.startswith(F.schema_of_variant(error), F.lit("OBJECT")), F.to_json(error)).otherwise(F.try_variant_get(error, "$", "string"))
    return F.coalesce(F.try_variant_get(error, "$.message", "string"), F.try_variant_get(error, "$.status", "string"), whole)


def provider_result(line: Column) -> Column:
    """Key, text of the first candidate ('' if there is none), finish reason, usage and error of a response line."""
    said = F.from_json(line, RESPONSE)
    first = F.get(said["response"]["candidates"], F.lit(0))
    text = F.array_join(F.transform(first["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "")
    usage = F.coalesce(said["response"]["usageMetadata"], said["response"]["usage_metadata"])
    tokens = lambda a, b: F.coalesce(usage[a], usage[b], F.lit(0))
    return F.struct(
        said["key"].alias("key"),
        F.coalesce(text, F.lit("")).alias("raw_output"),
        F.coalesce(first["finishReason"], first["finish_reason"]).alias("finish_reason"),
        tokens("promptTokenCount", "prompt_token_count").alias("prompt_tokens"),
        tokens("candidatesTokenCount", "candidates_token_count").alias("completion_tokens"),
        provider_error(said["error"]).alias("error"),
    )


def imported(results: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results with the provenance of their requests, and the results whose key no request has (which are an error)."""
    return results.join(asked, results["key"] == asked["request_id"]).drop("key"), results.join(asked, results["key"] == asked["request_id"], "left_anti")


def initial_requests(tasks: DataFrame, candidates: int) -> DataFrame:
    """tasks: task_id, puzzle, hint, few_shots, few_shot_ids (and candidate, if these depend on it). One request per task and candidate."""
    rows = tasks if "candidate" in tasks.columns else tasks.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    rows = rows.withColumn("prompt", initial_prompt(F.col("puzzle"), F.col("hint"), F.col("few_shots")))
    identity = {"candidate": F.col("candidate"), "prompt_sha256": sha256(F.col("prompt"))}
    return rows.select(request_id(F.lit("initial"), F.col("task_id"), identity).alias("request_id"), "task_id", F.lit("initial").alias("stage"), "candidate", messages("You explain grid puzzles.", F.col("prompt")).alias("messages"), F.when(F.col("hint").isNull(), "unhinted").otherwise("hinted").alias("hint_mode"), "few_shot_ids")


def judge_requests(results: DataFrame, votes: int = 5, temperature: float = 0.7, top_p: float = 1.0, max_tokens: int = 2048, seed: int | None = None) -> DataFrame:
    """results: request_id, task_id, stage, error, accepted, trace, puzzle, hint. Requests for accepted initial results, one per vote; with a seed, each vote has its own: the seed and its number."""
    good = results.where((F.col("stage") == "initial") & F.col("error").isNull() & F.coalesce("accepted", F.lit(False)))
    rows = good.withColumn("judge_index", F.explode(F.sequence(F.lit(0), F.lit(votes - 1)))).withColumn("prompt", judge_prompt(F.col("puzzle"), F.col("trace"), F.col("hint")))
    identity = {"judge_index": F.col("judge_index"), "source_request_id": F.col("request_id")}
    own = F.lit(None).cast("long") if seed is None else (F.lit(seed) + F.col("judge_index")).cast("long")
    if seed is not None:
        identity["seed"] = own
    sampling = F.struct(F.lit(float(temperature)).alias("temperature"), F.lit(float(top_p)).alias("top_p"), F.lit(max_tokens).alias("max_tokens"), own.alias("seed"))
    asked = messages("You judge explanations of grid puzzles.", F.col("prompt")).alias("messages")
    return rows.select(request_id(F.lit("judge"), F.col("task_id"), identity).alias("request_id"), "task_id", F.lit("judge").alias("stage"), F.when(F.col("hint").isNull(), "none").otherwise("provided").alias("hint_mode"), F.col("request_id").alias("source_request_id"), "judge_index", sampling.alias("sampling"), asked)


def rewrite_requests(specs: DataFrame) -> DataFrame:
    """specs: source_request_id, task_id, pairs, trace, code, value_mapping, order_mapping, style, variant_index."""
    new = keys.augmented_pairs(F.col("pairs"), F.col("code"), F.col("value_mapping"), F.col("order_mapping"))
    return asked_rewrites(specs, grids.examples_text(F.col("pairs")), grids.examples_text(new))


def rewrite_requests_of(specs: DataFrame, tasks: DataFrame) -> DataFrame:
    """``rewrite_requests`` of many specifications a task, without their pairs; tasks: task_id, train (grids of digits). A task's puzzle and its turned grids are written once, and meet the specifications by task."""
    told = tasks.withColumn("__old", grids.examples_text(F.col("train")))
    rows = corpus.materialised_texts(specs, told, lambda grid: grids.turned_texts(grid, " "), "__old")
    return asked_rewrites(rows, F.col("__old"), grids.examples_text(F.col("pairs"), shown=lambda text: text))


def asked_rewrites(specs: DataFrame, old: Column, new: Column) -> DataFrame:
    words = augmentation_words(F.col("code"), F.col("value_mapping"), F.col("order_mapping"))
    prompt = rewrite_prompt(old, F.col("trace"), new, words, F.col("style"))
    identity = {c: F.col(c) for c in ("source_request_id", "code", "value_mapping", "order_mapping", "style", "variant_index")}
    return specs.select(request_id(F.lit("rewrite"), F.col("task_id"), identity).alias("request_id"), "task_id", *identity, messages("You rewrite explanations of grid puzzles.", prompt).alias("messages"))


def rendered(asked: DataFrame) -> DataFrame:
    """Each request's messages as one text."""
    return asked.select("request_id", F.array_join(F.transform("messages", lambda m: F.concat(F.lit("["), m["role"], F.lit("]\n"), m["content"])), "\n\n").alias("text"))


def new_augmentations(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """Planned augmentations whose signature was neither accepted nor attempted. Where ``used`` has its task_id, both meet by task alone, and what is dealt by task isn't shuffled by signature."""
    signature = ["source_request_id", "code", "value_mapping", "order_mapping"]
    if "task_id" not in used.columns:
        return wanted.join(used, signature, "left_anti")
    tried = used.dropna(subset=signature).groupBy("task_id").agg(F.collect_list(F.struct(*signature)).alias("__tried"))
    rows = wanted.join(tried.hint("shuffle_hash"), "task_id", "left")
    return rows.where(~F.coalesce(F.array_contains("__tried", F.struct(*signature)), F.lit(False))).drop("__tried")


def few_shot_block(task: Column, puzzle: Column, hint: Column, trace: Column) -> Column:
    """A worked example as text: its task, puzzle, hint (if there is one) and trace."""
    return F.concat_ws("\n\n", F.concat(F.lit("Worked task "), task), F.concat(F.lit("Puzzle:\n"), puzzle), F.concat(F.lit("Hint:\n"), hint), F.concat(F.lit("Reasoning:\n"), strip(trace)))


def with_few_shots(rows: DataFrame, chosen: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows, by task and candidate; chosen: task_id, candidate, few_shot_ids; blocks: task_id, block (a small pool). Adds few_shot_ids and few_shots, in the chosen order."""
    each = chosen.select("task_id", "candidate", F.posexplode("few_shot_ids").alias("at", "id"))
    found = each.join(blocks.select(F.col("task_id").alias("id"), "block"), "id")
    shots = found.groupBy("task_id", "candidate").agg(F.array_sort(F.collect_list(F.struct("at", "id", "block"))).alias("s"))
    shots = shots.select("task_id", "candidate", F.transform("s", lambda x: x["id"]).alias("few_shot_ids"), F.transform("s", lambda x: x["block"]).alias("few_shots"))
    return rows.join(shots, ["task_id", "candidate"], "left")


def chat_messages(asked: Column) -> Column:
    """Messages as a chat engine takes them: role and content, in order."""
    return F.transform(asked, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def rewrite_sources(results: DataFrame) -> DataFrame:
    """(source_id, task_id, trace) of results that hold by the format and by the judges or a reviewer."""
    sound = F.col("error").isNull() & (F.col("validation.static.accepted") == F.lit(True)) & (F.col("validation.quality.accepted") == F.lit(True))
    text = F.when(F.coalesce("normalized_output", F.lit("")) != "", F.col("normalized_output")).otherwise(F.col("raw_output"))
    return results.where(F.coalesce(sound, F.lit(False))).select(F.col("request_id").alias("source_id"), "task_id", text.alias("trace"))


def earlier_rewrites(asked: DataFrame, results: DataFrame) -> DataFrame:
    """Per source: how many earlier rewrites were accepted, the augmentations that were asked for (a few hundred at most) and the last number."""
    signature = F.struct(F.col("augmentation.transformation_code").alias("code"), F.col("augmentation.value_mapping").alias("value_mapping"), F.col("augmentation.order_mapping").alias("order_mapping"))
    accepted = results.where(F.col("error").isNull() & (F.col("validation.static.accepted") == F.lit(True))).select("request_id").distinct().withColumn("accepted", F.lit(1))
    rows = asked.where(F.col("augmentation").isNotNull()).join(accepted, "request_id", "left")
    rows = rows.groupBy(F.col("augmentation.source_trace_id").alias("source_id"))
    return rows.agg(F.count("accepted").alias("accepted"), F.collect_set(signature).alias("used"), F.max("augmentation.variant_index").alias("last_index"))


def planned_sources(sources: DataFrame, tasks: DataFrame, earlier: DataFrame) -> DataFrame:
    """Sources as ``variants.rewrite_plan`` takes them; those of unknown tasks are left out."""
    none = F.array().cast("array<struct<code:string,value_mapping:string,order_mapping:string>>")
    rows = sources.join(tasks.select("task_id", F.size("train").alias("n_pairs")), "task_id").join(earlier, "source_id", "left")
    return rows.select("source_id", "task_id", "n_pairs", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("used", none).alias("used"), F.coalesce("last_index", F.lit(-1)).alias("last_index"))
