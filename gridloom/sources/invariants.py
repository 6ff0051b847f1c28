"""What a record must be: rules that become one expression, which names everything that is wrong with a row.

A rule states a field of a JSON record by its path, the kind of its value, whether it must be there, and a condition.
Rules are compiled to a column of violations over a variant, so that
a file is checked in one pass, without Python, and a record with five faults shows five.  ``[]`` in a path stands
for every entry of a list.  Fields of known objects that no rule names are ``unknown``; objects
that are ``open`` may have any.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import CODES, let
from ..functions.text import is_blank
from .artifacts import numbered_lines

Check = Callable[[Column], Column]
#: SQL type of a kind of value, and the starts of the names that variants give it.
KINDS = {
    "text": ("string", ("STRING",)), "whole": ("bigint", ("BIGINT",)), "number": ("double", ("BIGINT", "DECIMAL", "DOUBLE")), "flag": ("boolean", ("BOOLEAN",)),
    "object": ("map<string,variant>", ("OBJECT",)), "list": ("array<variant>", ("ARRAY",)),
}


@dataclass(frozen=True)
class Rule:
    path: str
    kind: str
    required: bool = False
    holds: Check | None = None
    says: str = "invalid"
    #: An object with any fields.
    open: bool = False


def given(check: Check, says: str, *rules: Rule) -> tuple[Rule, ...]:
    """Rules with a condition in common."""
    return tuple(Rule(r.path, r.kind, r.required, check, says, r.open) for r in rules)


filled = lambda c: ~is_blank(c)
natural = lambda c: c >= 0
one_of = lambda *values: lambda c: c.isin(*values)

STAGES, MODES, ROLES = ("initial", "judge", "rewrite"), ("provided", "none"), ("system", "user", "assistant")
SAMPLING = (
    Rule("sampling", "object"), Rule("sampling.temperature", "number", False, natural, "negative"), Rule("sampling.top_p", "number", False, lambda c: (c > 0) & (c <= 1), "out_of_range"),
    Rule("sampling.max_tokens", "whole", False, lambda c: c > 0, "not_positive"), Rule("sampling.seed", "whole"), Rule("sampling.use_provider_defaults", "flag"),
)
AUGMENTATION = (
    Rule("augmentation", "object"), Rule("augmentation.source_trace_id", "text", True, filled, "blank"), Rule("augmentation.transformation_code", "text", True, one_of(*CODES), "unknown_value"),
    Rule("augmentation.value_mapping", "text", True), Rule("augmentation.order_mapping", "text", True), Rule("augmentation.style", "text", False, filled, "blank"),
    Rule("augmentation.variant_index", "whole", False, natural, "negative"),
)
IDENTITY = (Rule("request_id", "text", True, filled, "blank"), Rule("task_id", "text", True, filled, "blank"), Rule("stage", "text", True, one_of(*STAGES), "unknown_value"))
SHARED = (Rule("hint_mode", "text", False, one_of(*MODES), "unknown_value"), Rule("few_shot_task_ids", "list"), Rule("few_shot_task_ids[]", "text"), Rule("metadata", "object", open=True))
#: Rules of requests and results.
REQUEST = (
    *IDENTITY, *SHARED, *SAMPLING, *AUGMENTATION, Rule("prompt_version", "text", True, filled, "blank"), Rule("messages", "list", True, lambda c: F.size(c) > 0, "empty"), Rule("messages[]", "object"),
    Rule("messages[].role", "text", True, one_of(*ROLES), "unknown_value"), Rule("messages[].content", "text", True, filled, "blank"),
)
RESULT = (
    *IDENTITY, *SHARED, *SAMPLING, *AUGMENTATION, Rule("prompt_version", "text"), Rule("backend", "text", True), Rule("model", "text", True), Rule("raw_output", "text"), Rule("normalized_output", "text"),
    Rule("finish_reason", "text"), Rule("error", "text"), Rule("validation", "object", open=True), Rule("usage", "object"), Rule("usage.prompt_tokens", "whole", False, natural, "negative"),
    Rule("usage.completion_tokens", "whole", False, natural, "negative"), Rule("usage.total_tokens", "whole", False, natural, "negative"),
)


def there(value: Column) -> Column:
    return value.isNotNull() & (F.schema_of_variant(value) != "VOID")


def faults(rule: Rule, value: Column) -> Column:
    """The violations of a rule by one value (a variant that may be missing), as an array."""
    kind, names = KINDS[rule.kind]
    shape = F.schema_of_variant(value)
    fits = F.lit(False)
    for n in names:
        fits = fits | F.startswith(shape, F.lit(n))
    said = lambda what: F.array(F.lit(f"{what}:{rule.path}"))
    none = F.array().cast("array<string>")
    held = none if rule.holds is None else F.when(F.coalesce(rule.holds(F.try_variant_get(value, "$", kind)), F.lit(False)), none).otherwise(said(rule.says))
    return F.when(~there(value), said("missing") if rule.required else none).when(~fits, said("kind")).otherwise(held)


def violations(record: Column, rules: tuple[Rule, ...]) -> Column:
    """Everything that is wrong with a variant: 'missing:path', 'kind:path', 'unknown:path' or what a rule says, sorted, each once."""

    def at(base: Column, name: str) -> Column:
        return F.try_variant_get(base, f"$.{name}", "variant")

    def entries(base: Column, name: str) -> Column:
        return F.coalesce(F.try_variant_get(base, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))

    def of(base: Column, prefix: str) -> list[Column]:
        """The violations in an object that is there; prefix: its path, with a dot."""
        own = [r for r in rules if r.path.startswith(prefix) and "." not in r.path[len(prefix) :]]
        out = []
        for r in own:
            name = r.path[len(prefix) :]
            below = any(x.path.startswith(f"{r.path}.") for x in rules)
            if name.endswith("[]"):
                out.append(F.flatten(F.transform(entries(base, name[:-2]), each(r, below))))
                continue
            out.append(faults(r, at(base, name)))
            if below and not r.open:
                out.append(F.when(is_object(at(base, name)), let(at(base, name), inner(r))).otherwise(none))
        names = sorted({r.path[len(prefix) :].removesuffix("[]") for r in own})
        keys = F.map_keys(F.try_variant_get(base, "$", "map<string,variant>"))
        out.append(F.transform(F.array_except(keys, F.array(*map(F.lit, names))), lambda k: F.concat(F.lit(f"unknown:{prefix}"), k)))
        return out

    def inner(rule: Rule) -> Check:
        return lambda value: F.concat(*of(value, f"{rule.path}."))

    def each(rule: Rule, below: bool) -> Check:
        return lambda value: F.concat(faults(rule, value), F.when(is_object(value), F.concat(*of(value, f"{rule.path}."))).otherwise(none)) if below else faults(rule, value)

    none = F.array().cast("array<string>")
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    found = let(record, lambda v: F.when(is_object(v), F.concat(*of(v, ""))).otherwise(F.array(F.lit("kind:record"))))
    return F.array_sort(F.array_distinct(found))


def checked_lines(spark: SparkSession, path: str, rules: tuple[Rule, ...], *more: tuple[str, Check]) -> DataFrame:
    """(file, line, record, violations) of JSON lines; lines that are no JSON have 'no_json'. more: a name and what must hold of the whole record."""
    rows = numbered_lines(spark, path).where(~is_blank(F.col("value")))
    record = F.try_parse_json("value")
    found = violations(F.col("record"), rules)
    for says, holds in more:
        found = F.concat(found, F.when(F.coalesce(holds(F.col("record")), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit(says))))
    rows = rows.select("file", "line", record.alias("record"))
    return rows.withColumn("violations", F.when(F.col("record").isNull(), F.array(F.lit("no_json"))).otherwise(found))


#: A rewrite states what it rewrites.
REWRITE = ("missing:augmentation", lambda r: (F.coalesce(F.try_variant_get(r, "$.stage", "string"), F.lit("")) != "rewrite") | there(F.try_variant_get(r, "$.augmentation", "variant")))


def bad_requests(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, violations) of requests that aren't sound."""
    return checked_lines(spark, path, REQUEST, REWRITE).where(F.size("violations") > 0).select("file", "line", "violations")


def bad_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, violations) of results that aren't sound."""
    return checked_lines(spark, path, RESULT).where(F.size("violations") > 0).select("file", "line", "violations")
