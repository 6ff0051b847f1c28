"""Votes of judges and decisions of reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import traces
from ..functions.text import is_blank, strip

VOTES = traces.VOTES


def judged(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Per source: pass and vote counts, requests whose answer isn't a verdict (they count as fail), and missing answers.

    requests: request_id, source_request_id, judge_index; results: request_id, raw_output.
    """
    rows = requests.join(results.select("request_id", "raw_output", F.lit(True).alias("answered")), "request_id", "left").withColumn("vote", traces.verdict(F.col("raw_output")))
    return rows.groupBy("source_request_id").agg(
        F.count_if(F.col("vote") == "pass").alias("pass_count"), F.count("*").alias("vote_count"), F.count_if(F.col("answered").isNull()).alias("missing"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("vote").isNull(), F.struct("judge_index", "request_id")))), lambda x: x["request_id"]).alias("parse_errors"),
    )


def unanimous(counts: DataFrame, votes: int = VOTES) -> DataFrame:
    """Accepted only if all of exactly ``votes`` judges pass it."""
    good = (F.col("vote_count") == votes) & (F.col("pass_count") == votes)
    return counts.withColumn("accepted", good).withColumn("route", F.lit("judge_5_of_5"))


def wrong_vote_counts(counts: DataFrame, votes: int = VOTES) -> DataFrame:
    return counts.where((F.col("vote_count") != votes) | (F.col("missing") > 0))


def reviewed(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Results (request_id, accepted, route) with manual decisions (request_id, decision, note) in place of the judges' where there is one."""
    manual = decisions.select("request_id", "decision", strip(F.col("note")).alias("note"))
    rows = results.join(manual, "request_id", "left")
    given = F.col("decision").isNotNull()
    return rows.withColumn("accepted", F.coalesce("decision", "accepted")).withColumn("route", F.when(given, "manual_review").otherwise(F.col("route"))).drop("decision")


def evaluated(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """Whole results (``schemas.RESULT``) of the sources that were judged, with the judges' decision and unreadable answers in their validation; all other fields stay."""
    decided = unanimous(counts).select(F.col("source_request_id").alias("request_id"), "accepted", "route", "pass_count", "vote_count", "parse_errors")
    return with_quality(sources.join(decided, "request_id"), F.lit(None).cast("string"), F.when(F.size("parse_errors") > 0, F.col("parse_errors")))


def with_quality(rows: DataFrame, note: Column, errors: Column) -> DataFrame:
    """Results with the columns of a decision put into their validation."""
    kinds = {f.name: f.dataType for f in rows.schema["validation"].dataType.fields}
    quality = F.struct("accepted", "route", F.col("pass_count").alias("pass_count"), F.col("vote_count").alias("vote_count"), note.alias("reviewer_note")).cast(kinds["quality"])
    validation = F.struct(F.col("validation.static").alias("static"), quality.alias("quality"), errors.alias("judge_parse_errors"))
    return rows.withColumn("validation", validation).drop("accepted", "route", "pass_count", "vote_count", "parse_errors")


def reviewed_results(sources: DataFrame, decisions: DataFrame) -> DataFrame:
    """Whole results, those with a decision (request_id, decision, note) with it in place of the judges'; all other fields stay."""
    manual = decisions.select("request_id", F.col("decision").alias("__decision"), strip(F.col("note")).alias("__note"))
    rows = sources.join(manual, "request_id", "left")
    given, old = F.col("__decision").isNotNull(), F.col("validation.quality")
    pick = lambda new, name: F.when(given, new).otherwise(old[name]).alias(name)
    none = F.lit(None)
    own = F.struct(pick(F.col("__decision"), "accepted"), pick(F.lit("manual_review"), "route"), pick(none, "pass_count"), pick(none, "vote_count"), pick(F.col("__note"), "reviewer_note"))
    validation = F.struct(F.col("validation.static").alias("static"), F.when(given | old.isNotNull(), own).alias("quality"), F.col("validation.judge_parse_errors").alias("judge_parse_errors"))
    return rows.withColumn("validation", F.when(given | F.col("validation").isNotNull(), validation)).drop("__decision", "__note")


def notes_missing(decisions: DataFrame) -> DataFrame:
    return decisions.where(is_blank(F.col("note")))


def normalised_answers(results: DataFrame) -> DataFrame:
    """Judges' answers with the same harmless drift undone as in traces."""
    return results.withColumn("normalized_output", traces.normalised(F.col("raw_output")))
