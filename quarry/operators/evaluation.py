"""Datasets of an evaluation: answers checked against contracts, runs and judgments summed up."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import stats

RECORD = (
    "run_id string, strategy string, task_id string, package_id string, difficulty string, runtime string, status string, response_text string, duration_ms double, is_correct boolean, "
    "calls_started long, calls_completed long, calls_errored long, calls_unfinished long, call_details array<struct<call_id:string,status:string>>, skipped_reason string"
)
JUDGMENT = "task_id string, status string, skipped_reason string, baseline_correctness double, treatment_correctness double, baseline_actionability double, treatment_actionability double, preferred string, confidence string"


def first_object(text: str | None) -> str | None:
    """The first balanced ``{...}`` of a text; braces in strings don't count."""
    text = text or ""
    begin = text.find("{")
    depth, quoted, escaped = 0, False, False
    for k in range(begin, len(text)) if begin >= 0 else ():
        c = text[k]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[begin : k + 1]
    return None


def json_text(text: str | None) -> str | None:
    """The text if it is JSON, else its first object if that is, else the text."""
    for candidate in (text, first_object(text)):
        try:
            if candidate is not None:
                json.loads(candidate)
                return candidate
        except ValueError:
            pass
    return text


def first_object_of(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(first_object), "string")(c)


def json_text_of(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(json_text), "string")(c)


def contract_faults(c: Column, fields: Sequence[str], lists: Sequence[str] = ("declaration_paths",)) -> Column:
    """Names of what a JSON answer lacks: non-empty lists and texts; ``valid_json`` alone if it is none."""

    def check(s: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            try:
                raw = json.loads(json_text(text) or "")
            except ValueError:
                return ["valid_json"]
            if not isinstance(raw, dict):
                return ["valid_json"]
            return [k for k in lists if not (isinstance(raw.get(k), list) and raw[k])] + [k for k in fields if not isinstance(raw.get(k), str)]

        return s.map(one)

    return F.pandas_udf(check, "array<string>")(c)


def chosen(tasks: DataFrame, ids: Sequence[str] = (), difficulties: Sequence[str] = ()) -> DataFrame:
    """Tasks of some ids and difficulties, all if none are named; an id that no task has is an error."""
    if ids:
        known = {r.task_id for r in tasks.where(F.col("task_id").isin(*ids)).select("task_id").distinct().collect()}  # at most the ids asked for
        if odd := sorted(set(ids) - known):
            raise LookupError(f"no such task: {', '.join(odd)}")
        tasks = tasks.where(F.col("task_id").isin(*ids))
    return tasks.where(F.col("difficulty").isin(*difficulties)) if difficulties else tasks


def finalized(records: DataFrame) -> DataFrame:
    """Records with ``calls_unfinished`` filled in."""
    running = F.size(F.filter(F.coalesce("call_details", F.array().cast("array<struct<call_id:string,status:string>>")), lambda x: x["status"] == "running"))
    return records.withColumn("calls_unfinished", stats.unfinished_calls(F.col("calls_unfinished"), running.cast("long"), F.col("calls_started"), F.col("calls_completed"), F.col("calls_errored")))


def summary(records: DataFrame) -> DataFrame:
    """(grouping, group_key, ...) statistics by strategy, difficulty, task and package.

    Skipped runs count by task and by package, not by strategy and difficulty.
    """
    full = finalized(records).withColumn("details", F.size(F.coalesce("call_details", F.array().cast("array<struct<call_id:string,status:string>>"))))
    parts = []
    for grouping, skipped in (("strategy", False), ("difficulty", False), ("task_id", True), ("package_id", True)):
        rows = full if skipped else full.where(F.col("status") != "skipped")
        got = stats.group_stats(rows, [grouping], "duration_ms", F.col("is_correct"), ["calls_started", "calls_completed", "calls_errored", "calls_unfinished", "details"])
        parts.append(got.withColumnRenamed(grouping, "group_key").withColumn("grouping", F.lit(grouping)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pairwise_summary(judgments: DataFrame) -> DataFrame:
    """One row: pairs attempted, completed and skipped, mean deltas, wins on both dimensions, preferences, confidence."""
    done = F.col("status") == "completed"
    b, t = F.col("baseline_correctness"), F.col("treatment_correctness")
    ba, ta = F.col("baseline_actionability"), F.col("treatment_actionability")
    n = lambda c: F.count_if(done & c)
    mean = lambda c: F.coalesce(F.avg(F.when(done, c)), F.lit(0.0))
    return judgments.agg(
        F.count("*").alias("attempted"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        mean(t - b).alias("mean_delta_correctness"), mean(ta - ba).alias("mean_delta_actionability"),
        n(t > b).alias("correctness_treatment"), n(t < b).alias("correctness_baseline"), n(t == b).alias("correctness_tie"),
        n(ta > ba).alias("actionability_treatment"), n(ta < ba).alias("actionability_baseline"), n(ta == ba).alias("actionability_tie"),
        *[n(F.col("preferred") == p).alias(f"preferred_{p}") for p in ("treatment", "baseline", "tie")], *[n(F.col("confidence") == c).alias(f"confidence_{c}") for c in ("high", "medium", "low")],
    )


def skip_reasons(judgments: DataFrame) -> DataFrame:
    """Skipped pairs by reason."""
    return judgments.where("status = 'skipped'").groupBy(F.coalesce("skipped_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
