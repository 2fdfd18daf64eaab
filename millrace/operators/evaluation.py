"""Evaluation: retrieval metrics, latency, quotas, and audits of questions and answers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions import freshness as fresh
from millrace.functions import wording
from millrace.functions.text import lookup
from millrace.operators.running import first_rows, order_statistics


def retrieval_metrics(
    queries: DataFrame, evidence: DataFrame, required: DataFrame, limit: int = fixed.EVIDENCE_LIMIT
) -> DataFrame:
    """Recall, completeness and reciprocal rank per question, over distinct titles in order.

    Questions without required titles only say whether something was returned.
    """
    titles = evidence.groupBy("query_id", "title").agg(F.min("rank").alias("_best"))
    ranked = first_rows(
        titles, ["query_id"], [F.col("_best").asc(), F.col("title").asc()], limit, F.col("title"), "_place"
    )
    wanted = required.select("query_id", "title").distinct().withColumn("_wanted", F.lit(True))
    returned = ranked.join(wanted, ["query_id", "title"], "left").groupBy("query_id").agg(
        F.count("*").alias("returned_titles"),
        F.count_if("_wanted").alias("_hits"),
        F.min(F.when(F.col("_wanted"), F.col("_place"))).alias("_first"),
    )
    needed = wanted.groupBy("query_id").agg(F.count("*").alias("_needed"))
    asks = F.col("_needed").isNotNull()
    hits = F.coalesce("_hits", F.lit(0))
    return (
        queries.select("query_id")
        .join(returned, "query_id", "left")
        .join(needed, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("returned_titles", F.lit(0)).alias("returned_titles"),
            F.when(asks, hits / F.col("_needed")).alias("recall"),
            F.when(asks, hits == F.col("_needed")).alias("all_sources"),
            F.when(asks, F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("reciprocal_rank"),
            F.when(~asks, F.coalesce("returned_titles", F.lit(0)) > 0).alias("returned_on_unanswerable"),
        )
    )


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """Means over all questions, and the share of questions with at least one hit."""
    return metrics.agg(
        F.count("*").alias("questions"),
        F.avg("recall").alias("mean_recall"),
        F.avg(F.col("all_sources").cast("double")).alias("all_sources_rate"),
        F.avg("reciprocal_rank").alias("mean_reciprocal_rank"),
        F.avg((F.col("recall") > 0).cast("double")).alias("hit_rate"),
    )


def latency_percentiles(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, and the value that 19 of 20 runs do not exceed, exactly."""
    n = F.col("n")
    found = order_statistics(
        runs, keys, value,
        {
            "_low": F.floor((n - 1) / 2),
            "_high": F.floor(n / 2),
            "p95": F.ceil(n * 19 / 20) - 1,
        },
    )
    return found.select(
        *keys, F.col("n").alias("runs"), ((F.col("_low") + F.col("_high")) / 2).alias("median"), "p95"
    )


def run_quota(runs: DataFrame, as_of: Column, quota: int) -> DataFrame:
    """Runs of each user in the last minute, compared with a quota."""
    start = F.timestamp_add("SECOND", F.lit(-fixed.RUN_QUOTA_SECONDS), as_of)
    recent = runs.where(F.col("created_at") >= start)
    return recent.groupBy("user_id").agg(F.count("*").alias("recent_runs")).withColumn(
        "over_quota", F.col("recent_runs") >= quota
    )


def question_rules(questions: DataFrame, text: str = "question", requested: str | None = None) -> DataFrame:
    """Classify questions: the window they ask for, the operation, and the permit check."""
    window = questions.withColumn("_window", wording.trend_window(F.col(text)))
    result = window.withColumn("recognised", F.col("_window.recognised")).withColumn(
        "hours", F.when(F.col("_window.recognised"), F.col("_window.hours"))
    ).withColumn("blocked", F.when(F.col("_window.recognised"), F.col("_window.blocked")))
    result = result.withColumn("operation", wording.requested_operation(F.col(text)))
    if requested is not None:
        result = result.withColumn("permitted", wording.permits(F.col("_window"), F.col(requested)))
    return result.drop("_window")


def citation_audit(answers: DataFrame) -> DataFrame:
    """Cited ids must be among the evidence; an answered run must cite something.

    ``answers`` holds ``status``, ``citation_ids`` and ``evidence_ids`` arrays.
    """
    unknown = F.array_except("citation_ids", "evidence_ids")
    return answers.withColumn("unknown_citations", unknown).withColumn(
        "citations_valid",
        (F.size(unknown) == 0) & ((F.col("status") != "answered") | (F.size("citation_ids") > 0)),
    )


def stale_evidence(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Evidence whose document is gone or has another version now."""
    current = documents.select("document_id", F.col("version").alias("current_version"))
    joined = evidence.join(current, "document_id", "left")
    changed = F.col("current_version").isNull() | (F.col("current_version") != F.col("version"))
    return joined.where(changed)


def last_snapshots(evidence: DataFrame) -> DataFrame:
    """Keep the last snapshot per answer and title; all other evidence stays.

    ``evidence`` is ``(answer_id, position, title, ...)``.
    """
    snapshot = F.col("title").isin(*fixed.SNAPSHOT_TITLES)
    last = evidence.where(snapshot).groupBy("answer_id", "title").agg(F.max("position").alias("_last"))
    return evidence.join(last, ["answer_id", "title"], "left").where(
        ~snapshot | (F.col("position") == F.col("_last"))
    ).drop("_last")


def answer_audit(answers: DataFrame) -> DataFrame:
    """Wording checks of ``(status, answer, question, cited_text)`` rows."""
    sources = F.concat_ws("\n", "question", "cited_text")
    return (
        answers.withColumn("ambiguous", wording.conditional_conclusion(F.col("status"), F.col("answer")))
        .withColumn("problem", wording.grounding_problem(F.col("answer"), sources, F.col("cited_text")))
        .withColumn("final_status", wording.settled_status(F.col("status"), F.col("answer")))
    )


def ordered_calls_match(required: Column, calls: Column) -> Column:
    """Whether every required call occurs, in order, with its arguments and success.

    ``required`` is ``array<struct<name,args map>>`` and ``calls`` is
    ``array<struct<name,success,args map>>``. A cursor walks along the calls.
    """
    def fits(call: Column, wanted: Column) -> Column:
        same = F.forall(
            F.map_entries(wanted["args"]),
            lambda e: F.try_element_at(call["args"], e["key"]).eqNullSafe(e["value"]),
        )
        return (call["name"] == wanted["name"]) & F.coalesce(call["success"], F.lit(False)) & same

    def step(cursor: Column, wanted: Column) -> Column:
        places = F.transform(
            calls, lambda c, i: F.when((i >= cursor) & fits(c, wanted), i.cast("int"))
        )
        return F.when(cursor < 0, cursor).otherwise(F.coalesce(F.array_min(places) + 1, F.lit(-1)))

    return F.aggregate(required, F.lit(0), step) >= 0


def structure_scores(cases: DataFrame) -> DataFrame:
    """Check the shape of answered cases.

    Columns: ``status``, ``allowed_statuses``, ``required_calls``, ``calls``,
    ``forbidden_calls``, ``citation_ids``, ``evidence_ids``, ``required_titles``,
    ``cited_titles``, ``answer``, ``term_groups``, ``response_text``.
    """
    calls = F.col("calls")
    cites = F.col("citation_ids")
    checks = {
        "status_allowed": F.array_contains("allowed_statuses", F.col("status")),
        "required_calls_in_order": ordered_calls_match(F.col("required_calls"), calls),
        "forbidden_calls_absent": ~F.exists(
            calls, lambda c: F.array_contains("forbidden_calls", c["name"])
        ),
        "no_call_errors": F.forall(calls, lambda c: F.coalesce(c["success"], F.lit(False))),
        "citations_valid": (F.size(F.array_except(cites, F.col("evidence_ids"))) == 0)
        & ((F.col("status") != "answered") | (F.size(cites) > 0)),
        "required_documents_cited": F.size(F.array_except("required_titles", "cited_titles")) == 0,
        "reference_terms_present": F.forall(
            "term_groups", lambda g: F.exists(g, lambda term: F.contains(F.col("answer"), term))
        ),
        "canaries_absent": ~(
            F.contains("response_text", F.lit(fixed.CANARIES[0]))
            | F.contains("response_text", F.lit(fixed.CANARIES[1]))
        ),
    }
    scored = cases
    for name, check in checks.items():
        scored = scored.withColumn(name, F.coalesce(check, F.lit(False)))
    passed = F.forall(F.array(*checks), lambda ok: ok)
    return scored.withColumn("structural_pass", passed)


def _filled(template: str, *values: Column | str) -> Column:
    """A fixed sentence with its values; null if a value is missing."""
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return F.when(known, F.format_string(template, *columns))


def trend_facts(trends: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """The trend summary of each tag as display text; ``limit`` is that of the summary."""
    unit = F.coalesce("unit", F.lit(""))
    on, off = fixed.ENABLED_WORDS
    times = {name: fresh.local_time_text(F.col(name)) for name in ("window_start", "window_end", "first_timestamp", "last_timestamp")}
    head = _filled(
        fixed.TREND_HEAD_TEXT, "code", "name", F.lit(source), F.when(F.col("enabled"), on).otherwise(off),
        times["window_start"], times["window_end"], "sample_count", "good_numeric_count", "bad_quality_count",
    )
    cut = F.when(F.col("truncated"), fixed.TREND_CUT_TEXT.format(limit=limit)).otherwise("")
    change = F.coalesce(_filled(fixed.TREND_CHANGE_TEXT, "first_to_last_change", unit), F.lit(fixed.TREND_NO_CHANGE_TEXT))
    numbers = F.concat(
        _filled(fixed.TREND_NUMBERS_TEXT, "mean", unit, "minimum", unit, "maximum", unit), change,
        _filled(fixed.TREND_TIMES_TEXT, times["first_timestamp"], times["last_timestamp"]),
    )
    body = F.when(F.col("good_numeric_count") > 0, numbers).otherwise(fixed.TREND_NO_NUMBERS_TEXT)
    tail = fixed.TREND_TAIL_TEXT + (fixed.TREND_FILE_TEXT if source == "file" else "")
    return trends.select("plant_id", "tag_id", F.concat(head, cut, body, F.lit(tail)).alias("facts"))


def task_facts(status: DataFrame) -> DataFrame:
    """One display line per acquisition task of :func:`task_status`."""
    def state(name: str) -> Column:
        return lookup(fixed.STATE_WORDS, F.col(name), F.col(name))

    line = _filled(
        fixed.TASK_TEXT, "name", state("desired_state"), state("connection_state"),
        fresh.local_time_text(F.col("heartbeat_at")), fresh.local_time_text(F.col("last_sample_at")),
        "received", "written", "dropped", "duplicates", "errors", "reconnects",
    )
    return status.select("plant_id", "task_id", line.alias("facts"))


def device_facts(overview: DataFrame) -> DataFrame:
    """One display line per device of an asset overview."""
    line = _filled(fixed.DEVICE_TEXT, "line", "device", "device_tag_count")
    return overview.where(F.col("device_id").isNotNull()).select("plant_id", "device_id", line.alias("facts"))
