"""Import batches, acquisition tasks and delivery: lists, totals, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import fixed_values as fixed
from millrace.functions.text import is_missing, lookup
from millrace.operators.assets import hierarchy
from millrace.operators.running import first_rows
from millrace.sources.tables import Tables

BATCH_COLUMNS = (
    "plant_id", "batch_id", "original_filename", "status", "total_rows", "accepted_rows",
    "rejected_rows", "duplicate_rows", "warning_rows", "issue_count", "stored_issue_count",
    "issues_truncated", "created_at",
)


def batch_view(batches: DataFrame) -> DataFrame:
    """Batches with a flag for whether their counters are final."""
    return batches.select(*BATCH_COLUMNS, (F.col("status") == "completed").alias("counts_final"))


def newest_batches(t: Tables, limit: int = 5) -> DataFrame:
    """The newest batches of every plant."""
    if not 1 <= limit <= 10:
        raise ValueError("limit must be between 1 and 10")
    ranked = first_rows(
        batch_view(t.import_batch), ["plant_id"],
        [F.col("created_at").desc(), F.col("batch_id").asc()], limit, F.col("batch_id"),
    )
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def inspect_batches(t: Tables, examples: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per batch: issue counts by type with advice, and the first issues as examples."""
    view = batch_view(t.import_batch)
    summary = t.data_quality_issue.groupBy("batch_id", "issue_type").agg(
        F.count("*").alias("type_count")
    )
    shown = first_rows(
        t.data_quality_issue, ["batch_id"], [F.col("row_number").asc(), F.col("id").asc()],
        examples, F.col("id"),
    ).select(
        "batch_id", F.col("rank").cast("long").alias("rank"), "row_number", "issue_type",
        "field_name", "message",
    )
    return (
        view.join(summary, "batch_id", "left").withColumn(
            "advice", lookup(fixed.ISSUE_ADVICE, F.col("issue_type"))
        ),
        shown,
    )


def issue_page(t: Tables, batch_id: int, offset: int = 0, limit: int = 200) -> DataFrame:
    """One page of a batch's issues by (row, id)."""
    rows = t.data_quality_issue.where(F.col("batch_id") == batch_id)
    return rows.orderBy("row_number", "id").offset(offset).limit(limit)


def issue_summary(t: Tables) -> DataFrame:
    """Stored issues by (batch, severity, type), with the batch's plant."""
    counts = t.data_quality_issue.groupBy("batch_id", "severity", "issue_type").agg(
        F.count("*").alias("issue_count")
    )
    return counts.join(t.import_batch.select("batch_id", "plant_id"), "batch_id")


def newest_jobs(t: Tables) -> DataFrame:
    """The newest job of every batch by (created, id)."""
    newest = F.max_by(F.struct("job_id", "status", "created_at"), F.struct("created_at", "job_id"))
    return t.import_job.groupBy("batch_id").agg(newest.alias("j")).select("batch_id", "j.*")


def batch_totals(t: Tables) -> DataFrame:
    return t.import_batch.groupBy("plant_id").agg(
        F.count("*").alias("batches"), F.sum("accepted_rows").alias("accepted_rows"),
        F.sum("rejected_rows").alias("rejected_rows"),
    )


def all_task_status(t: Tables) -> DataFrame:
    """Every task of every plant, with the columns of ``task_status``."""
    return _status(t.acquisition_task.withColumn("truncated", F.lit(False)))


def _status(tasks: DataFrame) -> DataFrame:
    return tasks.select(
        "plant_id", "task_id", "name", "desired_state", "connection_state",
        F.col("worker_heartbeat_at").alias("heartbeat_at"), "last_sample_at",
        F.col("samples_received").alias("received"), F.col("samples_written").alias("written"),
        F.col("dropped_count").alias("dropped"), F.col("duplicate_count").alias("duplicates"),
        F.col("error_count").alias("errors"), F.col("reconnect_count").alias("reconnects"),
        "truncated",
    )


def task_status(t: Tables, limit: int = 10) -> DataFrame:
    """The first tasks of every plant by (name, id), and whether there are more."""
    if not 1 <= limit <= 20:
        raise ValueError("limit must be between 1 and 20")
    probed = first_rows(
        t.acquisition_task, ["plant_id"], [F.col("name").asc(), F.col("task_id").asc()],
        limit + 1, F.col("task_id"),
    )
    more = F.max("rank").over(W.partitionBy("plant_id")) > limit
    return _status(probed.withColumn("truncated", more).where(F.col("rank") <= limit))


def fleet_totals(t: Tables) -> DataFrame:
    return t.acquisition_task.groupBy("plant_id").agg(
        F.count_if(F.col("desired_state") == "running").alias("running_tasks"),
        F.sum("samples_written").alias("samples_written"),
        F.sum("error_count").alias("error_count"),
        F.sum("dropped_count").alias("dropped_count"),
    )


def counter_differences(t: Tables) -> DataFrame:
    """Counters of each task beside the rows that the fact table really holds."""
    rows = (
        t.tag_sample.where(F.col("source_type") == "opcua").groupBy("task_id")
        .agg(F.count("*").alias("stored_rows"))
    )
    joined = t.acquisition_task.select("task_id", "samples_written").join(rows, "task_id", "left")
    stored = F.coalesce("stored_rows", F.lit(0))
    return joined.select(
        "task_id", "samples_written", stored.alias("stored_rows"),
        (stored - F.col("samples_written")).alias("difference"),
    )


def documents_per_plant(t: Tables, limit: int = fixed.DOCUMENTS_PER_PLANT) -> DataFrame:
    counts = t.knowledge_document.groupBy("plant_id").agg(F.count("*").alias("document_count"))
    return counts.withColumn("at_limit", F.col("document_count") >= limit)


def audit_node_mappings(proposed: DataFrame, t: Tables) -> DataFrame:
    """Verdict on proposed ``(mapping_id, task_id, tag_id, node_id)`` rows.

    Repeats are counted by aggregates that combine on the map side and joined back, so a
    tag proposed very often does not gather in one task.
    """
    node = F.btrim("node_id")
    rows = proposed.withColumn("node_id", node)
    tag_use = rows.groupBy("task_id", "tag_id").agg(F.count("*").alias("_tag_uses"))
    node_use = rows.groupBy("task_id", "node_id").agg(F.count("*").alias("_node_uses"))
    asset = hierarchy(t).select(
        "tag_id", F.col("plant_id").alias("_tag_plant"), "is_enabled", "device_status", "line_status"
    )
    task = t.acquisition_task.select("task_id", F.col("plant_id").alias("_task_plant"))
    verdict = (
        F.when(F.col("_tag_uses") > 1, "tag_repeated")
        .when(F.col("_node_uses") > 1, "node_repeated")
        .when(is_missing(F.col("node_id")), "node_blank")
        .when(F.col("_tag_plant").isNull(), "tag_unknown")
        .when(F.col("_tag_plant") != F.col("_task_plant"), "other_plant")
        .when(~F.col("is_enabled"), "tag_disabled")
        .when((F.col("device_status") == "inactive") | (F.col("line_status") == "inactive"), "asset_inactive")
        .otherwise("ok")
    )
    return (
        rows.join(tag_use, ["task_id", "tag_id"])
        .join(node_use, ["task_id", "node_id"])
        .join(asset, "tag_id", "left")
        .join(task, "task_id", "left")
        .select("mapping_id", "task_id", "tag_id", "node_id", verdict.alias("verdict"))
    )


def startable_tasks(t: Tables) -> DataFrame:
    """Whether each task may start, and if not, why."""
    asset = hierarchy(t).select("tag_id", "is_enabled", "device_status", "line_status")
    usable = F.col("is_enabled") & (F.col("device_status") != "inactive") & (F.col("line_status") != "inactive")
    nodes = (
        t.acquisition_node.where("is_enabled").select("task_id", "tag_id")
        .join(asset, "tag_id")
        .groupBy("task_id")
        .agg(F.count("*").alias("_nodes"), F.count_if(~usable).alias("_unusable"))
    )
    plant = t.plant.select("plant_id", F.col("status").alias("plant_status"))
    verdict = (
        F.when(F.col("plant_status") == "inactive", "plant_inactive")
        .when(F.coalesce("_nodes", F.lit(0)) == 0, "no_enabled_nodes")
        .when(F.col("_unusable") > 0, "asset_inactive")
        .otherwise("ok")
    )
    return (
        t.acquisition_task.select("task_id", "plant_id")
        .join(plant, "plant_id")
        .join(nodes, "task_id", "left")
        .select("task_id", verdict.alias("verdict"))
    )


def delivery_audit(
    snapshots: DataFrame, node_counts: DataFrame, interval_ms: int, poll_seconds: int
) -> DataFrame:
    """Compare each task's first and last snapshot with what its nodes should deliver.

    ``snapshots`` holds ``(task_id, taken_at, connection_state, <counters>, sample_rows,
    heartbeat_age_seconds)``. The first snapshot is the start, the later ones are polls.
    """
    counters = (
        "samples_received", "samples_written", "duplicate_count", "dropped_count", "error_count",
        "reconnect_count", "sample_rows",
    )
    ends = snapshots.groupBy("task_id").agg(
        F.min("taken_at").alias("started_at"), F.max("taken_at").alias("finished_at"),
        F.max_by("connection_state", "taken_at").alias("final_state"),
        *[(F.max_by(c, "taken_at") - F.min_by(c, "taken_at")).alias(f"{c}_delta") for c in counters],
    )
    start = ends.select("task_id", "started_at")
    polls = (
        snapshots.join(start, "task_id")
        .where(F.col("taken_at") > F.col("started_at"))
        .groupBy("task_id")
        .agg(
            F.count("*").alias("polls"),
            F.count_if(F.col("connection_state") != "connected").alias("non_connected_polls"),
            F.max(F.coalesce("heartbeat_age_seconds", F.lit(0.0))).alias("max_heartbeat_age_seconds"),
        )
    )
    elapsed = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1_000_000.0)
    expected = elapsed * 1000 / interval_ms * F.col("node_count")
    written = F.col("samples_written_delta")
    ratio = F.coalesce(F.try_divide(written, expected), F.lit(0.0))
    low, high = fixed.DELIVERY_RATIO
    passed = (
        (F.col("final_state") == "connected")
        & (F.col("error_count_delta") == 0)
        & (F.col("dropped_count_delta") == 0)
        & (F.col("duplicate_count_delta") == 0)
        & (F.col("sample_rows_delta") == written)
        & (F.coalesce("non_connected_polls", F.lit(0)) == 0)
        & ratio.between(low, high)
        & (F.coalesce("max_heartbeat_age_seconds", F.lit(0.0))
           <= max(poll_seconds * 2, fixed.HEARTBEAT_FLOOR_SECONDS))
    )
    return (
        ends.join(polls, "task_id", "left")
        .join(node_counts, "task_id")
        .select(
            "task_id", "node_count", F.round(elapsed, 3).alias("elapsed_seconds"), "final_state",
            F.bround(expected, 0).cast("long").alias("expected_samples"),
            F.col("samples_received_delta").alias("received_delta"), written.alias("written_delta"),
            F.col("sample_rows_delta").alias("row_delta"),
            F.round(F.try_divide(written, elapsed), 3).alias("rows_per_second"),
            F.round(ratio, 6).alias("delivery_ratio"),
            F.greatest(F.bround(expected - written, 0), F.lit(0.0)).cast("long").alias("missing_samples"),
            F.col("duplicate_count_delta").alias("duplicate_delta"),
            F.col("dropped_count_delta").alias("dropped_delta"),
            F.col("error_count_delta").alias("error_delta"),
            F.col("reconnect_count_delta").alias("reconnect_delta"),
            F.coalesce("non_connected_polls", F.lit(0)).alias("non_connected_polls"),
            F.round(F.coalesce("max_heartbeat_age_seconds", F.lit(0.0)), 3).alias("max_heartbeat_age_seconds"),
            passed.alias("passed"),
        )
    )


def state_histogram(snapshots: DataFrame) -> DataFrame:
    """Polls per task and connection state. The first snapshot is the start, not a poll."""
    start = snapshots.groupBy("task_id").agg(F.min("taken_at").alias("_start"))
    polls = snapshots.join(start, "task_id").where(F.col("taken_at") > F.col("_start"))
    return polls.groupBy("task_id", "connection_state").agg(F.count("*").alias("polls"))


def reconcile_states(desired: DataFrame, observed: DataFrame) -> DataFrame:
    """What a supervisor should do about each task.

    ``desired`` is ``(task_id, desired_state, connection_state)``; ``observed`` holds the
    ids of tasks that run now. A stale state is repaired only once nothing runs.
    """
    owned = observed.select("task_id").distinct().withColumn("_owned", F.lit(True))
    running = F.col("desired_state") == "running"
    has = F.coalesce("_owned", F.lit(False))
    action = (
        F.when(has & ~F.coalesce(running, F.lit(False)), "stop")
        .when(running & ~has, "start")
        .when((F.col("desired_state") == "stopped") & (F.col("connection_state") != "stopped") & ~has,
              "repair")
        .otherwise("keep")
    )
    return desired.join(owned, "task_id", "full_outer").select(
        "task_id", "desired_state", "connection_state", has.alias("owned"), action.alias("action")
    )


def guarded_states(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """The newest reported state of each task that its desired state admits.

    A late report of a running connection must not overwrite a stop, nor the other way
    round. ``events`` is ``(task_id, seq, reported_at, state)``.
    """
    admitted = (F.col("desired_state") == "stopped") == (F.col("state") == "stopped")
    joined = events.join(tasks.select("task_id", "desired_state"), "task_id")
    position = F.struct("reported_at", "seq")
    return joined.groupBy("task_id", "desired_state").agg(
        F.max_by(F.when(admitted, F.col("state")), F.when(admitted, position)).alias("connection_state"),
        F.count_if(admitted).alias("admitted_events"),
        F.count_if(~admitted).alias("rejected_events"),
    )
