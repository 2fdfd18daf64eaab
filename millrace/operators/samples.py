"""Queries over the sample table: latest, history, trend, segments, positions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import fixed_values as fixed
from millrace.functions import freshness as fresh
from millrace.operators.assets import hierarchy
from millrace.operators.running import chunk_offsets, first_rows
from millrace.sources.tables import Tables



def newest_first() -> list[Column]:
    return [F.col("source_timestamp").desc(), F.col("id").desc()]


def from_source(samples: DataFrame, source: str) -> DataFrame:
    if source not in ("opcua", "file", "any"):
        raise ValueError(f"unknown source: {source}")
    return samples if source == "any" else samples.where(F.col("source_type") == source)


def latest(samples: DataFrame, keys: Sequence[str] = ("task_id", "tag_id")) -> DataFrame:
    """The newest sample of each group by (timestamp, id).

    ``max_by`` combines on the map side: each task sends one row per group, however many
    samples the group has.
    """
    rest = [c for c in samples.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("source_timestamp", "id"))
    return samples.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def latest_by_rank(samples: DataFrame, keys: Sequence[str] = ("task_id", "tag_id")) -> DataFrame:
    """The same result by ranking; Spark prunes each map task to one row per group."""
    ranked = samples.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*newest_first())))
    return ranked.where(F.col("_n") == 1).drop("_n")


def latest_task_values(t: Tables, task_id: int | None = None) -> DataFrame:
    """One row per enabled node with its newest live sample, null where there is none."""
    nodes = t.acquisition_node.where("is_enabled").drop("is_enabled")
    live = t.tag_sample.where(F.col("source_type") == "opcua")
    if task_id is not None:
        nodes = nodes.where(F.col("task_id") == task_id)
        live = live.where(F.col("task_id") == task_id)
    tag = t.tag.select(
        "tag_id", F.col("code").alias("tag_code"), F.col("name").alias("tag_name"),
        "data_type", "unit", "sampling_interval_ms",
    )
    found = latest(
        live.select(
            "task_id", "tag_id", "id", "value", "numeric_value", "source_timestamp",
            "server_timestamp", "received_at", "status_code", "is_good",
        )
    ).withColumnRenamed("id", "sample_id")
    return nodes.join(tag, "tag_id").join(found, ["task_id", "tag_id"], "left")


def latest_values(t: Tables, source: str, as_of: Column) -> DataFrame:
    """The newest value of every tag with its age, staleness, cautions and display text."""
    found = latest(
        from_source(t.tag_sample, source).select(
            "tag_id", "id", "source_type", "value", "source_timestamp", "status_code", "is_good"
        ),
        ["tag_id"],
    )
    tag = hierarchy(t).select("plant_id", "tag_id", "code", "name", "unit", "is_enabled", "sampling_interval_ms")
    age = fresh.seconds_between(as_of, F.col("source_timestamp"))
    stale = fresh.is_stale(age, F.col("sampling_interval_ms"))
    has = F.col("id").isNotNull()
    return tag.join(found, "tag_id", "left").select(
        "plant_id", "tag_id", "code", "name", "unit", F.col("is_enabled").alias("enabled"),
        fresh.stale_after_seconds(F.col("sampling_interval_ms")).alias("stale_after_seconds"),
        F.col("id").alias("sample_id"), "value", F.col("source_type").alias("source"),
        "source_timestamp", "is_good", "status_code",
        F.bround(age, 1).alias("age_seconds"),
        stale.alias("stale"),
        fresh.is_future(age).alias("future_timestamp"),
        F.when(has, fresh.age_text(age)).alias("age_text"),
        fresh.cautions(
            F.col("is_enabled"), has, F.col("is_good"), F.col("status_code"), stale,
            fresh.is_future(age), F.col("source_type"),
        ).alias("cautions"),
    )


READABLE_COLUMNS = (
    "sample_id", "source_type", "task_id", "task_name", "import_batch_id", "import_filename",
    "plant_id", "plant_code", "plant_name", "production_line_id", "production_line_code",
    "production_line_name", "device_id", "device_code", "device_name", "tag_id", "tag_code",
    "tag_name", "data_type", "unit", "sampling_interval_ms", "value", "numeric_value",
    "source_timestamp", "server_timestamp", "received_at", "status_code", "is_good",
)


def readable(t: Tables, live_only: bool = False) -> DataFrame:
    """Samples with every name spelled out: 28 columns, one row per sample.

    The dimensions are joined to each other first, so the fact table takes part in three
    joins only. ``live_only`` keeps samples of a task, the older form of the view.
    """
    task = t.acquisition_task.select("task_id", F.col("name").alias("task_name"))
    batch = t.import_batch.select(
        F.col("batch_id").alias("import_batch_id"), F.col("original_filename").alias("import_filename")
    )
    plant = t.plant.select(
        "plant_id", F.col("code").alias("plant_code"), F.col("name").alias("plant_name")
    )
    asset = hierarchy(t).join(plant, "plant_id").select(
        "plant_id", "plant_code", "plant_name", F.col("line_id").alias("production_line_id"),
        F.col("line_code").alias("production_line_code"),
        F.col("line_name").alias("production_line_name"), "device_id", "device_code",
        "device_name", "tag_id", F.col("code").alias("tag_code"), F.col("name").alias("tag_name"),
        "data_type", "unit", "sampling_interval_ms",
    )
    return (
        t.tag_sample.withColumnRenamed("id", "sample_id")
        .join(asset, "tag_id")
        .join(task, "task_id", "inner" if live_only else "left")
        .join(batch, "import_batch_id", "left")
        .select(*READABLE_COLUMNS)
    )


def history(
    t: Tables, tag_id: int, *, task_id: int | None = None, start: dt.datetime | None = None,
    end: dt.datetime | None = None, is_good: bool | None = None, limit: int = 1000,
) -> DataFrame:
    """The newest samples of one tag in time order, with the count of all that match."""
    if not 1 <= limit <= fixed.HISTORY_MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {fixed.HISTORY_MAX_LIMIT}")
    if start is not None and end is not None and start >= end:
        raise ValueError("start must be before end")
    hits = t.tag_sample.where(F.col("tag_id") == tag_id)
    if task_id is not None:
        hits = hits.where(F.col("task_id") == task_id)
    if start is not None:
        hits = hits.where(F.col("source_timestamp") >= F.lit(start))
    if end is not None:
        hits = hits.where(F.col("source_timestamp") <= F.lit(end))
    if is_good is not None:
        hits = hits.where(F.col("is_good") == is_good)
    total = hits.agg(F.count("*").alias("n"))
    newest = hits.orderBy(*newest_first()).limit(limit)
    return newest.withColumn("total_count", total.scalar()).orderBy("source_timestamp", "id")


def cross_plant_tasks(t: Tables, requests: DataFrame) -> DataFrame:
    """Requests ``(task_id, tag_id)`` whose task and tag lie in different plants."""
    task = t.acquisition_task.select("task_id", F.col("plant_id").alias("task_plant_id"))
    tag = hierarchy(t).select("tag_id", F.col("plant_id").alias("tag_plant_id"))
    return requests.join(task, "task_id").join(tag, "tag_id").where("task_plant_id <> tag_plant_id")


def history_pages(samples: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` samples of every tag, the tag's total, and its bad samples."""
    newest = first_rows(
        samples.select("id", "tag_id", "source_timestamp", "value", "numeric_value", "is_good"),
        ["tag_id"], newest_first(), limit, F.col("id"),
    )
    totals = samples.groupBy("tag_id").agg(
        F.count("*").alias("total_count"), F.count_if(~F.col("is_good")).alias("bad_count")
    )
    return newest.join(totals, "tag_id").withColumn("rank", F.col("rank").cast("long"))


def trend(
    t: Tables, as_of: Column, hours: int = 1, source: str = "opcua",
    limit: int | None = None,
) -> DataFrame:
    """Summary of the samples of every tag in the trailing window; of the newest ``limit`` only if given.

    Numbers use good numeric samples; the first and last times use every selected sample.
    """
    if not 1 <= hours <= fixed.TREND_MAX_HOURS:
        raise ValueError(f"hours must be between 1 and {fixed.TREND_MAX_HOURS}")
    start = F.timestamp_add("HOUR", F.lit(-hours), as_of)
    recent = from_source(t.tag_sample, source).where(F.col("source_timestamp").between(start, as_of))
    picked = recent.select("id", "tag_id", "source_timestamp", "numeric_value", "is_good")
    if limit is None:
        ranked, chosen = picked, F.lit(True)
    else:
        ranked = first_rows(picked, ["tag_id"], newest_first(), limit + 1, F.col("id"), rank="n")
        chosen = F.col("n") <= limit
    good = chosen & F.col("is_good") & F.col("numeric_value").isNotNull()
    number = F.when(good, F.col("numeric_value"))
    place = F.when(good, F.struct("source_timestamp", "id"))
    summary = ranked.groupBy("tag_id").agg(
        F.count_if(chosen).alias("sample_count"),
        F.count_if(~chosen).alias("_beyond"),
        F.count_if(chosen & ~F.col("is_good")).alias("bad_quality_count"),
        F.count(number).alias("good_numeric_count"),
        F.min(number).alias("minimum"),
        F.max(number).alias("maximum"),
        F.avg(number).alias("mean"),
        F.max_by(number, place).alias("_last"),
        F.min_by(number, place).alias("_first"),
        F.min(F.when(chosen, F.col("source_timestamp"))).alias("first_timestamp"),
        F.max(F.when(chosen, F.col("source_timestamp"))).alias("last_timestamp"),
    )
    tag = hierarchy(t).select("tag_id", "code", "name", "unit", F.col("is_enabled").alias("enabled"), "plant_id")
    counts = ["sample_count", "bad_quality_count", "good_numeric_count"]
    return (
        tag.join(summary, "tag_id", "left")
        .na.fill(0, counts)
        .select(
            "plant_id", "tag_id", "code", "name", "unit", "enabled", *counts,
            F.coalesce(F.col("_beyond") > 0, F.lit(False)).alias("truncated"),
            "minimum", "maximum", "mean",
            F.when(F.col("good_numeric_count") > 1, F.col("_last") - F.col("_first"))
            .alias("first_to_last_change"),
            "first_timestamp", "last_timestamp",
            start.alias("window_start"), as_of.alias("window_end"),
        )
    )


def quality_segments(samples: DataFrame, keys: Sequence[str] = ("source_type", "tag_id")) -> DataFrame:
    """Runs of good samples between bad ones, in time order.

    A segment is numbered by the bad samples before it. The runs are cut inside hours
    first, and pieces of one run are then merged by their number.
    """
    hour = F.date_trunc("hour", "source_timestamp")
    bad = F.when(F.col("is_good"), 0).otherwise(1)
    inside = W.partitionBy(*keys, "_chunk").orderBy("source_timestamp", "id").rowsBetween(
        W.unboundedPreceding, 0
    )
    pieces = (
        samples.withColumn("_chunk", hour)
        .withColumn("_run", F.sum(bad).over(inside))
        .where("is_good")
        .groupBy(*keys, "_chunk", "_run")
        .agg(
            F.count("*").alias("points"),
            F.min("source_timestamp").alias("start_at"),
            F.max("source_timestamp").alias("end_at"),
        )
    )
    offsets = chunk_offsets(samples, keys, hour, bad).drop("_total")
    return (
        pieces.join(offsets, [*keys, "_chunk"])
        .groupBy(*keys, (F.col("_run") + F.col("_before")).alias("segment"))
        .agg(
            F.sum("points").alias("points"),
            F.min("start_at").alias("start_at"),
            F.max("end_at").alias("end_at"),
        )
    )


def plottable(samples: DataFrame) -> DataFrame:
    """Samples with a finite number and a valid time."""
    number = F.col("numeric_value")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return samples.where(finite & F.col("source_timestamp").isNotNull())


def series_positions(samples: DataFrame, keys: Sequence[str] = ("source_type", "tag_id")) -> DataFrame:
    """Relative place of each sample in its series, in time and in value.

    A series without extent in time sits at 0.5; a flat one uses a value span of 1. The
    bounds come from an aggregate, not a window, so a long series is not sorted.
    """
    shown = plottable(samples).select(*keys, "id", "source_timestamp", "numeric_value")
    bounds = shown.groupBy(*keys).agg(
        F.min("source_timestamp").alias("_t0"), F.max("source_timestamp").alias("_t1"),
        F.min("numeric_value").alias("_v0"), F.max("numeric_value").alias("_v1"),
    )
    span = F.col("_v1") - F.col("_v0")
    return shown.join(bounds, list(keys)).select(
        *keys, "id",
        F.when(F.col("_t0") == F.col("_t1"), F.lit(0.5)).otherwise(
            fresh.seconds_between(F.col("source_timestamp"), F.col("_t0"))
            / fresh.seconds_between(F.col("_t1"), F.col("_t0"))
        ).alias("time_position"),
        ((F.col("numeric_value") - F.col("_v0")) / F.when(span == 0, F.lit(1.0)).otherwise(span))
        .alias("value_position"),
    )


def frames_to_long(frames: DataFrame) -> DataFrame:
    """Frames ``(timestamp, values MAP, bad_codes ARRAY)`` to one row per tag and frame."""
    return frames.select("timestamp", "bad_codes", F.explode("values").alias("tag_code", "value")).select(
        "timestamp", "tag_code", "value",
        F.when(F.array_contains("bad_codes", F.col("tag_code")), "BadSensorFailure").otherwise("Good")
        .alias("quality_code"),
    )


def task_nodes(t: Tables) -> DataFrame:
    """Every task with its nodes and their tags; a task without nodes keeps one row.

    Rows stay flat. A nested list per task would gather all nodes of a task in one cell.
    """
    tag = t.tag.select("tag_id", F.col("code").alias("tag_code"), F.col("name").alias("tag_name"), "unit")
    node = t.acquisition_node.join(tag, "tag_id").withColumnRenamed("is_enabled", "node_enabled")
    return t.acquisition_task.select("task_id", F.col("name").alias("task_name")).join(node, "task_id", "left")
