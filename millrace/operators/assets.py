"""Asset hierarchy: joins, scope, listing, search and overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import fixed_values as fixed
from millrace.functions.text import contains_either, contains_folded, contains_literal
from millrace.operators.running import first_rows
from millrace.sources.tables import Tables


def hierarchy(t: Tables) -> DataFrame:
    """Every tag with its device, line and plant id.

    No join hint: the dimensions are broadcast while their files are small, and fall back
    to a sort-merge join beyond the threshold.
    """
    device = t.device.select(
        "device_id", "line_id", F.col("code").alias("device_code"),
        F.col("name").alias("device_name"), F.col("status").alias("device_status"), "device_type",
    )
    line = t.production_line.select(
        "line_id", "plant_id", F.col("code").alias("line_code"),
        F.col("name").alias("line_name"), F.col("status").alias("line_status"),
    )
    return t.tag.join(device, "device_id").join(line, "line_id")


def active_path(tags: DataFrame) -> DataFrame:
    """Tags that can be used: line and device active, tag enabled. Plants do not count."""
    return tags.where(
        (F.col("line_status") == "active") & (F.col("device_status") == "active") & F.col("is_enabled")
    )


def is_admin() -> Column:
    return F.col("is_superuser") | (F.col("role") == "admin")


def in_scope(df: DataFrame, plants: DataFrame | None) -> DataFrame:
    """Rows of the granted plants; ``None`` is an administrator, who skips the join."""
    return df if plants is None else df.join(plants, "plant_id", "left_semi")


def granted_plants(t: Tables, user_id: int, admin: bool) -> DataFrame | None:
    if admin:
        return None
    return t.user_plant_access.where(F.col("user_id") == user_id).select("plant_id").distinct()


def access_decisions(requests: DataFrame, t: Tables) -> DataFrame:
    """Classify ``(user_id, plant_id, write)`` requests.

    Administrators pass; a write needs the engineer role before the grant is looked at.
    """
    grants = t.user_plant_access.distinct().withColumn("_granted", F.lit(True))
    known = t.user.select("user_id", "role", "is_superuser")
    verdict = (
        F.when(F.coalesce(is_admin(), F.lit(False)), "allowed")
        .when(F.col("write") & ~F.coalesce(F.col("role") == "engineer", F.lit(False)), "denied_role")
        .when(F.col("_granted").isNull(), "denied_plant")
        .otherwise("allowed")
    )
    return (
        requests.join(known, "user_id", "left")
        .join(grants, ["user_id", "plant_id"], "left")
        .withColumn("decision", verdict)
        .drop("role", "is_superuser", "_granted")
    )


def missing_plants(requested: DataFrame, t: Tables) -> DataFrame:
    """Requested grants whose plant does not exist."""
    return requested.join(t.plant, "plant_id", "left_anti")


def mapping_options(t: Tables) -> DataFrame:
    """Tags that an import may map to, in every plant."""
    return active_path(hierarchy(t)).select(
        "plant_id", "tag_id", F.col("code").alias("tag_code"), F.col("name").alias("tag_name"),
        "device_id", "device_code", "device_name",
    )


def tags_by_plant(t: Tables) -> DataFrame:
    """Usable tags of active plants. One row per tag: a plant's tags may be many."""
    plants = t.plant.where(F.col("status") == "active").select("plant_id", F.col("code").alias("plant_code"))
    return active_path(hierarchy(t)).join(plants, "plant_id").select(
        "plant_code", "tag_id", F.col("code").alias("tag_code"), "device_code", "line_code"
    )


def with_parent_names(t: Tables) -> DataFrame:
    """Devices with the names of their line and plant; a missing parent shows null."""
    line = t.production_line.select("line_id", "plant_id", F.col("name").alias("line_name"))
    plant = t.plant.select("plant_id", F.col("name").alias("plant_name"))
    return t.device.join(line, "line_id", "left").join(plant, "plant_id", "left").select(
        "device_id", F.col("name").alias("device_name"), "line_name", "plant_name"
    )


def filter_assets(
    df: DataFrame, *, status: str | None = None, search: str | None = None,
    **equals: object,
) -> DataFrame:
    """Status, parent and type equality, and the case-insensitive search of asset lists."""
    if status is not None:
        df = df.where(F.col("status") == status)
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df if not search else df.where(contains_either(search, F.col("code"), F.col("name")))


def page(df: DataFrame, order: Sequence[str | Column], offset: int, limit: int) -> DataFrame:
    """One page of a list. ``order`` has to be total; the row count is a separate job."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(
    df: DataFrame, order: Sequence[str | Column], offset: int, limit: int
) -> DataFrame:
    """A page with the count of all matching rows, as a scalar subquery of the same plan."""
    total = df.agg(F.count("*").alias("total_count"))
    return page(df, order, offset, limit).withColumn("total_count", total.scalar())


def find_tags(t: Tables, query: str, limit: int = fixed.TAG_SEARCH_LIMIT) -> DataFrame:
    """Tags whose name, code or device name contains the text, per plant.

    The first ``limit`` by (code, id), and whether there were more: one extra row is probed.
    """
    if len(query) > 100:
        raise ValueError("the query may have at most 100 characters")
    hits = hierarchy(t).where(
        contains_literal(query, F.col("name"), F.col("code"), F.col("device_name"))
    )
    probed = first_rows(
        hits, ["plant_id"], [F.col("code").asc(), F.col("tag_id").asc()], limit + 1, F.col("tag_id")
    )
    more = F.max("rank").over(W.partitionBy("plant_id")) > limit
    return probed.withColumn("truncated", more).where(F.col("rank") <= limit).select(
        "plant_id", F.col("rank").cast("long").alias("rank"), "tag_id", "code", "name",
        F.col("device_name").alias("device"), "unit", F.col("is_enabled").alias("enabled"),
        "truncated",
    )


def search_nodes(t: Tables, query: str) -> DataFrame:
    """Case-folded search over tag code, tag name and node id."""
    return t.acquisition_node.join(t.tag.select("tag_id", "code", "name"), "tag_id").where(
        contains_folded(query, F.col("code"), F.col("name"), F.col("node_id"))
    )


def device_tag_counts(t: Tables) -> DataFrame:
    """Tags per device; a device without tags counts zero."""
    counts = t.tag.groupBy("device_id").agg(F.count("*").alias("tag_count"))
    line = t.production_line.select("line_id", "plant_id", F.col("name").alias("line"))
    return (
        t.device.join(line, "line_id")
        .join(counts, "device_id", "left")
        .select(
            "plant_id", "device_id", F.col("name").alias("device"), "line",
            F.coalesce("tag_count", F.lit(0)).alias("tag_count"),
        )
    )


def asset_totals(t: Tables) -> DataFrame:
    """Lines, devices and tags per plant. Parents without children keep their plant.

    Each level is counted on its own and added up, so that no row of a child table is
    multiplied and no distinct count is needed.
    """
    per_device = t.tag.groupBy("device_id").agg(F.count("*").alias("tags"))
    per_line = (
        t.device.join(per_device, "device_id", "left")
        .groupBy("line_id")
        .agg(F.count("*").alias("devices"), F.sum("tags").alias("tags"))
    )
    per_plant = (
        t.production_line.join(per_line, "line_id", "left")
        .groupBy("plant_id")
        .agg(F.count("*").alias("lines"), F.sum("devices").alias("devices"), F.sum("tags").alias("tags"))
    )
    return t.plant.select("plant_id").join(per_plant, "plant_id", "left").select(
        "plant_id",
        F.coalesce("lines", F.lit(0)).alias("line_count"),
        F.coalesce("devices", F.lit(0)).alias("device_count"),
        F.coalesce("tags", F.lit(0)).alias("tag_count"),
    )


def asset_overview(t: Tables, limit: int = fixed.DEVICE_LIST_LIMIT) -> DataFrame:
    """Totals of every plant with its first devices by id; plants without devices stay."""
    ranked = first_rows(
        device_tag_counts(t), ["plant_id"], [F.col("device_id").asc()], limit + 1, F.col("device_id")
    )
    shown = ranked.where(F.col("rank") <= limit).select(
        "plant_id", "device_id", "device", "line", F.col("tag_count").alias("device_tag_count")
    )
    totals = asset_totals(t)
    return totals.join(shown, "plant_id", "left").withColumn("truncated", F.col("device_count") > limit)


def dashboard(t: Tables) -> DataFrame:
    """The twelve counts and the newest sample time, per plant.

    The fact table is reduced to one row per tag by a map-side combine before it meets the
    hierarchy; every other count is one conditional pass over its table.
    """
    by_plant = ["plant_id"]
    line = t.production_line.select("line_id", "plant_id")
    lines = line.groupBy(*by_plant).agg(F.count("*").alias("production_line_count"))
    device_plant = t.device.select("device_id", "line_id").join(line, "line_id").drop("line_id")
    devices = device_plant.groupBy(*by_plant).agg(F.count("*").alias("device_count"))
    tag_plant = t.tag.select("tag_id", "device_id", "is_enabled").join(device_plant, "device_id")
    tags = tag_plant.groupBy(*by_plant).agg(
        F.count("*").alias("tag_count"), F.count_if("is_enabled").alias("enabled_tag_count")
    )
    tasks = t.acquisition_task.groupBy(*by_plant).agg(
        F.count("*").alias("acquisition_task_count"),
        F.count_if(F.col("desired_state") == "running").alias("running_task_count"),
        F.count_if(F.col("connection_state") == "connected").alias("connected_task_count"),
    )
    per_tag = t.tag_sample.groupBy("tag_id").agg(
        F.count("*").alias("n"), F.max("source_timestamp").alias("newest")
    )
    facts = per_tag.join(tag_plant.select("tag_id", "plant_id"), "tag_id").groupBy(*by_plant).agg(
        F.sum("n").alias("sample_count"), F.max("newest").alias("latest_sample_at")
    )
    imports = t.import_batch.groupBy(*by_plant).agg(
        F.count("*").alias("import_batch_count"),
        F.count_if(F.col("status") == "completed").alias("completed_import_batch_count"),
    )
    issues = issues_by_batch(t).join(t.import_batch.select("batch_id", "plant_id"), "batch_id")
    issue_counts = issues.groupBy(*by_plant).agg(F.sum("n").alias("quality_issue_count"))
    result = t.plant.select("plant_id").withColumn("plant_count", F.lit(1).cast("long"))
    for part in (lines, devices, tags, tasks, facts, imports, issue_counts):
        result = result.join(part, "plant_id", "left")
    counts = [c for c in result.columns if c.endswith("_count")]
    return result.na.fill(0, counts)


def issues_by_batch(t: Tables) -> DataFrame:
    return t.data_quality_issue.groupBy("batch_id").agg(F.count("*").alias("n"))


def dashboard_by_user(t: Tables) -> DataFrame:
    """The dashboard of every user: the sum over the plants that the user may read.

    Administrators share one row of totals, so their plants are not multiplied out.
    """
    per_plant = dashboard(t)
    counts = [c for c in per_plant.columns if c.endswith("_count")]
    sums = [F.sum(c).alias(c) for c in counts] + [F.max("latest_sample_at").alias("latest_sample_at")]
    everything = per_plant.agg(*sums).withColumn("_one", F.lit(1))
    admins = t.user.where(is_admin()).select("user_id").withColumn("_one", F.lit(1))
    others = t.user.where(~is_admin()).select("user_id")
    granted = (
        t.user_plant_access.distinct()
        .join(others, "user_id", "left_semi")
        .join(per_plant, "plant_id")
        .groupBy("user_id")
        .agg(*sums)
    )
    return (
        admins.join(everything, "_one").drop("_one")
        .unionByName(others.join(granted, "user_id", "left"))
        .na.fill(0, counts)
    )
