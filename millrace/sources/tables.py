"""The stored tables: declared schemas, loading and writing."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: names and types of the stored tables --------------------------------
SCHEMAS = {
    "plant": "plant_id LONG, code STRING, name STRING, status STRING, location STRING",
    "production_line": (
        "line_id LONG, plant_id LONG, code STRING, name STRING, status STRING, "
        "process_type STRING"
    ),
    "device": (
        "device_id LONG, line_id LONG, code STRING, name STRING, status STRING, "
        "device_type STRING"
    ),
    "tag": (
        "tag_id LONG, device_id LONG, code STRING, name STRING, data_type STRING, unit STRING, "
        "min_value DOUBLE, max_value DOUBLE, sampling_interval_ms INT, is_enabled BOOLEAN"
    ),
    "acquisition_task": (
        "task_id LONG, plant_id LONG, name STRING, endpoint_url STRING, "
        "publishing_interval_ms INT, batch_size INT, reconnect_delay_seconds INT, "
        "max_reconnect_delay_seconds INT, desired_state STRING, connection_state STRING, "
        "last_sample_at TIMESTAMP, worker_heartbeat_at TIMESTAMP, error_count LONG, "
        "reconnect_count LONG, samples_received LONG, samples_written LONG, "
        "duplicate_count LONG, dropped_count LONG"
    ),
    "acquisition_node": "task_id LONG, tag_id LONG, node_id STRING, is_enabled BOOLEAN",
    "tag_sample": (
        "id LONG, task_id LONG, import_batch_id LONG, source_type STRING, tag_id LONG, "
        "value STRING, numeric_value DOUBLE, source_timestamp TIMESTAMP, "
        "server_timestamp TIMESTAMP, received_at TIMESTAMP, status_code STRING, is_good BOOLEAN"
    ),
    "import_batch": (
        "batch_id LONG, plant_id LONG, duplicate_of_id LONG, original_filename STRING, "
        "file_format STRING, file_size_bytes LONG, file_sha256 STRING, status STRING, "
        "total_rows LONG, accepted_rows LONG, rejected_rows LONG, duplicate_rows LONG, "
        "warning_rows LONG, issue_count LONG, stored_issue_count LONG, "
        "issues_truncated BOOLEAN, created_at TIMESTAMP"
    ),
    "import_job": "job_id LONG, batch_id LONG, status STRING, created_at TIMESTAMP",
    "import_field_mapping": "batch_id LONG, target_field STRING, source_column STRING",
    "data_quality_issue": (
        "id LONG, batch_id LONG, row_number LONG, issue_type STRING, severity STRING, "
        "field_name STRING, raw_value STRING, message STRING"
    ),
    "knowledge_document": (
        "document_id LONG, plant_id LONG, title STRING, content STRING, version INT, "
        "content_sha256 STRING, vector ARRAY<DOUBLE>"
    ),
    "user": "user_id LONG, role STRING, is_superuser BOOLEAN, is_active BOOLEAN",
    "user_plant_access": "user_id LONG, plant_id LONG",
    "assistant_run": (
        "run_id LONG, user_id LONG, plant_id LONG, status STRING, created_at TIMESTAMP"
    ),
    "retention_preview": (
        "plant_id LONG, source_type STRING, keep_days INT, cutoff TIMESTAMP, "
        "high_water_id LONG, matched_rows LONG, count_is_exact BOOLEAN, "
        "affected_tags_in_scan LONG, oldest_in_scan TIMESTAMP, newest_in_scan TIMESTAMP"
    ),
}

# Parent before child, as references require.
PARENT_FIRST = (
    "plant", "production_line", "device", "tag", "acquisition_task", "acquisition_node",
    "import_batch", "import_field_mapping", "import_job", "data_quality_issue", "tag_sample",
    "knowledge_document", "assistant_run", "user_plant_access", "retention_preview",
)


class Tables:
    """The stored tables by attribute; each is opened when it is first used."""

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]) -> None:
        unknown = set(openers) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._openers = dict(openers)

    def __getattr__(self, name: str) -> DataFrame:
        openers = self.__dict__.get("_openers", {})
        if name not in openers:
            raise AttributeError(name)
        opened = openers[name]()
        self.__dict__[name] = opened
        return opened

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self._openers}

    def replaced(self, **tables: DataFrame) -> Tables:
        """The same tables with some of them exchanged."""
        changed = {name: (lambda df=df: df) for name, df in tables.items()}
        return Tables({**self._openers, **changed})


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def normalise_roles(users: DataFrame) -> DataFrame:
    """The administrator role and the superuser flag always imply each other."""
    admin = F.coalesce(F.col("is_superuser"), F.lit(False)) | (F.col("role") == "admin")
    return users.withColumn("role", F.when(admin, F.lit("admin")).otherwise(F.col("role"))).withColumn(
        "is_superuser", admin
    )


def load_tables(spark: SparkSession, root: str) -> Tables:
    """Read every table from ``root/<name>``, with the declared schema.

    Declaring the schema saves the inference job, and makes a scan of a wide archive
    read the named columns only.
    """
    def opener(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")

    openers = {name: opener(name) for name in SCHEMAS}
    return Tables({**openers, "user": lambda: normalise_roles(openers["user"]())})


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Write the fact table by source and day, with each file sorted by tag and time.

    Partition pruning then serves the source and day predicates, and the Parquet row
    group statistics serve tag and time. Rows are spread by tag *and* day part, so one
    busy tag does not fill a single file.
    """
    day = F.to_date("source_timestamp")
    (
        samples.withColumn("sample_date", day)
        .repartitionByRange("source_type", "sample_date", "tag_id", "source_timestamp")
        .sortWithinPartitions("source_type", "sample_date", "tag_id", "source_timestamp", "id")
        .write.mode(mode)
        .partitionBy("source_type", "sample_date")
        .parquet(path)
    )


def all_samples(live: DataFrame, files: DataFrame) -> DataFrame:
    """Both sources in one fact table. Equal instants of one tag stay two rows."""
    return live.unionByName(files, allowMissingColumns=True)
