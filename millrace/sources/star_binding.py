"""Bind the star-schema test tables to the telemetry model.

Every derived table is a projection of a given table, so the work grows with it. The
event table needs no join to become the fact table: the task and the batch of a sample
follow from its tag id.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import configure
from millrace.sources.tables import SCHEMAS, Tables, empty_table, normalise_roles

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.UTC)
# A tag's device is its id modulo 125, and five devices make a line.
LINE_OF_TAG = "{tag} % 125 div 5"


def as_of() -> Column:
    return F.lit(AS_OF)


@lru_cache(maxsize=256)
def _schema(application: str, path: str) -> StructType:
    """The schema of a given file, read from its footer once per application."""
    return SparkSession.getActiveSession().read.parquet(path).schema


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with its zone-less times read as UTC instants."""
    path = f"{sf_dir}/{name}.parquet"
    configure(spark)
    schema = _schema(spark.sparkContext.applicationId, path)
    df = spark.read.schema(schema).parquet(path)
    for field in schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def _conform(df: DataFrame, name: str) -> DataFrame:
    """Project to the declared columns and types of a stored table."""
    columns = [part.strip().split(" ", 1) for part in SCHEMAS[name].split(",")]
    return df.selectExpr(*[f"CAST({column} AS {kind}) AS {column}" for column, kind in columns])


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "region").selectExpr(
        "r_regionkey AS plant_id", "r_name AS code", "r_name AS name",
        "IF(r_regionkey = 4, 'inactive', 'active') AS status", "NULL AS location",
    )
    return _conform(rows, "plant")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS line_id", "n_regionkey AS plant_id", "n_name AS code",
        "'Line ' || n_name AS name", "IF(n_nationkey % 11 = 10, 'inactive', 'active') AS status",
        "'mixing' AS process_type",
    )
    return _conform(rows, "production_line")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = given(spark, sf_dir, "customer").selectExpr("c_custkey % 125 AS device_id").distinct()
    rows = ids.selectExpr(
        "device_id", "device_id div 5 AS line_id", "'DEV_' || device_id % 10 AS code",
        "'Device ' || device_id AS name",
        "IF(device_id % 17 = 13, 'inactive', 'active') AS status",
        "IF(device_id % 2 = 0, 'pump', 'mixer') AS device_type",
    )
    return _conform(rows, "device")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS tag_id", "c_custkey % 125 AS device_id",
        "IF(c_custkey % 3 = 0, 'T' || c_custkey div 125, 'U' || c_custkey) AS code",
        "c_name AS name",
        "CASE c_custkey % 10 WHEN 3 THEN 'integer' WHEN 5 THEN 'boolean' WHEN 7 THEN 'string' "
        "ELSE 'float' END AS data_type",
        "'bar' AS unit", "1.0D AS min_value", "IF(c_custkey % 9 = 0, NULL, 200.0D) AS max_value",
        "1000 * (1 + c_custkey % 40) AS sampling_interval_ms", "c_custkey % 10 <> 0 AS is_enabled",
    )
    return _conform(rows, "tag")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = LINE_OF_TAG.format(tag="user_id")
    rows = given(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        f"IF(event_id % 5 = 0, NULL, {line}) AS task_id",
        f"IF(event_id % 5 = 0, {line} * 2 + event_id % 2, NULL) AS import_batch_id",
        "IF(event_id % 5 = 0, 'file', 'opcua') AS source_type",
        "user_id AS tag_id",
        "IF(event_type = 'signup', props, CAST(value AS STRING)) AS value",
        "IF(event_type = 'signup', NULL, value) AS numeric_value",
        "ts AS source_timestamp",
        "IF(event_id % 3 = 0, NULL, ts + INTERVAL 1 SECOND) AS server_timestamp",
        "ts + INTERVAL 2 SECONDS AS received_at",
        "IF(event_type = 'error', 'BadSensorFailure', 'Good') AS status_code",
        "event_type <> 'error' AS is_good",
    )
    return _conform(rows, "tag_sample")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = (
        samples(spark, sf_dir)
        .where("source_type = 'opcua'")
        .groupBy("task_id")
        .agg(
            F.expr("count(*) AS received"), F.expr("count_if(id % 97 = 0) AS repeated"),
            F.expr("max(source_timestamp) AS last_sample_at"),
        )
    )
    named = given(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "task_id")
    rows = named.join(counts, "task_id", "left").selectExpr(
        "task_id", "n_regionkey AS plant_id", "'TASK-' || n_name AS name",
        "CASE task_id % 7 WHEN 5 THEN 'opc.tcp://user:secret@sim:4840' WHEN 6 THEN 'http://sim:4840' "
        "WHEN 4 THEN 'opc.tcp://other:4840' ELSE 'opc.tcp://sim:4840' END AS endpoint_url",
        "50 + 50 * (task_id % 4) AS publishing_interval_ms", "100 AS batch_size",
        "1 + task_id % 40 * 2 AS reconnect_delay_seconds", "30 AS max_reconnect_delay_seconds",
        "IF(task_id % 6 = 5, 'stopped', 'running') AS desired_state",
        "CASE WHEN task_id % 4 = 3 THEN 'error' WHEN task_id % 6 = 5 THEN 'stopped' "
        "ELSE 'connected' END AS connection_state",
        "last_sample_at",
        f"timestampadd(SECOND, -7 * task_id, TIMESTAMP '{AS_OF.isoformat()}') AS worker_heartbeat_at",
        "task_id % 5 AS error_count", "task_id % 2 AS reconnect_count",
        "coalesce(received, 0) AS samples_received",
        "coalesce(received - repeated, 0) AS samples_written",
        "coalesce(repeated, 0) AS duplicate_count", "task_id % 3 AS dropped_count",
    )
    return _conform(rows, "acquisition_task")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "customer").selectExpr(
        LINE_OF_TAG.format(tag="c_custkey") + " AS task_id", "c_custkey AS tag_id",
        "'ns=2;s=' || c_name AS node_id", "c_custkey % 7 <> 0 AS is_enabled",
    )
    return _conform(rows, "acquisition_node")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = (
        samples(spark, sf_dir)
        .where("source_type = 'file'")
        .groupBy(F.col("import_batch_id").alias("batch_id"))
        .agg(
            F.expr("count(*) AS accepted"), F.expr("count_if(NOT is_good) AS warned"),
            F.expr("count_if(NOT is_good OR coalesce(numeric_value > 200, false)) AS reported"),
        )
    )
    named = given(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", "n_regionkey", "n_name", "explode(array(0, 1)) AS k"
    ).selectExpr("*", "CAST(n_nationkey * 2 + k AS LONG) AS batch_id")
    copy = "k = 1 AND n_nationkey % 2 = 0"
    rows = named.join(counts, "batch_id", "left").selectExpr(
        "batch_id", "n_regionkey AS plant_id", f"IF({copy}, batch_id - 1, NULL) AS duplicate_of_id",
        "'import_' || batch_id || IF(batch_id % 3 = 0, '.xlsx', '.csv') AS original_filename",
        "IF(batch_id % 3 = 0, 'xlsx', 'csv') AS file_format", "1000 + batch_id AS file_size_bytes",
        "sha2(n_name || IF(n_nationkey % 2 = 1, CAST(k AS STRING), ''), 256) AS file_sha256",
        f"CASE WHEN {copy} THEN 'duplicate' WHEN batch_id % 8 = 5 THEN 'failed' "
        "WHEN batch_id % 8 = 6 THEN 'processing' ELSE 'completed' END AS status",
        "coalesce(accepted, 0) + batch_id % 7 AS total_rows", "coalesce(accepted, 0) AS accepted_rows",
        "batch_id % 7 AS rejected_rows", "batch_id % 3 AS duplicate_rows",
        "coalesce(warned, 0) AS warning_rows", "coalesce(reported, 0) AS issue_count",
        "coalesce(reported, 0) AS stored_issue_count", "false AS issues_truncated",
        "timestampadd(HOUR, batch_id, TIMESTAMP '2024-01-01T00:00:00Z') AS created_at",
    )
    return _conform(rows, "import_batch")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = given(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", "explode(sequence(0, n_nationkey % 3)) AS attempt"
    )
    # The last two attempts share an instant, so that the id decides.
    rows = attempts.selectExpr(
        "n_nationkey * 10 + attempt AS job_id", "n_nationkey * 2 AS batch_id",
        "IF(attempt = n_nationkey % 3, 'completed', 'failed') AS status",
        "timestampadd(MINUTE, least(attempt, 1), TIMESTAMP '2024-01-02T00:00:00Z') AS created_at",
    )
    return _conform(rows, "import_job")


def field_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "nation").selectExpr(
        "n_nationkey * 2 AS batch_id",
        "stack(3, 'timestamp_column', 'time', 'tag_code_column', 'tag', 'value_column', 'value') "
        "AS (target_field, source_column)",
    )
    return _conform(rows, "import_field_mapping")


def issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = samples(spark, sf_dir).where(
        "source_type = 'file' AND (NOT is_good OR coalesce(numeric_value > 200, false))"
    )
    rows = stored.selectExpr(
        "id", "import_batch_id AS batch_id", "id + 2 AS row_number",
        "IF(is_good, 'out_of_range', 'bad_quality') AS issue_type",
        "IF(is_good, 'error', 'warning') AS severity", "IF(is_good, 'value', 'quality') AS field_name",
        "IF(is_good, value, status_code) AS raw_value", "'tag ' || tag_id AS message",
    )
    return _conform(rows, "data_quality_issue")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = given(spark, sf_dir, "embeddings").selectExpr("vec_id AS document_id", "embedding AS vector")
    rows = given(spark, sf_dir, "documents").selectExpr(
        "doc_id AS document_id", "CAST(substring(source, 4) AS LONG) % 5 AS plant_id",
        "source || '-' || doc_id AS title", "text AS content", "1 + doc_id % 3 AS version",
        "sha2(text, 256) AS content_sha256",
    )
    return _conform(rows.join(vectors, "document_id", "left"), "knowledge_document")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retrieval question per benchmark passage, asked in the plant of a document."""
    asked = given(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id", "text AS query")
    placed = given(spark, sf_dir, "documents").selectExpr(
        "doc_id AS query_id", "CAST(substring(source, 4) AS LONG) % 5 AS plant_id"
    )
    vectors = given(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS query_id", "CAST(embedding AS ARRAY<DOUBLE>) AS vector"
    )
    return asked.join(placed, "query_id").join(vectors, "query_id", "left")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS user_id",
        "CASE WHEN s_suppkey % 10 = 0 THEN 'admin' WHEN s_suppkey % 2 = 0 THEN 'engineer' "
        "ELSE 'observer' END AS role",
        "s_suppkey % 25 = 1 AS is_superuser", "s_suppkey % 13 <> 7 AS is_active",
    )
    return normalise_roles(_conform(rows, "user"))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plant for each user, and the next plant as well for every third user."""
    rows = given(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS user_id",
        "explode(IF(s_suppkey % 3 = 0, array(s_nationkey % 5, (s_nationkey + 1) % 5), "
        "array(s_nationkey % 5))) AS plant_id",
    )
    return _conform(rows, "user_plant_access")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id * 100 + turn AS run_id", "conv_id % 20 AS user_id", "conv_id % 5 AS plant_id",
        "IF(length(text) % 5 = 0, 'failed', 'answered') AS status",
        f"timestampadd(SECOND, -(conv_id % 120), TIMESTAMP '{AS_OF.isoformat()}') AS created_at",
    )
    return _conform(rows, "assistant_run")


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    """Every stored table, derived lazily from the given ones."""
    derived = {
        "plant": plants, "production_line": lines, "device": devices, "tag": tags,
        "acquisition_task": tasks, "acquisition_node": nodes, "tag_sample": samples,
        "import_batch": batches, "import_job": jobs, "import_field_mapping": field_mappings,
        "data_quality_issue": issue_rows, "knowledge_document": documents, "user": users,
        "user_plant_access": grants, "assistant_run": runs,
    }
    openers = {name: partial(derive, spark, sf_dir) for name, derive in derived.items()}
    return Tables(
        {**openers, "retention_preview": partial(empty_table, spark, "retention_preview")}
    )
