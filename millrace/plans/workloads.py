"""Inputs of the registered queries that are not stored tables: raw files, requests, answers.

All of them are projections of whole given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.importing import ImportMapping, WideColumn
from millrace.sources.star_binding import given, lines
from millrace.sources.tables import Tables

LONG_MAPPING = ImportMapping(
    timestamp_column="time", tag_code_column="tag", value_column="value",
    device_code_column="device", quality_column="quality",
)
WIDE_MAPPING = ImportMapping(
    timestamp_column="time", layout="wide", quality_column="quality",
    wide_columns=(
        WideColumn("m1", "U1"), WideColumn("m2", "T0", "DEV_0"),
        WideColumn("m3", "T1"), WideColumn("m4", "U7"),
    ),
)
RAW_COLUMNS = ("time", "device", "tag", "value", "quality")

# Event time in three ISO spellings, with blanks and bad text by event id.
_TIME_TEXT = """CASE
    WHEN event_id % 31 = 1 THEN ''
    WHEN event_id % 31 = 2 THEN 'not-a-time'
    WHEN event_id % 3 = 0 THEN date_format(ts + INTERVAL 8 HOURS, 'yyyy-MM-dd HH:mm:ss.SSSSSS')
    WHEN event_id % 3 = 1 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") || 'Z'
    ELSE date_format(ts + INTERVAL 8 HOURS, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") || '+08:00' END AS time"""


def raw_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long import file per plant, with every kind of defect, from all events."""
    rows = given(spark, sf_dir, "events").selectExpr(
        "user_id % 125 div 5 AS line_id", "event_id",
        "explode(IF(event_id % 23 = 5, array(0, 1), array(0))) AS copy",
        _TIME_TEXT,
        """CASE WHEN event_id % 37 = 3 THEN '' WHEN event_id % 37 = 4 THEN 'NO_SUCH'
            WHEN event_id % 2 = 0 THEN 'dev_' || user_id % 125 % 10
            ELSE 'DEV_' || user_id % 125 % 10 END AS device""",
        """CASE WHEN event_id % 41 = 5 THEN '' WHEN event_id % 41 = 6 THEN 'T_UNKNOWN'
            WHEN user_id % 3 = 0 THEN ' T' || user_id div 125 ELSE ' U' || user_id END AS tag""",
        """CASE WHEN event_id % 43 = 7 THEN '' WHEN event_id % 43 = 8 THEN 'abc'
            WHEN event_id % 43 = 9 THEN '1_000.5' WHEN event_id % 43 = 10 THEN 'nan'
            WHEN user_id % 10 = 5 THEN array('yes', '0', 'maybe', 'TRUE')[CAST(event_id % 4 AS INT)]
            WHEN user_id % 10 = 3 AND event_id % 2 = 0 THEN floor(value) || '.0'
            WHEN user_id % 10 = 7 THEN ' ' || event_type || ' '
            ELSE CAST(value AS STRING) END AS value""",
        """CASE event_id % 47 WHEN 11 THEN 'BadSensorFailure' WHEN 12 THEN ' 0xC0 ' WHEN 13 THEN ''
            ELSE 'Good' END AS quality""",
    )
    line = lines(spark, sf_dir).select("line_id", "plant_id")
    return rows.join(line, "line_id").selectExpr(
        "plant_id AS batch_id", "plant_id", "event_id * 2 + 2 + copy AS source_row", *RAW_COLUMNS
    )


def raw_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide import file per plant, a row for every event."""
    return given(spark, sf_dir, "events").selectExpr(
        "event_id % 5 AS batch_id", "event_id % 5 AS plant_id", "event_id + 2 AS source_row",
        _TIME_TEXT, "CAST(value AS STRING) AS m1", "CAST(value * 2 AS STRING) AS m2",
        "IF(event_id % 7 = 0, '', CAST(round(value + 1, 2) AS STRING)) AS m3", "event_type AS m4",
        "IF(event_id % 47 = 11, 'BadSensorFailure', 'Good') AS quality",
    )


def write_mixed_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Two import files per plant from all events, in a form of the plant's own, and broken files beside them.

    Plant 0 has UTF-8 with commas, 1 GB18030, 2 tabs, 3 semicolons, all with lines of blanks and empty lines
    between their rows; the files of plant 4 have no value column. Each customer nation adds a file of bytes that
    are in neither encoding, and each region one with a repeated header.
    """
    cells = [F.coalesce(F.col(c), F.lit("")) for c in RAW_COLUMNS]
    sep = F.when(F.col("plant_id") == 2, "\t").when(F.col("plant_id") == 3, ";").otherwise(",")
    named = lambda value: F.array(*[F.lit(value if c == "value" else c) for c in RAW_COLUMNS])
    names = F.when(F.col("plant_id") == 4, named("reading")).otherwise(named("value"))
    data = raw_long(spark, sf_dir).withColumn("sep", sep).withColumn("part", F.col("source_row") % 2)
    line = F.concat(F.call_function("array_join", F.array(*cells), F.col("sep")), F.col("sep"), F.lit("压力"))
    blank = F.when(F.col("source_row") % 38 == 4, F.array(F.lit("   "), F.lit(""))).otherwise(F.array())
    body = data.select(
        "plant_id", "part", F.col("source_row").alias("at"), F.posexplode(F.concat(F.array(line), blank.cast("array<string>"))).alias("n", "line")
    )
    heads = data.select("plant_id", "part", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("n"),
                        F.concat(F.call_function("array_join", names, F.col("sep")), F.col("sep"), F.lit("备注")).alias("line")).distinct()
    encoded = F.when(F.col("plant_id") == 1, F.encode("line", "GB18030")).otherwise(F.encode("line", "UTF-8")).cast("string")
    rows = body.unionByName(heads).withColumn("line", encoded)
    # One file per plant and part, in order.
    rows.repartition("plant_id", "part").sortWithinPartitions("plant_id", "part", "at", "n").select(
        "plant_id", "part", "line"
    ).write.partitionBy("plant_id", "part").option("compression", "none").text(f"{folder}/good")
    broken = given(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("file"), F.unhex(F.lit("74696D652C81300A")).cast("string").alias("line")
    )
    doubled = given(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("file"), F.lit("time,tag,time").alias("line"))
    broken.unionByName(doubled).repartition("file").write.partitionBy("file").text(f"{folder}/bad")
    for path in ("good", "bad"):
        _as_csv(spark, f"{folder}/{path}")


def _as_csv(spark: SparkSession, folder: str) -> None:
    """Give the text files below a folder the ending of CSV files."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listFiles(path(folder), True)
    names = []
    while found.hasNext():
        names.append(found.next().getPath().toString())
    for name in names:
        if name.endswith(".txt"):
            files.rename(path(name), path(name.removesuffix(".txt") + ".csv"))


# What is broken in a copy of the stored tables, as SQL expressions that both engines read: every rule has hits.
DAMAGE = {
    "plant": {"code": "CASE WHEN plant_id < 2 THEN 'SAME' ELSE code END"},
    "production_line": {
        "plant_id": "CASE WHEN line_id % 11 = 3 THEN 99 ELSE plant_id END",
        "code": "CASE WHEN line_id % 5 < 2 THEN 'L' ELSE code END",
    },
    "device": {
        "line_id": "CASE WHEN device_id % 13 = 4 THEN -1 ELSE line_id END",
        "code": "CASE WHEN device_id % 3 = 1 THEN 'D' ELSE code END",
    },
    "tag": {
        "device_id": "CASE WHEN tag_id % 17 = 5 THEN -2 ELSE device_id END",
        "code": "CASE WHEN tag_id % 17 = 5 THEN 'not a code' ELSE code END",
        "min_value": "CASE WHEN tag_id % 23 = 6 THEN 9 ELSE min_value END",
        "max_value": "CASE WHEN tag_id % 23 = 6 THEN 8 ELSE max_value END",
        "sampling_interval_ms": "CASE WHEN tag_id % 29 = 7 THEN 5 ELSE sampling_interval_ms END",
    },
    "acquisition_node": {
        "tag_id": "CASE WHEN tag_id % 31 = 8 THEN -3 ELSE tag_id END",
        "node_id": "CASE WHEN tag_id % 31 = 9 THEN 'ns=2;s=one' ELSE node_id END",
        "task_id": "CASE WHEN tag_id % 31 = 10 THEN 9999 ELSE task_id END",
    },
    "acquisition_task": {
        "publishing_interval_ms": "CASE WHEN task_id % 5 = 1 THEN 99 ELSE publishing_interval_ms END",
        "batch_size": "CASE WHEN task_id % 5 = 2 THEN 2001 ELSE batch_size END",
        "reconnect_delay_seconds": "CASE WHEN task_id % 5 = 3 THEN 301 ELSE reconnect_delay_seconds END",
        "max_reconnect_delay_seconds": "CASE WHEN task_id % 5 = 4 THEN 901 WHEN task_id % 5 = 3 THEN 300 "
        "ELSE max_reconnect_delay_seconds END",
        "endpoint_url": "CASE WHEN task_id % 5 = 0 THEN 'opc.tcp://other:4840' ELSE endpoint_url END",
    },
    "tag_sample": {
        "source_timestamp": "CASE WHEN id % 37 < 2 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE source_timestamp END",
        "tag_id": "CASE WHEN id % 41 = 3 THEN -4 ELSE tag_id END",
        "task_id": "CASE WHEN id % 43 = 4 THEN 8888 ELSE task_id END",
        "import_batch_id": "CASE WHEN id % 47 = 5 THEN 7777 ELSE import_batch_id END",
    },
    "data_quality_issue": {"batch_id": "CASE WHEN id % 3 = 1 THEN -5 ELSE batch_id END"},
    "user_plant_access": {"plant_id": "CASE WHEN user_id % 6 = 5 THEN 77 ELSE plant_id END"},
    "knowledge_document": {
        "title": "CASE WHEN document_id % 53 = 6 THEN '' ELSE title END",
        "content": "CASE WHEN document_id % 59 = 7 THEN 'short' ELSE content END",
    },
}


# Columns whose digests two engines compare, with what they hold.
DIGESTED = {
    "plant": {"plant_id": "whole", "code": "text", "name": "text", "status": "text"},
    "production_line": {"line_id": "whole", "plant_id": "whole", "code": "text", "name": "text"},
    "device": {"device_id": "whole", "line_id": "whole", "code": "text", "name": "text"},
    "tag": {"tag_id": "whole", "device_id": "whole", "code": "text", "data_type": "text", "max_value": "number", "is_enabled": "flag"},
    "acquisition_node": {"task_id": "whole", "tag_id": "whole", "node_id": "text", "is_enabled": "flag"},
    "tag_sample": {
        "id": "whole", "tag_id": "whole", "task_id": "whole", "import_batch_id": "whole", "source_type": "text",
        "numeric_value": "number", "source_timestamp": "time", "is_good": "flag",
    },
}


def damaged_tables(t: Tables) -> Tables:
    """The stored tables with :data:`DAMAGE` done to them."""
    broken = {}
    for name, changes in DAMAGE.items():
        table = t.as_dict()[name]
        # All changes look at the values before any of them.
        broken[name] = table.select(*[F.expr(changes.get(c, f"`{c}`")).alias(c) for c in table.columns])
    return t.replaced(**broken)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access requests: one per order, some for users or plants that do not exist."""
    return given(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS request_id", "o_custkey % 120 AS user_id", "o_orderkey % 7 AS plant_id",
        "o_orderstatus = 'F' AS write",
    )


def proposed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS mapping_id", "o_orderkey % 25 AS task_id",
        "IF(o_orderkey % 101 = 0, -o_custkey - 1, o_custkey) AS tag_id",
        "IF(o_orderkey % 50 = 7, '  ', ' ns=2;s=' || o_custkey || '.' || o_orderkey % 3) AS node_id",
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File uploads: one per order; customers upload the same content again and again."""
    return given(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS batch_id", "o_custkey % 5 AS plant_id",
        "sha2(CAST(o_custkey % 200 AS STRING), 256) AS file_sha256",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status",
        "o_orderdate AS created_at",
    )


HEADER_VARIANTS = (
    ("timestamp", "tag_code", "value"),
    ("采集时间", "变量编码", "测量值", "设备", "质量"),
    ("时间", "温度", "压力"),
    ("TIME", "Tag", "READING", "quality_code"),
    ("x", "y"),
    ("value", "datetime", "source_timestamp", "point", "数值", "status_code"),
)


def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, position, header) with one file per event."""
    variants = F.array(*[F.array(*[F.lit(h) for h in v]) for v in HEADER_VARIANTS])
    chosen = F.get(variants, (F.col("event_id") % len(HEADER_VARIANTS)).cast("int"))
    return given(spark, sf_dir, "events").select(
        F.col("event_id").alias("file_id"), F.posexplode(chosen).alias("position", "header")
    )


def recorded_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Page contents as files: their digests now, and the digests recorded earlier."""
    page = given(spark, sf_dir, "pages")
    now = page.selectExpr("'page-' || page_id AS path", "sha2(html, 256) AS file_sha256")
    recorded = page.selectExpr(
        "'page-' || page_id AS path",
        "sha2(IF(length(html) % 4 = 0, html || 'x', html), 256) AS file_sha256",
    )
    return now, recorded


def snapshots(spark: SparkSession, samples: DataFrame) -> DataFrame:
    """Daily counter snapshots of every task.

    A task has one row per day after an aggregate that combines on the map side, so the
    running sums are over few rows.
    """
    daily = samples.where("source_type = 'opcua'").groupBy(
        "task_id", F.to_date("source_timestamp").alias("day")
    ).agg(F.expr("count(*) AS n"), F.expr("count_if(id % 97 = 0) AS d"))
    upto = "OVER (PARTITION BY task_id ORDER BY day ROWS UNBOUNDED PRECEDING)"
    return daily.selectExpr(
        "task_id", "CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AS taken_at",
        "IF((task_id + dayofmonth(day)) % 11 = 0, 'reconnecting', 'connected') AS connection_state",
        f"sum(n) {upto} AS samples_received", f"sum(n - d) {upto} AS samples_written",
        f"sum(d) {upto} AS duplicate_count",
        "CAST(IF(task_id % 4 = 1, dayofmonth(day), 0) AS LONG) AS dropped_count",
        "CAST(IF(task_id % 4 = 2, dayofmonth(day), 0) AS LONG) AS error_count",
        "CAST(0 AS LONG) AS reconnect_count", f"sum(n - d) {upto} AS sample_rows",
        "CAST(task_id * dayofmonth(day) % 20 AS DOUBLE) AS heartbeat_age_seconds",
    )


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported connection states: one per event, for the task of its tag."""
    return given(spark, sf_dir, "events").selectExpr(
        "user_id % 125 div 5 AS task_id", "event_id AS seq", "ts AS reported_at",
        "CASE event_type WHEN 'signup' THEN 'stopped' WHEN 'error' THEN 'error' "
        "WHEN 'view' THEN 'connected' WHEN 'click' THEN 'reconnecting' ELSE 'connecting' END AS state",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event with two values; an error event marks the flow as bad."""
    return given(spark, sf_dir, "events").selectExpr(
        "ts AS timestamp", "map('PRESSURE', value, 'FLOW', value * 2) AS values",
        "IF(event_type = 'error', array('FLOW'), CAST(array() AS ARRAY<STRING>)) AS bad_codes",
    )


def notifications(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Live notifications from all events; some repeat, some name unknown nodes."""
    if events is None:
        events = given(spark, sf_dir, "events")
    rows = events.selectExpr("*", "explode(IF(event_id % 9 = 4, array(0, 1), array(0))) AS copy")
    return rows.selectExpr(
        "user_id % 125 div 5 AS task_id", "event_id * 2 + copy AS seq",
        "IF(event_id % 29 = 3, 'ns=9;s=', 'ns=2;s=') || format_string('Customer#%09d', user_id) AS node_id",
        "IF(event_type = 'signup', props, CAST(value AS STRING)) AS value",
        "IF(event_id % 53 = 0, NULL, ts) AS source_timestamp",
        "CAST(NULL AS TIMESTAMP) AS server_timestamp",
        "timestampadd(SECOND, 2 + copy, ts) AS received_at",
        "IF(event_type = 'error', 'BadSensorFailure', 'Good') AS status_code",
        "event_type <> 'error' AS is_good",
    )


def arrival_slot(slots: int) -> Column:
    """When a notification arrives: the copies of an event arrive apart, some in the wrong order."""
    return F.pmod(F.expr("seq div 2 + seq % 2"), F.lit(slots))


def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions built from every conversation turn, in supported and refused wordings."""
    turn, conv = F.col("turn"), F.col("conv_id")
    hours = (1 + conv % 30).cast("string")
    lead = (
        F.when(conv % 6 == 0, F.concat(F.lit("过去"), hours, F.lit("小时的趋势：")))
        .when(conv % 6 == 1, F.concat(F.lit("最近"), hours, F.lit("分钟均值：")))
        .when(conv % 6 == 2, F.lit("近二十三小时最大值："))
        .when(conv % 6 == 3, F.lit("最近两天每小时统计："))
        .when(conv % 6 == 4, F.lit("当前有几个采集任务在运行？"))
        .otherwise(F.lit(""))
    )
    return given(spark, sf_dir, "conversations").select(
        (conv * 100 + turn).alias("question_id"), F.concat(lead, "text").alias("question"),
        (1 + turn % 24).cast("int").alias("requested_hours"),
    )


def given_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers built from every assistant turn, with citations and cited text."""
    conv, turn = F.col("conv_id"), F.col("turn")
    key = conv + turn
    ending = (
        F.when(key % 5 == 0, F.lit("。请使用 recipe_v2.1 配方。"))
        .when(key % 5 == 1, F.lit("。平台不存储任何指标。"))
        .when(key % 5 == 2, F.lit("。不能断言所有数据都是模拟数据。"))
        .otherwise(F.lit(""))
    )
    leading = (
        F.when(key % 7 == 0, F.lit("可以，但需要先确认。"))
        .when(key % 7 == 1, F.lit("抱歉，我无法绕过权限。"))
        .otherwise(F.lit(""))
    )
    evidence = F.array(
        F.concat(F.lit("e"), conv.cast("string")), F.concat(F.lit("e"), (conv + 1).cast("string"))
    )
    cited = F.when(key % 4 == 0, F.array(F.concat(F.lit("e"), (conv + key % 3).cast("string")))).otherwise(
        F.array().cast("array<string>")
    )
    return given(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(
        (conv * 100 + turn).alias("answer_id"),
        F.when(key % 3 == 0, "no_answer").otherwise("answered").alias("status"),
        F.concat(leading, "text", ending).alias("answer"), F.lit("").alias("question"),
        F.when(key % 2 == 0, F.lit("recipe_v2.1")).otherwise(F.lit("none")).alias("cited_text"),
        evidence.alias("evidence_ids"), cited.alias("citation_ids"),
    )


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence used by answers: one row per conversation turn."""
    titles = F.array(F.lit("acquisition_status"), F.lit("asset_overview"), F.lit("tag_trend"))
    return given(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("answer_id"), F.col("turn").alias("position"),
        F.get(titles, (F.length("text") % 3).cast("int")).alias("title"),
        (F.col("conv_id") * 3 + F.col("turn")).alias("document_id"),
        (1 + F.col("turn") % 3).cast("int").alias("version"),
    )


def incoming_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new edition of every labelled document, with the version its author had seen.

    Documents that do not exist yet come from the benchmark passages.
    """
    labels, docs = given(spark, sf_dir, "labels"), given(spark, sf_dir, "documents")
    edited = labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("plant_id"),
        F.concat("source", F.lit("-edited")).alias("title"),
        F.concat("text", F.lit(" (edited)")).alias("content"),
        (1 + (F.col("doc_id") + F.col("quality")) % 3).cast("int").alias("expected_version"),
    )
    added = given(spark, sf_dir, "benchmark").select(
        (F.col("item_id") + 1_000_000_000).alias("document_id"), F.lit(0).cast("long").alias("plant_id"),
        F.concat(F.lit("passage-"), F.col("item_id").cast("string")).alias("title"),
        F.col("text").alias("content"), F.lit(None).cast("int").alias("expected_version"),
    )
    return edited.unionByName(added)


EMBEDDING_MODEL = "m2"


def dated_vectors(bagged: DataFrame) -> DataFrame:
    """A chunk index in which one document in four still has the vector of an older model."""
    model = F.when(F.col("document_id") % 4 == 0, "m1").otherwise(EMBEDDING_MODEL)
    return bagged.withColumn("embedding_model", F.when(F.col("vector").isNotNull(), model))


def distant_questions(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """Questions whose vector is no document's own: the sum of two neighbours'; one in five has none."""
    vectors = given(spark, sf_dir, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v")
    near = vectors.select((F.col("vec_id") - 1).alias("query_id"), F.col("v").alias("_a"))
    far = vectors.select((F.col("vec_id") - 2).alias("query_id"), F.col("v").alias("_b"))
    summed = F.when(F.col("query_id") % 5 != 3, F.zip_with("_a", "_b", lambda a, b: a + b))
    return asked.drop("vector").join(near, "query_id", "left").join(far, "query_id", "left").withColumn(
        "vector", summed
    ).drop("_a", "_b")


def answer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cases: the calls an assistant made in a turn, against what was required."""
    conv, turn = F.col("conv_id"), F.col("turn")
    key = conv + turn

    def call(name, tag) -> object:
        return F.struct(
            F.lit(name).alias("name"), F.create_map(F.lit("tag_id"), tag.cast("string")).alias("args")
        )

    def made(name, tag, ok) -> object:
        return F.struct(
            F.lit(name).alias("name"), ok.alias("success"),
            F.create_map(F.lit("tag_id"), tag.cast("string")).alias("args"),
        )

    first, second = made("find_tags", conv, F.lit(True)), made("tag_trend", conv + key % 2, key % 6 != 0)
    return given(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(
        (conv * 100 + turn).alias("case_id"),
        F.when(key % 3 == 0, "no_answer").otherwise("answered").alias("status"),
        F.array(F.lit("answered")).alias("allowed_statuses"),
        F.array(call("find_tags", conv), call("tag_trend", conv)).alias("required_calls"),
        F.when(key % 5 == 0, F.array(second, first)).otherwise(F.array(first, second)).alias("calls"),
        F.when(key % 7 == 0, F.array(F.lit("tag_trend"))).otherwise(F.array().cast("array<string>"))
        .alias("forbidden_calls"),
        F.array(F.concat(F.lit("e"), conv.cast("string"))).alias("citation_ids"),
        F.array(F.concat(F.lit("e"), (conv + F.when(key % 8 == 0, 1).otherwise(0)).cast("string")))
        .alias("evidence_ids"),
        F.array(F.lit("manual")).alias("required_titles"),
        F.array(F.lit("manual"), F.lit("other")).alias("cited_titles"),
        F.col("text").alias("answer"),
        F.array(F.array(F.lit("the"), F.lit("le"))).alias("term_groups"),
        F.col("text").alias("response_text"),
    )
