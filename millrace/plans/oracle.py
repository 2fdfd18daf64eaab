"""The registered queries in plain SQL, for a side-by-side check in another engine.

``BINDING`` holds the stored tables as common table expressions over the given tables;
each query adds its own. Written for DuckDB's dialect.
"""

from __future__ import annotations

import re

from millrace.plans.workloads import DAMAGE, DIGESTED

BINDING = {
    "plant": """SELECT r_regionkey::BIGINT AS plant_id, r_name AS code, r_name AS name,
        CASE WHEN r_regionkey = 4 THEN 'inactive' ELSE 'active' END AS status,
        NULL::VARCHAR AS location FROM region""",
    "production_line": """SELECT n_nationkey::BIGINT AS line_id, n_regionkey::BIGINT AS plant_id,
        n_name AS code, 'Line ' || n_name AS name,
        CASE WHEN n_nationkey % 11 = 10 THEN 'inactive' ELSE 'active' END AS status FROM nation""",
    "device": """SELECT device_id, device_id // 5 AS line_id, 'DEV_' || (device_id % 10) AS code,
        'Device ' || device_id AS name,
        CASE WHEN device_id % 17 = 13 THEN 'inactive' ELSE 'active' END AS status
        FROM (SELECT DISTINCT c_custkey % 125 AS device_id FROM customer)""",
    "tag": """SELECT c_custkey AS tag_id, c_custkey % 125 AS device_id,
        CASE WHEN c_custkey % 3 = 0 THEN 'T' || (c_custkey // 125) ELSE 'U' || c_custkey END AS code,
        c_name AS name,
        CASE c_custkey % 10 WHEN 3 THEN 'integer' WHEN 5 THEN 'boolean' WHEN 7 THEN 'string'
        ELSE 'float' END AS data_type, 'bar' AS unit, 1.0::DOUBLE AS min_value,
        CASE WHEN c_custkey % 9 <> 0 THEN 200.0::DOUBLE END AS max_value,
        (1000 * (1 + c_custkey % 40))::INT AS sampling_interval_ms,
        c_custkey % 10 <> 0 AS is_enabled FROM customer""",
    "tag_sample": """SELECT event_id AS id,
        CASE WHEN event_id % 5 <> 0 THEN user_id % 125 // 5 END AS task_id,
        CASE WHEN event_id % 5 = 0 THEN user_id % 125 // 5 * 2 + event_id % 2 END AS import_batch_id,
        CASE WHEN event_id % 5 = 0 THEN 'file' ELSE 'opcua' END AS source_type, user_id AS tag_id,
        CASE WHEN event_type = 'signup' THEN props ELSE value::VARCHAR END AS value,
        CASE WHEN event_type <> 'signup' THEN value END AS numeric_value, ts AS source_timestamp,
        CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 1 SECOND END AS server_timestamp,
        ts + INTERVAL 2 SECOND AS received_at,
        CASE WHEN event_type = 'error' THEN 'BadSensorFailure' ELSE 'Good' END AS status_code,
        event_type <> 'error' AS is_good FROM events""",
    "task_counts": """SELECT task_id, count(*) AS received, count(*) FILTER (id % 97 = 0) AS repeated,
        max(source_timestamp) AS last_sample_at FROM tag_sample WHERE source_type = 'opcua'
        GROUP BY task_id""",
    "acquisition_task": """SELECT n_nationkey::BIGINT AS task_id, n_regionkey::BIGINT AS plant_id,
        'TASK-' || n_name AS name,
        CASE n_nationkey % 7 WHEN 5 THEN 'opc.tcp://user:secret@sim:4840'
        WHEN 6 THEN 'http://sim:4840' WHEN 4 THEN 'opc.tcp://other:4840'
        ELSE 'opc.tcp://sim:4840' END AS endpoint_url,
        50 + 50 * (n_nationkey % 4) AS publishing_interval_ms, 100 AS batch_size,
        1 + n_nationkey % 40 * 2 AS reconnect_delay_seconds, 30 AS max_reconnect_delay_seconds,
        CASE WHEN n_nationkey % 6 = 5 THEN 'stopped' ELSE 'running' END AS desired_state,
        CASE WHEN n_nationkey % 4 = 3 THEN 'error' WHEN n_nationkey % 6 = 5 THEN 'stopped'
        ELSE 'connected' END AS connection_state, last_sample_at,
        TIMESTAMP '2024-01-31' - to_seconds(7 * n_nationkey) AS worker_heartbeat_at,
        (n_nationkey % 5)::BIGINT AS error_count, (n_nationkey % 2)::BIGINT AS reconnect_count,
        coalesce(received, 0) AS samples_received, coalesce(received - repeated, 0) AS samples_written,
        coalesce(repeated, 0) AS duplicate_count, (n_nationkey % 3)::BIGINT AS dropped_count
        FROM nation LEFT JOIN task_counts ON task_id = n_nationkey""",
    "acquisition_node": """SELECT c_custkey % 125 // 5 AS task_id, c_custkey AS tag_id,
        'ns=2;s=' || c_name AS node_id, c_custkey % 7 <> 0 AS is_enabled FROM customer""",
    "batch_counts": """SELECT import_batch_id AS batch_id, count(*) AS accepted,
        count(*) FILTER (NOT is_good) AS warned,
        count(*) FILTER (NOT is_good OR coalesce(numeric_value > 200, false)) AS reported
        FROM tag_sample WHERE source_type = 'file' GROUP BY import_batch_id""",
    "import_batch": """SELECT b.batch_id, n_regionkey::BIGINT AS plant_id,
        CASE WHEN k = 1 AND n_nationkey % 2 = 0 THEN b.batch_id - 1 END AS duplicate_of_id,
        'import_' || b.batch_id || CASE WHEN b.batch_id % 3 = 0 THEN '.xlsx' ELSE '.csv' END
        AS original_filename,
        CASE WHEN k = 1 AND n_nationkey % 2 = 0 THEN 'duplicate' WHEN b.batch_id % 8 = 5 THEN 'failed'
        WHEN b.batch_id % 8 = 6 THEN 'processing' ELSE 'completed' END AS status,
        coalesce(accepted, 0) + b.batch_id % 7 AS total_rows, coalesce(accepted, 0) AS accepted_rows,
        b.batch_id % 7 AS rejected_rows, b.batch_id % 3 AS duplicate_rows,
        coalesce(warned, 0) AS warning_rows, coalesce(reported, 0) AS issue_count,
        coalesce(reported, 0) AS stored_issue_count, false AS issues_truncated,
        TIMESTAMP '2024-01-01' + to_hours(b.batch_id) AS created_at
        FROM (SELECT *, (n_nationkey * 2 + k)::BIGINT AS batch_id FROM nation, (VALUES (0), (1)) v(k)) b
        LEFT JOIN batch_counts c ON c.batch_id = b.batch_id""",
    "import_job": """SELECT (n_nationkey * 10 + attempt)::BIGINT AS job_id,
        (n_nationkey * 2)::BIGINT AS batch_id,
        CASE WHEN attempt = n_nationkey % 3 THEN 'completed' ELSE 'failed' END AS status,
        TIMESTAMP '2024-01-02' + to_minutes(least(attempt, 1)) AS created_at
        FROM (SELECT *, unnest(generate_series(0, n_nationkey % 3)) AS attempt FROM nation)""",
    "import_field_mapping": """SELECT (n_nationkey * 2)::BIGINT AS batch_id, f AS target_field
        FROM nation, (VALUES ('timestamp_column'), ('tag_code_column'), ('value_column')) v(f)""",
    "data_quality_issue": """SELECT id, import_batch_id AS batch_id, id + 2 AS row_number,
        CASE WHEN is_good THEN 'out_of_range' ELSE 'bad_quality' END AS issue_type,
        CASE WHEN is_good THEN 'error' ELSE 'warning' END AS severity,
        CASE WHEN is_good THEN 'value' ELSE 'quality' END AS field_name,
        CASE WHEN is_good THEN value ELSE status_code END AS raw_value, 'tag ' || tag_id AS message
        FROM tag_sample WHERE source_type = 'file'
        AND (NOT is_good OR coalesce(numeric_value > 200, false))""",
    "knowledge_document": """SELECT doc_id AS document_id, substring(source, 4)::BIGINT % 5 AS plant_id,
        source || '-' || doc_id AS title, text AS content, 1 + doc_id % 3 AS version,
        sha256(text) AS content_sha256, embedding::DOUBLE[] AS vector
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "question": """SELECT item_id AS query_id, b.text AS query,
        substring(source, 4)::BIGINT % 5 AS plant_id, embedding::DOUBLE[] AS vector
        FROM benchmark b JOIN documents ON doc_id = item_id LEFT JOIN embeddings ON vec_id = item_id""",
    "app_user": """SELECT s_suppkey AS user_id,
        CASE WHEN s_suppkey % 10 = 0 OR s_suppkey % 25 = 1 THEN 'admin'
        WHEN s_suppkey % 2 = 0 THEN 'engineer' ELSE 'observer' END AS role,
        s_suppkey % 10 = 0 OR s_suppkey % 25 = 1 AS is_admin FROM supplier""",
    "user_plant_access": """SELECT s_suppkey AS user_id, (s_nationkey % 5)::BIGINT AS plant_id FROM supplier
        UNION ALL SELECT s_suppkey, (s_nationkey + 1) % 5 FROM supplier WHERE s_suppkey % 3 = 0""",
    "assistant_run": """SELECT conv_id * 100 + turn AS run_id, conv_id % 20 AS user_id,
        conv_id % 5 AS plant_id, TIMESTAMP '2024-01-31' - to_seconds(conv_id % 120) AS created_at
        FROM conversations WHERE role = 'assistant'""",
    "asset": """SELECT t.*, d.line_id, d.code AS device_code, d.name AS device_name,
        d.status AS device_status, l.plant_id, l.code AS line_code, l.name AS line_name,
        l.status AS line_status
        FROM tag t JOIN device d USING (device_id) JOIN production_line l USING (line_id)""",
}

_TIME_TEXT = """CASE WHEN event_id % 31 = 1 THEN '' WHEN event_id % 31 = 2 THEN 'not-a-time'
    WHEN event_id % 3 = 0 THEN strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S.%f')
    WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
    ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+08:00' END"""
_PARSED_TIME = """CASE WHEN ends_with(time, 'Z') THEN try_strptime(time, '%Y-%m-%dT%H:%M:%S.%fZ')
    WHEN ends_with(time, '+08:00')
    THEN try_strptime(left(time, length(time) - 6), '%Y-%m-%dT%H:%M:%S.%f') - INTERVAL 8 HOUR
    ELSE try_strptime(time, '%Y-%m-%d %H:%M:%S.%f') - INTERVAL 8 HOUR END"""
_NUMBER = r"""CASE WHEN regexp_full_match(v,
    '[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?')
    THEN try_cast(replace(v, '_', '') AS DOUBLE) END"""

# Measurements to verdicts. A query supplies ``cell`` with one row per measurement.
CLASSIFY = {
    "cell_typed": f"""SELECT *, trim(value_raw) AS v, lower(trim(value_raw)) AS lv,
        {_PARSED_TIME} AS stamp,
        CASE WHEN quality = '' THEN 'Good' ELSE trim(quality) END AS status_code FROM cell""",
    "usable": """SELECT * FROM asset
        WHERE line_status = 'active' AND device_status = 'active' AND is_enabled""",
    "cell_matched": f"""SELECT c.*, {_NUMBER} AS number,
        lower(c.status_code) IN ('good', 'ok', '192', '0xc0', 'true') AS is_good,
        CASE WHEN c.device <> '' THEN p.n ELSE q.n END AS matches,
        CASE WHEN c.device <> '' THEN p.one ELSE q.one END AS one
        FROM cell_typed c
        LEFT JOIN (SELECT plant_id, lower(device_code) AS dk, lower(code) AS tk, count(*) AS n,
            min(tag_id) AS one FROM usable GROUP BY ALL) p
          ON p.plant_id = c.plant_id AND p.dk = lower(c.device) AND p.tk = lower(trim(c.tag))
        LEFT JOIN (SELECT plant_id, lower(code) AS tk, count(*) AS n, min(tag_id) AS one
            FROM usable GROUP BY ALL) q
          ON q.plant_id = c.plant_id AND q.tk = lower(trim(c.tag))""",
    "cell_valued": """SELECT c.*, CASE WHEN matches = 1 THEN t.tag_id END AS tag_id,
        CASE WHEN matches = 1 THEN t.data_type END AS data_type,
        CASE WHEN matches = 1 THEN t.min_value END AS low,
        CASE WHEN matches = 1 THEN t.max_value END AS high,
        CASE WHEN coalesce(matches, 0) <> 1 THEN CASE WHEN isfinite(number) THEN number END
          WHEN t.data_type = 'string' THEN NULL
          WHEN t.data_type = 'boolean' THEN CASE WHEN lv IN ('1', 'true', 'yes', '是', '开') THEN 1.0
            WHEN lv IN ('0', 'false', 'no', '否', '关') THEN 0.0 END
          WHEN t.data_type = 'integer' THEN CASE WHEN number = floor(number) THEN number END
          ELSE number END::DOUBLE AS numeric_value
        FROM cell_matched c LEFT JOIN tag t ON t.tag_id = c.one AND c.matches = 1""",
    "cell_ruled": """SELECT *, CASE WHEN time = '' THEN 'missing_timestamp'
          WHEN stamp IS NULL THEN 'invalid_timestamp'
          WHEN trim(tag) = '' OR v = '' THEN 'missing_required'
          WHEN coalesce(matches, 0) = 0 AND device <> '' THEN 'unknown_pair'
          WHEN coalesce(matches, 0) = 0 THEN 'unknown_tag'
          WHEN matches > 1 THEN 'ambiguous_tag'
          WHEN data_type = 'string' THEN NULL
          WHEN numeric_value IS NULL AND data_type = 'boolean' THEN 'invalid_boolean'
          WHEN numeric_value IS NULL AND data_type = 'integer' AND number IS NOT NULL THEN 'invalid_integer'
          WHEN numeric_value IS NULL AND lv IN ('nan', 'inf', 'infinity') THEN 'not_finite'
          WHEN numeric_value IS NULL THEN 'invalid_value'
          WHEN numeric_value < low OR coalesce(numeric_value > high, false) THEN 'out_of_range' END AS rule0
        FROM cell_valued""",
    "cell_ranked": """SELECT *, CASE WHEN rule0 IS NULL THEN row_number() OVER (
          PARTITION BY batch_id, tag_id, stamp, rule0 IS NULL ORDER BY source_row, position) END AS copy_no,
        CASE WHEN rule0 IS NULL THEN min(batch_id) OVER (
          PARTITION BY tag_id, stamp, rule0 IS NULL) END AS first_batch FROM cell_ruled""",
    "stored_key": """SELECT DISTINCT tag_id, source_timestamp FROM tag_sample WHERE source_type = 'file'""",
    "verdict": """SELECT r.*, CASE WHEN rule0 IS NOT NULL THEN rule0
          WHEN copy_no > 1 THEN 'duplicate_in_file'
          WHEN first_batch < batch_id OR s.tag_id IS NOT NULL THEN 'duplicate_existing' END AS rule
        FROM cell_ranked r LEFT JOIN stored_key s
          ON s.tag_id = r.tag_id AND s.source_timestamp = r.stamp AND r.rule0 IS NULL""",
    "verdict_typed": """SELECT *, CASE rule WHEN 'missing_timestamp' THEN 'missing_required'
          WHEN 'unknown_pair' THEN 'unknown_tag' WHEN 'invalid_boolean' THEN 'invalid_value'
          WHEN 'invalid_integer' THEN 'invalid_value' WHEN 'not_finite' THEN 'invalid_value'
          ELSE rule END AS issue_type FROM verdict""",
    "found_issue": """
        SELECT batch_id, source_row AS row_number, 'bad_quality' AS issue_type, 'warning' AS severity,
          'quality' AS field_name, quality AS raw_value, -1 AS emit_order,
          '质量码不是 Good；保留原始值并标记为非良好数据' AS message
        FROM verdict_typed WHERE position = 0 AND stamp IS NOT NULL AND NOT is_good
        UNION ALL
        SELECT batch_id, source_row, issue_type, 'error',
          CASE WHEN rule IN ('missing_timestamp', 'invalid_timestamp', 'duplicate_existing') THEN 'time'
            WHEN rule IN ('unknown_pair', 'unknown_tag', 'ambiguous_tag') THEN 'tag' ELSE 'value' END,
          CASE WHEN rule IN ('missing_timestamp', 'invalid_timestamp', 'duplicate_in_file') THEN time
            WHEN rule = 'duplicate_existing' THEN strftime(stamp, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
            WHEN rule IN ('unknown_pair', 'unknown_tag', 'ambiguous_tag') THEN tag ELSE value_raw END,
          position,
          CASE rule WHEN 'missing_timestamp' THEN '数据时间不能为空'
            WHEN 'invalid_timestamp' THEN '时间必须是 ISO 8601 或常见日期时间格式'
            WHEN 'missing_required' THEN '测点编码和值均不能为空'
            WHEN 'unknown_pair' THEN '工厂内不存在该启用设备与测点组合'
            WHEN 'unknown_tag' THEN '工厂内不存在该启用测点编码'
            WHEN 'ambiguous_tag' THEN '测点编码不唯一，请指定设备编码'
            WHEN 'invalid_boolean' THEN '布尔值只能使用 true/false、1/0、是/否或开/关'
            WHEN 'invalid_integer' THEN '整数测点不能导入小数'
            WHEN 'not_finite' THEN '数值不能是 NaN 或无穷大'
            WHEN 'invalid_value' THEN '数值格式无效'
            WHEN 'out_of_range' THEN '数值超出测点范围 [' || coalesce(low::VARCHAR, 'None') || ', '
              || coalesce(high::VARCHAR, 'None') || ']'
            WHEN 'duplicate_in_file' THEN '文件内同一测点和时间戳重复'
            WHEN 'duplicate_existing' THEN '数据库中已存在同一测点和时间戳的文件数据' END
        FROM verdict_typed WHERE rule IS NOT NULL""",
}
RAW_LONG = {
    "cell": f"""SELECT plant_id AS batch_id, plant_id, event_id * 2 + 2 + copy AS source_row, 0 AS position,
        {_TIME_TEXT} AS time,
        CASE WHEN event_id % 37 = 3 THEN '' WHEN event_id % 37 = 4 THEN 'NO_SUCH'
          WHEN event_id % 2 = 0 THEN 'dev_' || (user_id % 125 % 10)
          ELSE 'DEV_' || (user_id % 125 % 10) END AS device,
        CASE WHEN event_id % 41 = 5 THEN '' WHEN event_id % 41 = 6 THEN 'T_UNKNOWN'
          WHEN user_id % 3 = 0 THEN ' T' || (user_id // 125) ELSE ' U' || user_id END AS tag,
        CASE WHEN event_id % 43 = 7 THEN '' WHEN event_id % 43 = 8 THEN 'abc'
          WHEN event_id % 43 = 9 THEN '1_000.5' WHEN event_id % 43 = 10 THEN 'nan'
          WHEN user_id % 10 = 5 THEN ['yes', '0', 'maybe', 'TRUE'][event_id % 4 + 1]
          WHEN user_id % 10 = 3 AND event_id % 2 = 0 THEN floor(value)::BIGINT || '.0'
          WHEN user_id % 10 = 7 THEN ' ' || event_type || ' ' ELSE value::VARCHAR END AS value_raw,
        CASE event_id % 47 WHEN 11 THEN 'BadSensorFailure' WHEN 12 THEN ' 0xC0 ' WHEN 13 THEN ''
          ELSE 'Good' END AS quality, 'value' AS value_field
        FROM (SELECT *, unnest(CASE WHEN event_id % 23 = 5 THEN [0, 1] ELSE [0] END) AS copy FROM events)
        JOIN production_line ON line_id = user_id % 125 // 5""",
}
RAW_WIDE = {
    "wide_row": f"""SELECT event_id % 5 AS batch_id, event_id + 2 AS source_row, {_TIME_TEXT} AS time,
        value::VARCHAR AS m1, (value * 2)::VARCHAR AS m2,
        CASE WHEN event_id % 7 = 0 THEN '' ELSE round(value + 1, 2)::VARCHAR END AS m3, event_type AS m4,
        CASE WHEN event_id % 47 = 11 THEN 'BadSensorFailure' ELSE 'Good' END AS quality FROM events""",
    "cell": """SELECT batch_id, batch_id AS plant_id, source_row, time, quality, position, device, tag,
        value_field, CASE value_field WHEN 'm1' THEN m1 WHEN 'm2' THEN m2 WHEN 'm3' THEN m3 ELSE m4 END
        AS value_raw
        FROM wide_row, (VALUES (0, 'm1', 'U1', ''), (1, 'm2', 'T0', 'DEV_0'), (2, 'm3', 'T1', ''),
          (3, 'm4', 'U7', '')) v(position, value_field, tag, device)""",
}
COUNTERS = {
    "counters": """SELECT batch_id, total_rows, accepted_rows, rejected_rows, duplicate_rows,
        coalesce(warning_rows, 0) AS warning_rows, coalesce(issue_count, 0) AS issue_count
        FROM (SELECT batch_id, count(*) AS total_rows, count(*) FILTER (rule IS NULL) AS accepted_rows,
            count(*) FILTER (rule IS NOT NULL) AS rejected_rows,
            count(*) FILTER (rule IN ('duplicate_in_file', 'duplicate_existing')) AS duplicate_rows
          FROM verdict GROUP BY batch_id)
        LEFT JOIN (SELECT batch_id, count(*) FILTER (severity = 'warning') AS warning_rows,
            count(*) AS issue_count FROM found_issue GROUP BY batch_id) USING (batch_id)""",
}
ADVICE = """CASE issue_type WHEN 'missing_required' THEN '检查字段映射及必填单元格，补齐后重新导入。'
    WHEN 'invalid_timestamp' THEN '检查时间列、时区和日期格式，不要使用批次编号代替时间。'
    WHEN 'invalid_value' THEN '核对测点数据类型及原始单元格，去除非法文本。'
    WHEN 'out_of_range' THEN '核对单位、测点量程和原始记录；不要为通过校验而直接扩大范围。'
    WHEN 'unknown_tag' THEN '核对测点编码、所属设备和工厂；确认主数据后再导入。'
    WHEN 'ambiguous_tag' THEN '补充设备编码以区分同名或同编码测点。'
    WHEN 'duplicate_in_file' THEN '核对文件内同测点同时间的重复记录和保留规则。'
    WHEN 'duplicate_existing' THEN '核对已入库记录，避免重复导入；不要直接删除历史数据。'
    WHEN 'bad_quality' THEN '核对数据源质量码及采集状态；异常质量样本不能视为正常工艺值。' END"""

CHUNKS = {
    "chunk": """SELECT document_id, plant_id, title, version, vector, pos // 600 AS chunk_index,
        pos AS "start", least(pos + 700, length(content)) AS "end", substring(content, pos + 1, 700) AS text,
        'doc:' || document_id || ':v' || version || ':c' || (pos // 600) AS evidence_id
        FROM (SELECT *, unnest(generate_series(0, length(content) - 1, 600)) AS pos FROM knowledge_document)""",
    "posting": """SELECT plant_id, document_id, evidence_id, term, count(*) AS tf FROM (
          SELECT plant_id, document_id, evidence_id, unnest(regexp_extract_all(
            replace(lower(title || ' ' || text), 'ß', 'ss'), '[a-z0-9_]+')) AS term FROM chunk)
        GROUP BY ALL""",
}
RETRIEVAL = {
    **CHUNKS,
    "chunk_length": "SELECT evidence_id, sum(tf) AS length FROM posting GROUP BY evidence_id",
    "plant_stat": """SELECT plant_id, count(*) AS chunk_count, avg(coalesce(length, 0)) AS average_length
        FROM chunk LEFT JOIN chunk_length USING (evidence_id) GROUP BY plant_id""",
    "frequency": "SELECT plant_id, term, count(*) AS df FROM posting GROUP BY ALL",
    "query_term": """SELECT query_id, plant_id, term, count(*) AS qtf FROM (
          SELECT query_id, plant_id, unnest(regexp_extract_all(replace(lower(query), 'ß', 'ss'),
            '[a-z0-9_]+')) AS term FROM question) GROUP BY ALL""",
    "query_length": "SELECT query_id, sum(qtf) AS qlen FROM query_term GROUP BY query_id",
    "lexical_score": """SELECT q.query_id, p.evidence_id, p.document_id,
        (sum(least(p.tf, q.qtf)) / any_value(l.qlen))::DOUBLE AS lexical,
        round(sum(ln(1 + (s.chunk_count - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2
          / (p.tf + 1.2 * (0.25 + 0.75 * c.length / greatest(1.0, s.average_length)))), 10) AS bm25
        FROM query_term q JOIN posting p ON p.plant_id = q.plant_id AND p.term = q.term
        JOIN frequency f ON f.plant_id = q.plant_id AND f.term = q.term
        JOIN plant_stat s ON s.plant_id = q.plant_id
        JOIN chunk_length c ON c.evidence_id = p.evidence_id
        JOIN query_length l ON l.query_id = q.query_id
        GROUP BY q.query_id, p.evidence_id, p.document_id""",
    "semantic_score": """SELECT q.query_id, c.evidence_id, c.document_id,
        round_even(list_cosine_similarity(q.vector, c.vector), 4) AS semantic,
        list_cosine_similarity(q.vector, c.vector) >= 0.5 AS close
        FROM question q JOIN chunk c ON c.plant_id = q.plant_id
        WHERE q.vector IS NOT NULL AND c.vector IS NOT NULL
          AND round_even(list_cosine_similarity(q.vector, c.vector), 4) >= 0.5""",
}


def _evidence(strategy: str) -> dict[str, str]:
    if strategy == "lexical":
        scored = "SELECT *, 0.0::DOUBLE AS semantic FROM lexical_score WHERE lexical >= 0.12"
        score = "1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, evidence_id))"
    else:
        gate = "close" if strategy == "vector" else "lexical >= 0.12 OR close"
        scored = f"""SELECT * FROM (SELECT query_id, evidence_id, document_id,
            coalesce(lexical, 0.0) AS lexical, coalesce(bm25, 0.0) AS bm25,
            coalesce(semantic, 0.0) AS semantic, coalesce(close, false) AS close FROM lexical_score
            FULL JOIN semantic_score USING (query_id, evidence_id, document_id)) WHERE {gate}"""
        score = "semantic" if strategy == "vector" else """
            1 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, evidence_id))
            + CASE WHEN semantic >= 0.5 THEN 1 / (60 + row_number() OVER (PARTITION BY query_id
              ORDER BY CASE WHEN semantic >= 0.5 THEN semantic ELSE -2 END DESC, evidence_id)) ELSE 0 END"""
    semantic = "semantic" if strategy == "lexical" else """CASE WHEN semantic >= 0.5 THEN semantic ELSE
            coalesce(round_even(list_cosine_similarity(q.vector, c.vector), 4), 0.0) END"""
    return {
        **RETRIEVAL,
        "admitted": scored,
        "fused": f"SELECT *, {score} AS score FROM admitted",
        "capped": """SELECT *, row_number() OVER (PARTITION BY query_id, document_id
            ORDER BY score DESC, evidence_id) AS nth FROM fused""",
        "evidence": f"""SELECT e.query_id, e.rank, e.evidence_id, e.document_id, c.title, c."start", c."end",
            round_even(lexical, 4) AS lexical_score, {semantic} AS semantic_score, round_even(bm25, 4) AS bm25_score,
            round_even(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
              ORDER BY score DESC, evidence_id) AS rank FROM capped WHERE nth <= 2) e
            JOIN chunk c USING (evidence_id) JOIN question q ON q.query_id = e.query_id WHERE e.rank <= 5""",
    }


# Vectors of one document in four are of an older model and are not compared; a question's vector is the sum
# of those of the two documents after its own, and one question in five has none.
PAYLOAD = {
    **_evidence("auto"),
    "knowledge_document": """SELECT doc_id AS document_id, substring(source, 4)::BIGINT % 5 AS plant_id,
        source || '-' || doc_id AS title, text AS content, 1 + doc_id % 3 AS version, sha256(text) AS content_sha256,
        CASE WHEN doc_id % 4 <> 0 THEN embedding::DOUBLE[] END AS vector
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "question": """SELECT item_id AS query_id, b.text AS query, substring(source, 4)::BIGINT % 5 AS plant_id,
        CASE WHEN item_id % 5 <> 3 THEN list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]),
          lambda p: p[1] + p[2]) END AS vector
        FROM benchmark b JOIN documents ON doc_id = item_id LEFT JOIN embeddings x ON x.vec_id = item_id + 1
        LEFT JOIN embeddings y ON y.vec_id = item_id + 2""",
    "compared": "SELECT DISTINCT plant_id FROM chunk WHERE vector IS NOT NULL",
}
METRICS = {
    **_evidence("auto"),
    "title_place": """SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY best, title)
        AS place FROM (SELECT query_id, title, min(rank) AS best FROM evidence GROUP BY ALL)""",
    "required": """SELECT DISTINCT query_id, title FROM question
        JOIN knowledge_document ON document_id = query_id JOIN labels ON doc_id = query_id AND quality = 1""",
    "per_query": """SELECT query_id, count(*) AS returned,
        count(*) FILTER (r.title IS NOT NULL) AS hits, min(place) FILTER (r.title IS NOT NULL) AS first_hit
        FROM title_place t LEFT JOIN required r USING (query_id, title) WHERE place <= 5 GROUP BY query_id""",
    "metrics": """SELECT query_id, coalesce(returned, 0) AS returned_titles,
        CASE WHEN needed > 0 THEN coalesce(hits, 0) / needed END AS recall,
        CASE WHEN needed > 0 THEN coalesce(hits, 0) = needed END AS all_sources,
        CASE WHEN needed > 0 THEN coalesce(1 / first_hit, 0.0) END AS reciprocal_rank,
        CASE WHEN needed IS NULL THEN coalesce(returned, 0) > 0 END AS returned_on_unanswerable
        FROM question LEFT JOIN per_query USING (query_id)
        LEFT JOIN (SELECT query_id, count(*) AS needed FROM required GROUP BY query_id) USING (query_id)""",
}

# A subset of plants with everything below it; the rest of each table is its complement.
SCOPE = {
    "in_plant": "SELECT plant_id FROM plant WHERE plant_id < 2",
    "in_line": "SELECT line_id FROM production_line WHERE plant_id IN (FROM in_plant)",
    "in_device": "SELECT device_id FROM device WHERE line_id IN (FROM in_line)",
    "in_tag": "SELECT tag_id FROM tag WHERE device_id IN (FROM in_device)",
    "in_task": "SELECT task_id FROM acquisition_task WHERE plant_id IN (FROM in_plant)",
    "in_batch": "SELECT batch_id FROM import_batch WHERE plant_id IN (FROM in_plant)",
    "scoped_sample": """SELECT *, tag_id IN (FROM in_tag) AS tag_in,
        coalesce(task_id IN (FROM in_task), false) AS task_in,
        coalesce(import_batch_id IN (FROM in_batch), false) AS batch_in FROM tag_sample""",
    "scoped_node": """SELECT *, tag_id IN (FROM in_tag) AS tag_in, task_id IN (FROM in_task) AS task_in
        FROM acquisition_node""",
}

SNAPSHOT = {
    "daily": """SELECT task_id, source_timestamp::DATE AS day, count(*) AS n,
        count(*) FILTER (id % 97 = 0) AS d FROM tag_sample WHERE source_type = 'opcua' GROUP BY ALL""",
    "snapshot": """SELECT task_id, day::TIMESTAMP + INTERVAL 1 DAY AS taken_at,
        CASE WHEN (task_id + dayofmonth(day)) % 11 = 0 THEN 'reconnecting' ELSE 'connected' END
        AS connection_state,
        sum(n) OVER w AS received, sum(n - d) OVER w AS written, sum(d) OVER w AS duplicates,
        CASE WHEN task_id % 4 = 1 THEN dayofmonth(day) ELSE 0 END AS dropped,
        CASE WHEN task_id % 4 = 2 THEN dayofmonth(day) ELSE 0 END AS errors,
        (task_id * dayofmonth(day) % 20)::DOUBLE AS heartbeat_age,
        row_number() OVER w AS nth FROM daily
        WINDOW w AS (PARTITION BY task_id ORDER BY day ROWS UNBOUNDED PRECEDING)""",
}
NOTIFIED = {
    "notification": """SELECT event_id * 2 + copy AS seq, user_id % 125 // 5 AS task_id,
        CASE WHEN event_id % 29 = 3 THEN 'ns=9;s=' ELSE 'ns=2;s=' END || printf('Customer#%09d', user_id)
        AS node_id, CASE WHEN event_type <> 'signup' THEN value END AS numeric_value,
        ts + to_seconds(2 + copy) AS received_at,
        coalesce(CASE WHEN event_id % 53 <> 0 THEN ts END, ts + to_seconds(2 + copy)) AS stamp
        FROM (SELECT *, unnest(CASE WHEN event_id % 9 = 4 THEN [0, 1] ELSE [0] END) AS copy FROM events)""",
    "mapped": """SELECT n.*, m.tag_id, row_number() OVER (PARTITION BY n.task_id, m.tag_id, stamp
          ORDER BY received_at, seq) AS nth
        FROM notification n LEFT JOIN (SELECT a.* FROM acquisition_node a JOIN acquisition_task t
          USING (task_id) WHERE a.is_enabled AND t.desired_state = 'running') m
          ON m.task_id = n.task_id AND m.node_id = n.node_id""",
}
REQUEST = {
    "request": """SELECT o_orderkey AS request_id, o_custkey % 120 AS user_id, o_orderkey % 7 AS plant_id,
        o_orderstatus = 'F' AS write FROM orders""",
    "proposal": """SELECT o_orderkey AS mapping_id, o_orderkey % 25 AS task_id,
        CASE WHEN o_orderkey % 101 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS tag_id,
        trim(CASE WHEN o_orderkey % 50 = 7 THEN '  '
          ELSE ' ns=2;s=' || o_custkey || '.' || (o_orderkey % 3) END) AS node_id FROM orders""",
}
INCOMING = {
    "incoming": """SELECT doc_id AS document_id, 0::BIGINT AS plant_id, source || '-edited' AS title,
        text || ' (edited)' AS content, 1 + (doc_id + quality) % 3 AS expected_version
        FROM labels JOIN documents USING (doc_id)
        UNION ALL SELECT item_id + 1000000000, 0, 'passage-' || item_id, text, NULL FROM benchmark""",
}
FRESH = {
    "aged": """SELECT a.*, s.id, s.value, s.source_type, s.source_timestamp, s.is_good, s.status_code,
        epoch_us(TIMESTAMP '2024-01-31') - epoch_us(s.source_timestamp) AS age_us,
        (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(s.source_timestamp)) / 1000000.0 AS age,
        greatest(60.0, 3 * a.sampling_interval_ms / 1000.0)::DOUBLE AS limit_s
        FROM asset a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY tag_id
          ORDER BY source_timestamp DESC, id DESC) AS n FROM tag_sample) s
          ON s.tag_id = a.tag_id AND s.n = 1""",
}


TREND = {
    "recent": """SELECT *, row_number() OVER (PARTITION BY tag_id
        ORDER BY source_timestamp DESC, id DESC) AS n FROM tag_sample
        WHERE source_type = 'opcua' AND source_timestamp
          BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-31'""",
    "summary": """SELECT tag_id, count(*) AS sample_count,
        count(*) FILTER (NOT is_good) AS bad_quality_count,
        count(numeric_value) FILTER (is_good) AS good_numeric_count,
        min(numeric_value) FILTER (is_good) AS minimum,
        max(numeric_value) FILTER (is_good) AS maximum,
        avg(numeric_value) FILTER (is_good) AS mean,
        arg_min(numeric_value, n) FILTER (is_good AND numeric_value IS NOT NULL)
        - arg_max(numeric_value, n) FILTER (is_good AND numeric_value IS NOT NULL)
        AS change, min(source_timestamp) AS first_timestamp,
        max(source_timestamp) AS last_timestamp FROM recent GROUP BY tag_id""",
    "trend": """SELECT plant_id, a.tag_id, code, name, unit, is_enabled AS enabled,
        coalesce(sample_count, 0) AS sample_count, coalesce(bad_quality_count, 0) AS bad_quality_count,
        coalesce(good_numeric_count, 0) AS good_numeric_count, false AS truncated,
        minimum, maximum, round(mean, 6) AS mean,
        CASE WHEN good_numeric_count > 1 THEN round(change, 6) END AS first_to_last_change,
        first_timestamp, last_timestamp FROM asset a LEFT JOIN summary s ON s.tag_id = a.tag_id""",
}


def _local(column: str) -> str:
    return (
        f"coalesce(strftime({column} + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00', '暂无')"
    )


_RULES_UNIQUE = {
    "plant_code_unique": ("plant", "code"), "line_code_unique": ("production_line", "plant_id, code"),
    "device_code_unique": ("device", "line_id, code"), "tag_code_unique": ("tag", "device_id, code"),
    "node_tag_unique": ("acquisition_node", "tag_id"),
    "node_id_unique": ("acquisition_node", "task_id, node_id"),
    "live_sample_unique": (
        "(FROM tag_sample WHERE source_type = 'opcua')", "task_id, tag_id, source_timestamp"
    ),
    "file_sample_unique": ("(FROM tag_sample WHERE source_type = 'file')", "tag_id, source_timestamp"),
}
_RULES_REFERENCE = {
    "line_plant": ("production_line", "plant_id", "plant", "plant_id"),
    "device_line": ("device", "line_id", "production_line", "line_id"),
    "tag_device": ("tag", "device_id", "device", "device_id"),
    "node_tag": ("acquisition_node", "tag_id", "tag", "tag_id"),
    "node_task": ("acquisition_node", "task_id", "acquisition_task", "task_id"),
    "sample_tag": ("tag_sample", "tag_id", "tag", "tag_id"),
    "sample_task": ("tag_sample", "task_id", "acquisition_task", "task_id"),
    "sample_batch": ("tag_sample", "import_batch_id", "import_batch", "batch_id"),
    "issue_batch": ("data_quality_issue", "batch_id", "import_batch", "batch_id"),
    "grant_plant": ("user_plant_access", "plant_id", "plant", "plant_id"),
}
_RULES_CHECK = {
    "tag_range": ("tag", "min_value > max_value"),
    "sample_source": (
        "tag_sample",
        "NOT CASE WHEN source_type = 'opcua' THEN task_id IS NOT NULL AND import_batch_id IS NULL "
        "ELSE task_id IS NULL AND import_batch_id IS NOT NULL END",
    ),
    "tag_code_format": ("tag", "NOT regexp_full_match(code, '[A-Z0-9][A-Z0-9_-]*')"),
    "tag_sampling_interval": ("tag", "sampling_interval_ms NOT BETWEEN 100 AND 86400000"),
    "task_publishing_interval": ("acquisition_task", "publishing_interval_ms NOT BETWEEN 100 AND 60000"),
    "task_batch_size": ("acquisition_task", "batch_size NOT BETWEEN 1 AND 2000"),
    "task_first_delay": ("acquisition_task", "reconnect_delay_seconds NOT BETWEEN 1 AND 300"),
    "task_last_delay": ("acquisition_task", "max_reconnect_delay_seconds NOT BETWEEN 1 AND 900"),
    "task_delay_order": ("acquisition_task", "reconnect_delay_seconds > max_reconnect_delay_seconds"),
    "task_node_count": (
        "(SELECT task_id, count(*) AS n FROM acquisition_node GROUP BY task_id)", "n NOT BETWEEN 1 AND 200"
    ),
    "task_endpoint": (
        "acquisition_task",
        "NOT (starts_with(endpoint_url, 'opc.tcp://sim:') AND NOT contains(endpoint_url, '@'))",
    ),
    "document_title_length": ("knowledge_document", "length(title) NOT BETWEEN 1 AND 200"),
    "document_content_length": ("knowledge_document", "length(content) NOT BETWEEN 10 AND 30000"),
}


def _complete(keys: str) -> str:
    return " AND ".join(f"{key} IS NOT NULL" for key in keys.split(", "))


def _integrity() -> str:
    parts = [
        f"SELECT '{rule}' AS rule, count(*) AS violations FROM "
        f"(SELECT {keys} FROM {table} WHERE {_complete(keys)} GROUP BY {keys} HAVING count(*) > 1)"
        for rule, (table, keys) in _RULES_UNIQUE.items()
    ]
    parts += [
        f"SELECT '{rule}', count(*) FROM {child} c WHERE c.{column} IS NOT NULL "
        f"AND c.{column} NOT IN (SELECT {key} FROM {parent})"
        for rule, (child, column, parent, key) in _RULES_REFERENCE.items()
    ]
    parts += [
        f"SELECT '{rule}', count(*) FROM {table} WHERE {check}"
        for rule, (table, check) in _RULES_CHECK.items()
    ]
    return " UNION ALL ".join(parts)


_BROKEN = {
    f"broken_{name}": f"SELECT * REPLACE ({', '.join(f'{sql} AS {column}' for column, sql in changes.items())}) FROM {name}"
    for name, changes in DAMAGE.items()
}


def _integrity_of_broken() -> str:
    """The audit over the damaged copies of the tables."""
    return re.sub(rf"\b({'|'.join(DAMAGE)})\b", r"broken_\1", _integrity())


_DIGEST_CELLS = {
    "whole": "{c}::VARCHAR", "text": "{c}", "flag": "{c}::VARCHAR", "time": "epoch_us({c})::VARCHAR",
    "number": "floor({c} * 1000000 + 0.5)::BIGINT::VARCHAR",
}


def _digest(state: str, name: str, source: str) -> str:
    cells = ", ".join(f"coalesce({_DIGEST_CELLS[kind].format(c=column)}, chr(30))" for column, kind in DIGESTED[name].items())
    return (
        f"SELECT '{state}' AS state, '{name}' AS table_name, count(*) AS row_count, "
        f"(coalesce(sum(('0x' || substr(md5(concat_ws(chr(31), {cells})), 1, 15))::BIGINT), 0) % 2305843009213693952)::BIGINT AS digest FROM {source}"
    )


def _digests() -> str:
    """Digests of the tables, which a restored subset has to give again, of damaged ones, and of the tags in scope."""
    parts = [_digest(state, name, name) for state in ("before", "restored") for name in DIGESTED]
    parts += [_digest("damaged", name, f"broken_{name}") for name in DIGESTED]
    lines = "SELECT line_id FROM production_line WHERE plant_id < 2"
    inside = f"(FROM tag WHERE device_id IN (SELECT device_id FROM device WHERE line_id IN ({lines})))"
    return " UNION ALL ".join([*parts, _digest("inside", "tag", inside)])


def _subset_counts() -> str:
    inside = {
        "plant": ("plant", "plant_id IN (FROM in_plant)"),
        "production_line": ("production_line", "line_id IN (FROM in_line)"),
        "device": ("device", "device_id IN (FROM in_device)"),
        "tag": ("tag", "tag_id IN (FROM in_tag)"),
        "acquisition_task": ("acquisition_task", "task_id IN (FROM in_task)"),
        "acquisition_node": ("scoped_node", "tag_in OR task_in"),
        "import_batch": ("import_batch", "batch_id IN (FROM in_batch)"),
        "import_field_mapping": ("import_field_mapping", "batch_id IN (FROM in_batch)"),
        "import_job": ("import_job", "batch_id IN (FROM in_batch)"),
        "data_quality_issue": ("data_quality_issue", "batch_id IN (FROM in_batch)"),
        "tag_sample": ("scoped_sample", "tag_in OR task_in OR batch_in"),
        "knowledge_document": ("knowledge_document", "plant_id IN (FROM in_plant)"),
        "assistant_run": ("assistant_run", "plant_id IN (FROM in_plant)"),
        "user_plant_access": ("user_plant_access", "plant_id IN (FROM in_plant)"),
    }
    parts = [
        f"SELECT '{name}' AS table_name, count(*) FILTER ({test}) AS inside_rows, "
        f"count(*) FILTER (NOT ({test})) AS outside_rows FROM {table}"
        for name, (table, test) in inside.items()
    ]
    return " UNION ALL ".join([*parts, "SELECT 'retention_preview', 0, 0"])


_READABLE = """SELECT s.id AS sample_id, s.source_type, s.task_id, k.name AS task_name, s.import_batch_id,
    b.original_filename AS import_filename, a.plant_id, p.code AS plant_code, p.name AS plant_name,
    a.line_id AS production_line_id, a.line_code AS production_line_code,
    a.line_name AS production_line_name, a.device_id, a.device_code, a.device_name, s.tag_id,
    a.code AS tag_code, a.name AS tag_name, a.data_type, a.unit, a.sampling_interval_ms, s.value,
    s.numeric_value, s.source_timestamp, s.server_timestamp, s.received_at, s.status_code, s.is_good
    FROM tag_sample s JOIN asset a ON a.tag_id = s.tag_id JOIN plant p ON p.plant_id = a.plant_id
    {join} JOIN acquisition_task k ON k.task_id = s.task_id
    LEFT JOIN import_batch b ON b.batch_id = s.import_batch_id"""

_DASHBOARD = {
    "board": """SELECT p.plant_id, 1 AS plant_count,
        (SELECT count(*) FROM production_line x WHERE x.plant_id = p.plant_id) AS production_line_count,
        (SELECT count(*) FROM device x JOIN production_line l USING (line_id)
          WHERE l.plant_id = p.plant_id) AS device_count,
        (SELECT count(*) FROM asset x WHERE x.plant_id = p.plant_id) AS tag_count,
        (SELECT count(*) FROM asset x WHERE x.plant_id = p.plant_id AND x.is_enabled) AS enabled_tag_count,
        (SELECT count(*) FROM acquisition_task x WHERE x.plant_id = p.plant_id) AS acquisition_task_count,
        (SELECT count(*) FROM acquisition_task x WHERE x.plant_id = p.plant_id
          AND x.desired_state = 'running') AS running_task_count,
        (SELECT count(*) FROM acquisition_task x WHERE x.plant_id = p.plant_id
          AND x.connection_state = 'connected') AS connected_task_count,
        (SELECT count(*) FROM tag_sample s JOIN asset x USING (tag_id)
          WHERE x.plant_id = p.plant_id) AS sample_count,
        (SELECT max(source_timestamp) FROM tag_sample s JOIN asset x USING (tag_id)
          WHERE x.plant_id = p.plant_id) AS latest_sample_at,
        (SELECT count(*) FROM import_batch x WHERE x.plant_id = p.plant_id) AS import_batch_count,
        (SELECT count(*) FROM import_batch x WHERE x.plant_id = p.plant_id
          AND x.status = 'completed') AS completed_import_batch_count,
        (SELECT count(*) FROM data_quality_issue i JOIN import_batch x USING (batch_id)
          WHERE x.plant_id = p.plant_id) AS quality_issue_count FROM plant p""",
    "may_read": """SELECT user_id, plant_id FROM app_user, plant WHERE is_admin
        UNION SELECT user_id, plant_id FROM user_plant_access JOIN app_user USING (user_id)
        WHERE NOT is_admin""",
}
_BOARD_COUNTS = (
    "plant_count", "production_line_count", "device_count", "tag_count", "enabled_tag_count",
    "acquisition_task_count", "running_task_count", "connected_task_count", "sample_count",
    "import_batch_count", "completed_import_batch_count", "quality_issue_count",
)
_VERDICT = {**RAW_LONG, **CLASSIFY}

QUERIES: dict[str, tuple[dict[str, str], str]] = {
    "latest_task_values": ({}, """SELECT n.task_id, n.tag_id, n.node_id, t.code AS tag_code,
        t.name AS tag_name, t.data_type, t.unit, t.sampling_interval_ms, s.id AS sample_id, s.value,
        s.numeric_value, s.source_timestamp, s.server_timestamp, s.received_at, s.status_code, s.is_good
        FROM acquisition_node n JOIN tag t ON t.tag_id = n.tag_id
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY task_id, tag_id
          ORDER BY source_timestamp DESC, id DESC) AS r FROM tag_sample WHERE source_type = 'opcua') s
          ON s.task_id = n.task_id AND s.tag_id = n.tag_id AND s.r = 1 WHERE n.is_enabled"""),
    "latest_by_rank": ({}, """SELECT task_id, tag_id, id, value, numeric_value, source_timestamp, is_good
        FROM (SELECT *, row_number() OVER (PARTITION BY task_id, tag_id
          ORDER BY source_timestamp DESC, id DESC) AS r FROM tag_sample WHERE source_type = 'opcua')
        WHERE r = 1"""),
    "latest_value_freshness": (FRESH, """SELECT plant_id, tag_id, code, name, unit, is_enabled AS enabled,
        limit_s AS stale_after_seconds, id AS sample_id, value, source_type AS source, source_timestamp,
        is_good, status_code, round_even(age::DOUBLE, 1) AS age_seconds, age > limit_s AS stale,
        age < -5 AS future_timestamp,
        CASE WHEN id IS NULL THEN NULL WHEN age < -5 THEN '时间超前，请检查时钟'
          WHEN greatest(age, 0) < 60 THEN round(greatest(age, 0), 1)::DECIMAL(20, 1) || ' 秒'
          WHEN age < 3600 THEN (age_us // 60000000) || ' 分钟'
          WHEN age < 86400 THEN (age_us // 3600000000) || ' 小时'
          ELSE (age_us // 86400000000) || ' 天 ' || (age_us % 86400000000 // 3600000000) || ' 小时' END
        AS age_text,
        array_to_string(list_filter([CASE WHEN NOT is_enabled THEN '测点已禁用' END,
          CASE WHEN id IS NULL THEN '指定来源没有样本，无法提供当前值' END,
          CASE WHEN NOT is_good THEN '质量码异常（' || status_code || '）' END,
          CASE WHEN age > limit_s THEN '数据已过期' END,
          CASE WHEN age < -5 THEN '采样时间超前，请核对时钟' END,
          CASE WHEN source_type = 'file' THEN '来源为历史文件导入，不是实时采集' END],
          lambda x: x IS NOT NULL), '；') AS cautions FROM aged"""),
    "readable_samples": ({}, _READABLE.format(join="LEFT")),
    "readable_live_samples": ({}, _READABLE.format(join="")),
    "tag_history_page": ({}, """SELECT id, tag_id, source_timestamp, value, numeric_value, is_good, rank,
        total_count, bad_count FROM (SELECT *, row_number() OVER (PARTITION BY tag_id
          ORDER BY source_timestamp DESC, id DESC) AS rank, count(*) OVER (PARTITION BY tag_id)
          AS total_count, count(*) FILTER (NOT is_good) OVER (PARTITION BY tag_id) AS bad_count
          FROM tag_sample) WHERE rank <= 5"""),
    "tag_history_filtered": ({}, """SELECT id, task_id, tag_id, source_timestamp, value, is_good, count(*) OVER () AS total_count
        FROM tag_sample WHERE tag_id = 7 AND task_id = 1 AND is_good AND source_timestamp BETWEEN TIMESTAMP '2024-01-03'
          AND TIMESTAMP '2024-01-28' ORDER BY source_timestamp DESC, id DESC LIMIT 3"""),
    "samples_of_both_sources": ({}, """SELECT source_type, tag_id, count(*) AS samples, count(task_id) AS with_task,
        count(import_batch_id) AS with_batch FROM tag_sample GROUP BY ALL"""),
    "tag_trend_all": (TREND, "SELECT * FROM trend"),
    "trend_facts": (TREND, f"""SELECT plant_id, tag_id,
        '测点 ' || code || '（' || name || '）；来源 opcua；测点'
        || CASE WHEN enabled THEN '已启用' ELSE '已禁用' END || '。' || chr(10)
        || '请求时间范围：2024-01-30T08:00:00+08:00 至 2024-01-31T08:00:00+08:00。' || chr(10)
        || '返回 ' || sample_count || ' 条；Good数值 ' || good_numeric_count || ' 条；坏质量 '
        || bad_quality_count || ' 条。' || chr(10)
        || CASE WHEN good_numeric_count > 0 THEN '均值 ' || printf('%.6f', mean) || ' bar；最小值 '
          || printf('%.6f', minimum) || ' bar；最大值 ' || printf('%.6f', maximum) || ' bar。' || chr(10)
          || CASE WHEN first_to_last_change IS NOT NULL THEN '首末差 '
            || printf('%.6f', first_to_last_change) || ' bar。' || chr(10)
            ELSE '不足两个有效数值，无法计算首末差。' || chr(10) END
          || '返回样本首末时间：' || {_local("first_timestamp")} || ' 至 ' || {_local("last_timestamp")}
          || '。' || chr(10)
          ELSE '没有有效Good数值样本，不能计算均值或极值，不能解释为零。' || chr(10) END
        || '数值统计排除坏质量和非数值样本；Good不等于工艺合格，首末差不是趋势斜率，不进行故障根因判断或预测。'
        AS facts FROM trend"""),
    "quality_segments": ({}, """SELECT source_type, tag_id, segment::BIGINT AS segment, count(*) AS points,
        min(source_timestamp) AS start_at, max(source_timestamp) AS end_at FROM (
          SELECT *, sum(CASE WHEN is_good THEN 0 ELSE 1 END) OVER (PARTITION BY source_type, tag_id
            ORDER BY source_timestamp, id ROWS UNBOUNDED PRECEDING) AS segment FROM tag_sample)
        WHERE is_good GROUP BY ALL"""),
    "series_position": ({}, """SELECT source_type, tag_id, id,
        CASE WHEN t0 = t1 THEN 0.5 ELSE round((epoch_us(source_timestamp) - epoch_us(t0)) / 1000000.0
          / ((epoch_us(t1) - epoch_us(t0)) / 1000000.0), 6) END::DOUBLE AS time_position,
        round((numeric_value - v0) / CASE WHEN v1 = v0 THEN 1 ELSE v1 - v0 END, 6) AS value_position
        FROM (SELECT *, min(source_timestamp) OVER w AS t0, max(source_timestamp) OVER w AS t1,
          min(numeric_value) OVER w AS v0, max(numeric_value) OVER w AS v1 FROM tag_sample
          WHERE numeric_value IS NOT NULL WINDOW w AS (PARTITION BY source_type, tag_id))"""),
    "frames_to_long": ({}, """SELECT ts AS timestamp, c AS tag_code,
        CASE WHEN c = 'FLOW' THEN value * 2 ELSE value END AS value,
        CASE WHEN c = 'FLOW' AND event_type = 'error' THEN 'BadSensorFailure' ELSE 'Good' END AS quality_code
        FROM events, (VALUES ('PRESSURE'), ('FLOW')) v(c)"""),
    "replay_phases": ({}, """SELECT tag_id, CASE WHEN h < 60 THEN '正常基线' WHEN h < 120 THEN '注入扰动'
        ELSE '恢复观察' END AS phase, count(*) AS samples FROM (SELECT tag_id,
          (epoch_us(source_timestamp) - epoch_us(min(source_timestamp) OVER (PARTITION BY tag_id)))
          / 1000000.0 / 3600 AS h FROM tag_sample) GROUP BY ALL"""),
    "task_nodes": ({}, """SELECT k.task_id, k.name AS task_name, n.tag_id, n.node_id,
        n.is_enabled AS node_enabled, t.code AS tag_code, t.name AS tag_name, t.unit
        FROM acquisition_task k LEFT JOIN (acquisition_node n JOIN tag t ON t.tag_id = n.tag_id)
        ON n.task_id = k.task_id"""),
    "cross_plant_tasks": (REQUEST, """SELECT r.task_id, r.tag_id, mapping_id, k.plant_id AS task_plant_id,
        a.plant_id AS tag_plant_id FROM proposal r JOIN acquisition_task k ON k.task_id = r.task_id
        JOIN asset a ON a.tag_id = r.tag_id WHERE k.plant_id <> a.plant_id"""),
    "access_decisions": (REQUEST, """SELECT r.user_id, r.plant_id, request_id, write,
        CASE WHEN coalesce(u.is_admin, false) THEN 'allowed'
          WHEN write AND coalesce(u.role, '') <> 'engineer' THEN 'denied_role'
          WHEN g.user_id IS NULL THEN 'denied_plant' ELSE 'allowed' END AS decision
        FROM request r LEFT JOIN app_user u ON u.user_id = r.user_id
        LEFT JOIN (SELECT DISTINCT * FROM user_plant_access) g
          ON g.user_id = r.user_id AND g.plant_id = r.plant_id"""),
    "missing_plants": (REQUEST, """SELECT request_id, plant_id FROM request
        WHERE plant_id NOT IN (SELECT plant_id FROM plant)"""),
    "mapping_options": ({}, """SELECT plant_id, tag_id, code AS tag_code, name AS tag_name, device_id,
        device_code, device_name FROM asset
        WHERE line_status = 'active' AND device_status = 'active' AND is_enabled"""),
    "tags_by_plant": ({}, """SELECT p.code AS plant_code, tag_id, a.code AS tag_code, device_code, line_code
        FROM asset a JOIN plant p USING (plant_id) WHERE p.status = 'active'
        AND line_status = 'active' AND device_status = 'active' AND is_enabled"""),
    "parent_names": ({}, """SELECT d.device_id, d.name AS device_name, l.name AS line_name,
        p.name AS plant_name FROM device d LEFT JOIN production_line l USING (line_id)
        LEFT JOIN plant p USING (plant_id)"""),
    "scoped_samples": ({}, """SELECT plant_id, is_enabled, count(*) AS samples, count(DISTINCT tag_id) AS tags
        FROM tag_sample JOIN asset USING (tag_id)
        WHERE plant_id IN (SELECT plant_id FROM user_plant_access WHERE user_id = 3) GROUP BY ALL"""),
    "dashboard_by_user": (_DASHBOARD, "SELECT user_id, "
        + ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in _BOARD_COUNTS)
        + """, max(latest_sample_at) AS latest_sample_at FROM app_user LEFT JOIN may_read USING (user_id)
        LEFT JOIN board USING (plant_id) GROUP BY user_id"""),
    "asset_overview": ({}, """SELECT p.plant_id, line_count, device_count, tag_count, device_id, device, line,
        device_tag_count, device_count > 5 AS truncated FROM (
          SELECT p.plant_id, count(DISTINCT l.line_id) AS line_count, count(DISTINCT d.device_id)
          AS device_count, count(t.tag_id) AS tag_count FROM plant p
          LEFT JOIN production_line l ON l.plant_id = p.plant_id LEFT JOIN device d ON d.line_id = l.line_id
          LEFT JOIN tag t ON t.device_id = d.device_id GROUP BY p.plant_id) p
        LEFT JOIN (SELECT l.plant_id, d.device_id, d.name AS device, l.name AS line,
            count(t.tag_id) AS device_tag_count,
            row_number() OVER (PARTITION BY l.plant_id ORDER BY d.device_id) AS r
          FROM device d JOIN production_line l USING (line_id) LEFT JOIN tag t ON t.device_id = d.device_id
          GROUP BY l.plant_id, d.device_id, d.name, l.name) x ON x.plant_id = p.plant_id AND r <= 5"""),
    "device_facts": ({}, """SELECT plant_id, device_id, line || ' / ' || device || '：' || n || ' 个测点。'
        AS facts FROM (SELECT l.plant_id, d.device_id, d.name AS device, l.name AS line,
          count(t.tag_id) AS n, row_number() OVER (PARTITION BY l.plant_id ORDER BY d.device_id) AS r
          FROM device d JOIN production_line l USING (line_id) LEFT JOIN tag t ON t.device_id = d.device_id
          GROUP BY l.plant_id, d.device_id, d.name, l.name) WHERE r <= 30"""),
    "all_device_facts": ({}, """SELECT l.plant_id, d.device_id, l.name || ' / ' || d.name || '：' || count(t.tag_id)
        || ' 个测点。' AS facts FROM device d JOIN production_line l USING (line_id)
        LEFT JOIN tag t ON t.device_id = d.device_id GROUP BY l.plant_id, d.device_id, d.name, l.name"""),
    "find_tags": ({}, """SELECT plant_id, rank, tag_id, code, name, device, unit, enabled, total > 20 AS truncated
        FROM (SELECT plant_id, tag_id, code, name, device_name AS device, unit, is_enabled AS enabled,
          row_number() OVER (PARTITION BY plant_id ORDER BY code, tag_id) AS rank,
          count(*) OVER (PARTITION BY plant_id) AS total FROM asset
          WHERE contains(name, '1') OR contains(code, '1') OR contains(device_name, '1')) WHERE rank <= 20"""),
    "search_nodes": ({}, """SELECT n.task_id, n.tag_id, n.node_id, n.is_enabled, t.code, t.name
        FROM acquisition_node n JOIN tag t ON t.tag_id = n.tag_id
        WHERE contains(lower(t.code || ' ' || t.name || ' ' || n.node_id), 'ns=2;s=customer#00000001')"""),
    "asset_lists": ({}, """SELECT 'plant' AS kind, plant_id AS id, NULL::BIGINT AS parent_id, code, name, status FROM plant
          WHERE status = 'active'
        UNION ALL SELECT 'line', line_id, plant_id, code, name, status FROM production_line WHERE plant_id = 2
        UNION ALL SELECT 'device', device_id, line_id, code, name, status FROM device
          WHERE line_id = 7 OR line_id = 4 AND (code ILIKE '%_3%' OR name ILIKE '%_3%')"""),
    "list_page": ({}, """SELECT tag_id, code, name, data_type, count(*) OVER () AS total_count FROM tag
        WHERE data_type = 'float' AND (code ILIKE '%customer#0_00%' OR name ILIKE '%customer#0_00%')
        ORDER BY code, tag_id LIMIT 25 OFFSET 10"""),
    "batch_list": ({}, """SELECT plant_id, batch_id, original_filename, status, total_rows, accepted_rows,
        rejected_rows, duplicate_rows, warning_rows, issue_count, stored_issue_count, issues_truncated,
        created_at, status = 'completed' AS counts_final, rank FROM (SELECT *, row_number() OVER (
          PARTITION BY plant_id ORDER BY created_at DESC, batch_id) AS rank FROM import_batch)
        WHERE rank <= 5"""),
    "batch_inspection": ({}, f"""SELECT plant_id, b.batch_id, original_filename, status, total_rows,
        accepted_rows, rejected_rows, duplicate_rows, warning_rows, issue_count, stored_issue_count,
        issues_truncated, created_at, status = 'completed' AS counts_final, issue_type, type_count,
        {ADVICE} AS advice FROM import_batch b LEFT JOIN (SELECT batch_id, issue_type,
          count(*) AS type_count FROM data_quality_issue GROUP BY ALL) i ON i.batch_id = b.batch_id"""),
    "batch_issue_examples": ({}, """SELECT batch_id, rank, row_number, issue_type, field_name, message
        FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY row_number, id) AS rank
          FROM data_quality_issue) WHERE rank <= 10"""),
    "stored_issue_summary": ({}, """SELECT batch_id, severity, issue_type, count(*) AS issue_count, plant_id
        FROM data_quality_issue JOIN import_batch b USING (batch_id) GROUP BY ALL"""),
    "issue_page": ({}, """SELECT id, batch_id, row_number, issue_type FROM data_quality_issue
        WHERE batch_id = 1 ORDER BY row_number, id LIMIT 20 OFFSET 2"""),
    "newest_jobs": ({}, """SELECT batch_id, job_id, status, created_at FROM (SELECT *, row_number() OVER (
        PARTITION BY batch_id ORDER BY created_at DESC, job_id DESC) AS r FROM import_job) WHERE r = 1"""),
    "batch_totals": ({}, """SELECT plant_id, count(*) AS batches, sum(accepted_rows)::BIGINT AS accepted_rows,
        sum(rejected_rows)::BIGINT AS rejected_rows FROM import_batch GROUP BY plant_id"""),
    "task_status": ({}, """SELECT plant_id, task_id, name, desired_state, connection_state,
        worker_heartbeat_at AS heartbeat_at, last_sample_at, samples_received AS received,
        samples_written AS written, dropped_count AS dropped, duplicate_count AS duplicates,
        error_count AS errors, reconnect_count AS reconnects, total > 3 AS truncated
        FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY name, task_id) AS r,
          count(*) OVER (PARTITION BY plant_id) AS total FROM acquisition_task) WHERE r <= 3"""),
    "task_facts": ({}, f"""SELECT plant_id, task_id, name || '：期望'
        || CASE desired_state WHEN 'running' THEN '运行' ELSE '停止' END || '，记录连接状态'
        || CASE connection_state WHEN 'error' THEN '异常' WHEN 'stopped' THEN '停止' ELSE '已连接' END
        || '；心跳 ' || {_local("worker_heartbeat_at")} || '，最后样本 ' || {_local("last_sample_at")}
        || '；接收' || samples_received || ' / 写入' || samples_written || ' / 丢弃' || dropped_count
        || ' / 重复' || duplicate_count || ' / 错误' || error_count || ' / 重连' || reconnect_count || '。'
        AS facts FROM acquisition_task"""),
    "fleet_totals": ({}, """SELECT plant_id, count(*) FILTER (desired_state = 'running') AS running_tasks,
        sum(samples_written)::BIGINT AS samples_written, sum(error_count)::BIGINT AS error_count,
        sum(dropped_count)::BIGINT AS dropped_count FROM acquisition_task GROUP BY plant_id"""),
    "counter_differences": ({}, """SELECT task_id, samples_written, coalesce(n, 0) AS stored_rows,
        coalesce(n, 0) - samples_written AS difference FROM acquisition_task LEFT JOIN (
          SELECT task_id, count(*) AS n FROM tag_sample WHERE source_type = 'opcua' GROUP BY task_id)
        USING (task_id)"""),
    "documents_per_plant": ({}, """SELECT plant_id, count(*) AS document_count, count(*) >= 100 AS at_limit
        FROM knowledge_document GROUP BY plant_id"""),
    "node_mapping_audit": (REQUEST, """SELECT mapping_id, p.task_id, p.tag_id, node_id,
        CASE WHEN tag_uses > 1 THEN 'tag_repeated' WHEN node_uses > 1 THEN 'node_repeated'
          WHEN node_id = '' THEN 'node_blank' WHEN a.tag_id IS NULL THEN 'tag_unknown'
          WHEN a.plant_id <> k.plant_id THEN 'other_plant' WHEN NOT a.is_enabled THEN 'tag_disabled'
          WHEN a.device_status = 'inactive' OR a.line_status = 'inactive' THEN 'asset_inactive'
          ELSE 'ok' END AS verdict
        FROM (SELECT *, count(*) OVER (PARTITION BY task_id, tag_id) AS tag_uses,
          count(*) OVER (PARTITION BY task_id, node_id) AS node_uses FROM proposal) p
        LEFT JOIN asset a ON a.tag_id = p.tag_id LEFT JOIN acquisition_task k ON k.task_id = p.task_id"""),
    "startable_tasks": ({}, """SELECT task_id, CASE WHEN p.status = 'inactive' THEN 'plant_inactive'
          WHEN coalesce(n, 0) = 0 THEN 'no_enabled_nodes' WHEN bad > 0 THEN 'asset_inactive'
          ELSE 'ok' END AS verdict
        FROM acquisition_task JOIN plant p USING (plant_id) LEFT JOIN (SELECT c.task_id, count(*) AS n,
            count(*) FILTER (NOT (a.is_enabled AND a.device_status <> 'inactive'
              AND a.line_status <> 'inactive')) AS bad
          FROM acquisition_node c JOIN asset a ON a.tag_id = c.tag_id WHERE c.is_enabled GROUP BY c.task_id)
        USING (task_id)"""),
    "integrity_audit": ({}, _integrity()),
    "integrity_audit_damaged": (_BROKEN, _integrity_of_broken()),
    "delivery_audit": (SNAPSHOT, """SELECT task_id, node_count, round(elapsed, 3) AS elapsed_seconds,
        final_state, round_even(expected, 0)::BIGINT AS expected_samples, received_delta, written_delta,
        written_delta AS row_delta,
        round(CASE WHEN elapsed > 0 THEN written_delta / elapsed END, 3) AS rows_per_second,
        round(ratio, 6) AS delivery_ratio,
        greatest(round_even(expected - written_delta, 0), 0)::BIGINT AS missing_samples, duplicate_delta,
        dropped_delta, error_delta, 0::BIGINT AS reconnect_delta, non_connected_polls,
        round(max_age, 3) AS max_heartbeat_age_seconds,
        final_state = 'connected' AND error_delta = 0 AND dropped_delta = 0 AND duplicate_delta = 0
          AND non_connected_polls = 0 AND ratio BETWEEN 0.95 AND 1.05 AND max_age <= 15 AS passed
        FROM (SELECT *, elapsed * 1000 / 360000000 * node_count AS expected,
            coalesce(written_delta / nullif(elapsed * 1000 / 360000000 * node_count, 0), 0.0) AS ratio
          FROM (SELECT task_id,
              (epoch_us(max(taken_at)) - epoch_us(min(taken_at))) / 1000000.0 AS elapsed,
              arg_max(connection_state, taken_at) AS final_state,
              (max(received) - min(received))::BIGINT AS received_delta,
              (max(written) - min(written))::BIGINT AS written_delta,
              (max(duplicates) - min(duplicates))::BIGINT AS duplicate_delta,
              arg_max(dropped, taken_at) - arg_min(dropped, taken_at) AS dropped_delta,
              arg_max(errors, taken_at) - arg_min(errors, taken_at) AS error_delta,
              count(*) FILTER (nth > 1 AND connection_state <> 'connected') AS non_connected_polls,
              coalesce(max(heartbeat_age) FILTER (nth > 1), 0.0) AS max_age
            FROM snapshot GROUP BY task_id)
          JOIN (SELECT task_id, count(*) AS node_count FROM acquisition_node WHERE is_enabled
            GROUP BY task_id) USING (task_id))"""),
    "state_histogram": (SNAPSHOT, """SELECT task_id, connection_state, count(*) AS polls FROM snapshot
        WHERE nth > 1 GROUP BY ALL"""),
    "state_reconcile": ({"owned": """SELECT task_id FROM (SELECT user_id % 125 // 5 AS task_id,
        arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY ALL)
        WHERE e IN ('view', 'purchase', 'click')"""},
        """SELECT coalesce(t.task_id, o.task_id) AS task_id, desired_state, connection_state,
        o.task_id IS NOT NULL AS owned,
        CASE WHEN o.task_id IS NOT NULL AND coalesce(desired_state, '') <> 'running' THEN 'stop'
          WHEN desired_state = 'running' AND o.task_id IS NULL THEN 'start'
          WHEN desired_state = 'stopped' AND connection_state <> 'stopped' AND o.task_id IS NULL
          THEN 'repair' ELSE 'keep' END AS action
        FROM acquisition_task t FULL JOIN owned o ON o.task_id = t.task_id"""),
    "state_guard": ({"reported": """SELECT user_id % 125 // 5 AS task_id, event_id, ts, CASE event_type
        WHEN 'signup' THEN 'stopped' WHEN 'error' THEN 'error' WHEN 'view' THEN 'connected'
        WHEN 'click' THEN 'reconnecting' ELSE 'connecting' END AS state FROM events"""},
        """SELECT task_id, desired_state, arg_max(state, (ts, event_id)) FILTER (ok) AS connection_state,
        count(*) FILTER (ok) AS admitted_events, count(*) FILTER (NOT ok) AS rejected_events
        FROM (SELECT r.*, desired_state, (desired_state = 'stopped') = (state = 'stopped') AS ok
          FROM reported r JOIN acquisition_task USING (task_id)) GROUP BY task_id, desired_state"""),
    "import_classified": (_VERDICT, """SELECT batch_id, source_row, position::BIGINT AS position, tag_id,
        stamp AS source_timestamp,
        CASE WHEN data_type = 'string' THEN to_json(v)::VARCHAR
          WHEN data_type = 'boolean' THEN CASE numeric_value WHEN 1 THEN 'true' WHEN 0 THEN 'false' END
          WHEN data_type = 'integer' THEN numeric_value::BIGINT::VARCHAR
          ELSE numeric_value::VARCHAR END AS value,
        numeric_value, status_code, is_good, rule, issue_type FROM verdict_typed"""),
    "import_accepted": (_VERDICT, """SELECT batch_id AS import_batch_id, tag_id,
        CASE WHEN data_type = 'string' THEN to_json(v)::VARCHAR
          WHEN data_type = 'boolean' THEN CASE numeric_value WHEN 1 THEN 'true' ELSE 'false' END
          WHEN data_type = 'integer' THEN numeric_value::BIGINT::VARCHAR
          ELSE numeric_value::VARCHAR END AS value,
        numeric_value, stamp AS source_timestamp, status_code, is_good
        FROM verdict_typed WHERE rule IS NULL"""),
    "import_counters": ({**_VERDICT, **COUNTERS}, """SELECT *, least(issue_count, 50) AS stored_issue_count,
        issue_count > 50 AS issues_truncated FROM counters"""),
    "import_issues": (_VERDICT, """SELECT batch_id, row_number, issue_type, severity, field_name, raw_value,
        message, emit_order::BIGINT AS emit_order, issue_number FROM (SELECT *, row_number() OVER (
          PARTITION BY batch_id ORDER BY row_number, emit_order, issue_type) AS issue_number
          FROM found_issue) WHERE issue_number <= 50"""),
    "all_import_counters": ({**_VERDICT, **COUNTERS}, """SELECT *, issue_count AS stored_issue_count,
        false AS issues_truncated FROM counters"""),
    "all_import_issues": (_VERDICT, """SELECT batch_id, row_number, issue_type, severity, field_name, raw_value,
        message, emit_order::BIGINT AS emit_order, row_number() OVER (
          PARTITION BY batch_id ORDER BY row_number, emit_order, issue_type) AS issue_number FROM found_issue"""),
    "import_issue_summary": (_VERDICT, f"""SELECT batch_id, severity, issue_type, count(*) AS issue_count,
        {ADVICE} AS advice FROM found_issue GROUP BY ALL"""),
    "import_wide": ({**RAW_WIDE, **CLASSIFY}, """SELECT batch_id, value_field, rule,
        count(*) AS measurements, round(sum(numeric_value), 2) AS total FROM verdict GROUP BY ALL"""),
    "field_mapping_rows": ({}, """SELECT batch_id, f AS target_field, c AS source_column FROM import_batch,
        (VALUES ('timestamp_column', 'time'), ('quality_column', 'quality'), ('tag_code_column', 'tag'),
          ('value_column', 'value'), ('device_code_column', 'device'), ('timestamp_column', 'time'),
          ('quality_column', 'quality'), ('wide_value_001', 'm1'), ('wide_value_002', 'm2'),
          ('wide_value_003', 'm3'), ('wide_value_004', 'm4')) v(f, c)"""),
    "import_from_files": ({**_VERDICT, **COUNTERS}, """SELECT batch_id AS plant_id, total_rows, accepted_rows,
        rejected_rows, duplicate_rows, warning_rows, issue_count, accepted_rows AS published_rows
        FROM counters"""),
    "import_file_batches": ({**_VERDICT, **COUNTERS}, """SELECT c.batch_id AS plant_id, 'completed' AS status,
          NULL::VARCHAR AS error_message, f.files, total_rows + blanks AS total_rows, accepted_rows,
          rejected_rows + blanks AS rejected_rows, duplicate_rows, warning_rows, issue_count + blanks AS issue_count,
          accepted_rows AS published_rows, accepted_rows AS visible_rows
        FROM counters c JOIN (SELECT batch_id, count(DISTINCT source_row % 2) AS files,
            count(*) FILTER (source_row % 38 = 4) AS blanks FROM cell GROUP BY batch_id) f USING (batch_id)
        WHERE c.batch_id < 4
        UNION ALL SELECT 4, 'failed', '映射列不存在：value', (SELECT count(DISTINCT source_row % 2) FROM cell WHERE plant_id = 4),
          0, 0, 0, 0, 0, 0, 0, 0 WHERE EXISTS (FROM cell WHERE plant_id = 4)
        UNION ALL SELECT NULL, 'failed', 'CSV files must be UTF-8 or GB18030', (SELECT count(*) FROM nation), 0, 0, 0, 0, 0, 0, 0, 0
        UNION ALL SELECT NULL, 'failed', 'source column headers must be unique', (SELECT count(*) FROM region), 0, 0, 0, 0, 0, 0, 0, 0"""),
    "duplicate_files": ({}, """SELECT o_orderkey AS batch_id, o_custkey % 5 AS plant_id,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status,
        last_value(CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderkey END IGNORE NULLS) OVER (
          PARTITION BY o_custkey % 5, o_custkey % 200 ORDER BY o_orderdate, o_orderkey
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS duplicate_of_id FROM orders"""),
    "source_files_available": ({}, """SELECT o_orderkey AS batch_id, 'page-' || (o_orderkey % 3000) AS storage_key,
        o_orderkey % 3000 IN (SELECT page_id FROM pages) AS source_file_available FROM orders"""),
    "header_suggestions": ({}, """SELECT event_id AS file_id, t AS timestamp_column, g AS tag_code_column,
        v AS value_column, d AS device_code_column, q AS quality_column, layout, layout = 'long' AS suggested
        FROM events JOIN (VALUES
          (0, 'timestamp', 'tag_code', 'value', NULL, NULL, 'long'),
          (1, '采集时间', '变量编码', '测量值', '设备', '质量', 'long'),
          (2, '时间', NULL, NULL, NULL, NULL, 'wide'),
          (3, 'TIME', 'Tag', 'READING', NULL, 'quality_code', 'long'),
          (4, NULL, NULL, NULL, NULL, NULL, 'wide'),
          (5, 'source_timestamp', 'point', 'value', NULL, 'status_code', 'long')
        ) x(k, t, g, v, d, q, layout) ON k = event_id % 6"""),
    "changed_files": ({}, "SELECT 'page-' || page_id AS path FROM pages WHERE length(html) % 4 = 0"),
    "retention_preview": ({
        "held": "SELECT s.*, a.plant_id FROM tag_sample s JOIN asset a USING (tag_id)",
        "old": """SELECT * FROM held WHERE source_timestamp < TIMESTAMP '2024-01-24'""",
        }, """SELECT plant_id, source_type, 7::BIGINT AS keep_days, TIMESTAMP '2024-01-24' AS cutoff,
        coalesce((SELECT max(id) FROM held h WHERE h.plant_id = p.plant_id
          AND h.source_type = v.source_type), 0) AS high_water_id,
        coalesce(n, 0) AS matched_rows, true AS count_is_exact,
        coalesce(tags, 0) AS affected_tags_in_scan, oldest AS oldest_in_scan, newest AS newest_in_scan
        FROM plant p CROSS JOIN (VALUES ('opcua'), ('file')) v(source_type)
        LEFT JOIN (SELECT plant_id, source_type, count(*) AS n, count(DISTINCT tag_id) AS tags,
            min(source_timestamp) AS oldest, max(source_timestamp) AS newest FROM old
            GROUP BY ALL) USING (plant_id, source_type)"""),
    "scoped_subset_counts": (SCOPE, _subset_counts()),
    "cross_scope_refs": (SCOPE, """
        SELECT 'acquisition_node' AS table_name, 'tag_id' AS reference, count(*) AS row_count
          FROM scoped_node WHERE (tag_in OR task_in) AND NOT tag_in
        UNION ALL SELECT 'acquisition_node', 'task_id', count(*) FROM scoped_node
          WHERE (tag_in OR task_in) AND NOT task_in
        UNION ALL SELECT 'tag_sample', 'tag_id', count(*) FROM scoped_sample
          WHERE (tag_in OR task_in OR batch_in) AND NOT tag_in
        UNION ALL SELECT 'tag_sample', 'task_id', count(*) FROM scoped_sample
          WHERE (tag_in OR task_in OR batch_in) AND task_id IS NOT NULL AND NOT task_in
        UNION ALL SELECT 'tag_sample', 'import_batch_id', count(*) FROM scoped_sample
          WHERE (tag_in OR task_in OR batch_in) AND import_batch_id IS NOT NULL AND NOT batch_in
        UNION ALL SELECT 'import_batch', 'duplicate_of_id', count(*) FROM import_batch b
          JOIN import_batch o ON o.batch_id = b.duplicate_of_id
          WHERE (b.batch_id IN (FROM in_batch)) <> (o.batch_id IN (FROM in_batch))"""),
    "archive_restore_check": ({}, "SELECT code AS table_name FROM plant WHERE false"),
    "restored_digests": (_BROKEN, _digests()),
    "changed_table_check": (_BROKEN, " UNION ALL ".join(
        f"SELECT '{n}' AS table_name WHERE EXISTS (SELECT * FROM {n} EXCEPT ALL SELECT * FROM broken_{n})" for n in DAMAGE)),
    "canonical_rows": ({}, """SELECT tag_id, '{"code":"' || code || '","is_enabled":' || is_enabled
        || ',"max_value":' || coalesce(max_value::VARCHAR, 'null') || ',"tag_id":' || tag_id || '}'
        AS row_text FROM tag"""),
    "chunk_documents": (CHUNKS, """SELECT document_id, plant_id, chunk_index, "start", "end", text,
        evidence_id FROM chunk"""),
    "document_frequencies": (CHUNKS, """SELECT plant_id, term, count(*) AS frequency FROM posting
        GROUP BY plant_id, term"""),
    "bm25_top5": (_evidence("lexical"), "SELECT * FROM evidence"),
    "vector_top5": (_evidence("vector"), "SELECT * FROM evidence"),
    "hybrid_top5": (_evidence("auto"), "SELECT * FROM evidence"),
    "evidence_payload": (PAYLOAD, """SELECT e.*, c.version, c.text, d.content_sha256,
        round_even(e.lexical_score + e.semantic_score, 4) AS lexical_plus_semantic,
        CASE WHEN q.vector IS NOT NULL AND p.plant_id IS NOT NULL THEN 'hybrid' ELSE 'lexical' END AS mode
        FROM evidence e JOIN chunk c USING (evidence_id) JOIN knowledge_document d ON d.document_id = e.document_id
        JOIN question q ON q.query_id = e.query_id LEFT JOIN compared p ON p.plant_id = q.plant_id"""),
    "embedding_similarity": ({}, """SELECT d.document_id, round(list_cosine_similarity(d.vector, b.v), 6)
        AS similarity FROM knowledge_document d JOIN (SELECT plant_id, arg_min(vector, document_id) AS v
          FROM knowledge_document WHERE vector IS NOT NULL GROUP BY plant_id) b USING (plant_id)
        WHERE d.vector IS NOT NULL"""),
    "document_versions": (INCOMING, """SELECT document_id,
        CASE WHEN takes THEN n.plant_id ELSE o.plant_id END AS plant_id,
        CASE WHEN takes THEN n.title ELSE o.title END AS title,
        sha256(CASE WHEN takes THEN n.content ELSE o.content END) AS content_sha256,
        (coalesce(o.version, 0) + takes::INT)::BIGINT AS version,
        CASE WHEN n.content IS NULL THEN 'kept' WHEN o.version IS NULL THEN 'created'
          WHEN takes THEN 'updated' ELSE 'conflict' END AS result
        FROM knowledge_document o FULL JOIN incoming n USING (document_id),
        LATERAL (SELECT n.content IS NOT NULL AND (o.version IS NULL
          OR coalesce(n.expected_version = o.version, false)) AS takes)"""),
    "document_store": (INCOMING, """SELECT document_id, plant_id, title, version, sha256(content) AS content_sha256,
        length(content) AS characters, has_vector, CASE WHEN length(content) > 0 THEN (length(content) - 1) // 600 + 1
          ELSE 0 END AS chunk_count, CASE WHEN conflict THEN expected END AS expected_version,
        CASE WHEN conflict THEN version END AS current_version FROM (
          SELECT document_id, CASE WHEN takes THEN n.plant_id ELSE o.plant_id END AS plant_id,
            CASE WHEN takes THEN n.title ELSE o.title END AS title,
            CASE WHEN takes THEN n.content ELSE o.content END AS content,
            (coalesce(o.version, 0) + takes::INT)::BIGINT AS version, n.expected_version::BIGINT AS expected,
            o.vector IS NOT NULL AND NOT (takes AND n.content IS DISTINCT FROM o.content) AS has_vector,
            n.content IS NOT NULL AND o.version IS NOT NULL AND NOT takes AS conflict
          FROM knowledge_document o FULL JOIN incoming n USING (document_id),
          LATERAL (SELECT n.content IS NOT NULL AND (o.version IS NULL
            OR coalesce(n.expected_version = o.version, false)) AS takes))"""),
    "seed_documents": (INCOMING, """SELECT document_id, title FROM incoming n WHERE NOT EXISTS (
        SELECT 1 FROM knowledge_document o WHERE o.plant_id = n.plant_id AND o.title = n.title)"""),
    "retrieval_metrics": (METRICS, """SELECT query_id, returned_titles, round(recall, 6) AS recall,
        all_sources, round(reciprocal_rank, 6) AS reciprocal_rank, returned_on_unanswerable FROM metrics"""),
    "retrieval_metrics_summary": (METRICS, """SELECT count(*) AS questions, round(avg(recall), 6)
        AS mean_recall, round(avg(all_sources::INT), 6) AS all_sources_rate,
        round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank, round(avg((recall > 0)::INT), 6) AS hit_rate
        FROM metrics"""),
    "latency_percentiles": ({}, """SELECT event_type AS mode, count(*) AS runs,
        round(median(value), 6) AS median,
        list_sort(list(value))[((count(*) * 19 + 19) // 20)::BIGINT] AS p95
        FROM events GROUP BY event_type"""),
    "run_quota": ({}, """SELECT user_id, count(*) AS recent_runs, count(*) >= 3 AS over_quota
        FROM assistant_run WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 60 SECOND GROUP BY user_id"""),
    "question_windows": ({"asked": """SELECT conv_id * 100 + turn AS question_id, conv_id % 6 AS k,
        1 + conv_id % 30 AS h, 1 + turn % 24 AS wanted FROM conversations"""},
        """SELECT question_id, k < 4 AS recognised,
        CASE WHEN k = 0 AND h <= 24 THEN h::VARCHAR WHEN k = 2 THEN '23' WHEN k < 4 THEN '' END AS hours,
        CASE WHEN k < 4 THEN k = 1 OR k = 3 OR (k = 0 AND h > 24) END AS blocked,
        CASE WHEN k = 4 THEN 'acquisition_status' END AS operation,
        CASE k WHEN 0 THEN h <= 24 AND wanted = h WHEN 2 THEN wanted = 23 ELSE k > 3 END AS permitted
        FROM asked"""),
    "answer_audit": ({"answered": """SELECT conv_id * 100 + turn AS answer_id, conv_id + turn AS k
        FROM conversations WHERE role = 'assistant'"""},
        """SELECT answer_id, k % 3 <> 0 AND k % 7 = 0 AS ambiguous,
        CASE WHEN k % 5 = 0 AND k % 2 = 1 THEN 'unsupported_versioned_identifier'
          WHEN k % 5 = 1 THEN 'unsupported_database_provenance_claim' END AS problem,
        CASE WHEN k % 3 = 0 OR k % 7 = 1 THEN 'no_answer' ELSE 'answered' END AS final_status
        FROM answered"""),
    "citation_audit": ({"cited": """SELECT conv_id * 100 + turn AS answer_id, (conv_id + turn) % 3 = 0 AS silent,
        (conv_id + turn) % 4 = 0 AS cites, (conv_id + turn) % 3 = 2 AND (conv_id + turn) % 4 = 0 AS unknown
        FROM conversations WHERE role = 'assistant'"""},
        """SELECT answer_id, unknown::BIGINT AS unknown_count, NOT unknown AND (silent OR cites)
        AS citations_valid FROM cited"""),
    "stale_evidence": ({}, """SELECT conv_id AS answer_id, turn AS position,
        ['acquisition_status', 'asset_overview', 'tag_trend'][length(text) % 3 + 1] AS title,
        conv_id * 3 + turn AS document_id, 1 + turn % 3 AS version, d.version AS current_version
        FROM conversations LEFT JOIN knowledge_document d ON d.document_id = conv_id * 3 + turn
        WHERE d.version IS NULL OR d.version <> 1 + turn % 3"""),
    "stale_evidence_found": ({}, """SELECT * FROM (SELECT conv_id AS answer_id, turn AS position,
          ['acquisition_status', 'asset_overview', 'tag_trend'][length(text) % 3 + 1] AS title,
          conv_id * 3 + turn AS document_id, greatest(1, 1 + turn % 3 - conv_id % 2) AS version,
          d.version AS current_version
          FROM conversations LEFT JOIN knowledge_document d ON d.document_id = conv_id * 3 + turn)
        WHERE current_version IS NULL OR current_version <> version"""),
    "last_snapshots": ({}, """SELECT answer_id, position, title, document_id, version FROM (
          SELECT *, max(position) OVER (PARTITION BY answer_id, title) AS last FROM (
            SELECT conv_id AS answer_id, turn AS position,
            ['acquisition_status', 'asset_overview', 'tag_trend'][length(text) % 3 + 1] AS title,
            conv_id * 3 + turn AS document_id, 1 + turn % 3 AS version FROM conversations))
        WHERE title = 'tag_trend' OR position = last"""),
    "structure_scores": ({"scored": """SELECT conv_id * 100 + turn AS case_id, conv_id + turn AS k, text
        FROM conversations WHERE role = 'assistant'"""},
        """SELECT *, status_allowed AND required_calls_in_order AND forbidden_calls_absent AND no_call_errors
          AND citations_valid AND required_documents_cited AND reference_terms_present AND canaries_absent
          AS structural_pass
        FROM (SELECT case_id, k % 3 <> 0 AS status_allowed,
          k % 5 <> 0 AND k % 2 = 0 AND k % 6 <> 0 AS required_calls_in_order,
          k % 7 <> 0 AS forbidden_calls_absent, k % 6 <> 0 AS no_call_errors, k % 8 <> 0 AS citations_valid,
          true AS required_documents_cited, contains(text, 'the') OR contains(text, 'le')
          AS reference_terms_present,
          NOT contains(text, 'CANARY_73921') AND NOT contains(text, 'PRIVATE_482') AS canaries_absent
          FROM scored)"""),
    "stream_dedup_counters": (NOTIFIED, """SELECT task_id,
        count(*) FILTER (tag_id IS NOT NULL) AS samples_received,
        count(*) FILTER (tag_id IS NOT NULL AND nth = 1) AS samples_written,
        count(*) FILTER (tag_id IS NOT NULL AND nth > 1) AS duplicate_count,
        count(*) FILTER (tag_id IS NULL) AS dropped_count,
        max(stamp) FILTER (tag_id IS NOT NULL) AS last_sample_at FROM mapped GROUP BY task_id"""),
    "stream_over_batches": (NOTIFIED, """SELECT task_id,
        count(*) FILTER (tag_id IS NOT NULL) AS samples_received,
        count(*) FILTER (tag_id IS NOT NULL AND first) AS samples_written,
        count(*) FILTER (tag_id IS NOT NULL AND NOT first) AS duplicate_count,
        count(*) FILTER (tag_id IS NULL) AS dropped_count,
        max(stamp) FILTER (tag_id IS NOT NULL) AS last_sample_at, max(received_at) AS heartbeat_at,
        nullif(count(*) FILTER (tag_id IS NOT NULL AND first), 0) AS stored_samples,
        CAST(sum(seq) FILTER (tag_id IS NOT NULL AND first) AS BIGINT) AS seq_total,
        nullif(count(DISTINCT tag_id) FILTER (tag_id IS NOT NULL), 0) AS tags
        FROM (SELECT *, row_number() OVER (PARTITION BY task_id, tag_id, stamp
            ORDER BY (seq // 2 + seq % 2) % 4, received_at, seq) = 1 AS first FROM mapped)
        GROUP BY task_id"""),
    "stream_stored_samples": (NOTIFIED, """SELECT task_id, tag_id, count(*) AS samples, max(stamp) AS newest,
        round(sum(numeric_value), 2) AS total FROM mapped WHERE tag_id IS NOT NULL AND nth = 1 GROUP BY ALL"""),
}


def statement(name: str) -> str:
    """The whole SQL statement of a registered query."""
    extra, body = QUERIES[name]
    parts = {**BINDING, **extra}
    tables = ",\n".join(f"{table} AS ({sql})" for table, sql in parts.items())
    return f"WITH {tables}\n{body}"


def statements() -> dict[str, str]:
    return {name: statement(name) for name in QUERIES}
