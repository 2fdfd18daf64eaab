"""Scalar expressions against fixed expectations."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from millrace.functions import freshness, parsing, terms, text, wording
from millrace.operators.integrity import endpoint_problem

TIMES = [
    "2026-08-22T08:00:00Z", "2026-08-22 16:00:00", "not-a-time", "2026", "2026-08", "T10:00",
    "2026-8-2 1:2:3", "20260822", "20260822T100000", "2026-08-22T10:00:00,5", "2026-08-22T10Z",
    "2026-08-22T10:00+08", "2026-08-22T10:00:00.1234567+08:00", "2026-0822", "2026-08-22T1000:00",
    "20260822T10:00", "2026-08-22T1000", "2026-08-22T10:00+24:00", "2026-02-30", "0000-01-01",
    "2026-08-22T10:60", "  2026-08-22 ", "2026-08-22T10:00:00-0330", "2026-08-22x10", "",
    "　2026-08-22T10:00 ",
]


def iso_seconds(value):
    value = value.strip()
    if value.endswith("Z"):
        value = value[:-1] + "+00:00"
    try:
        parsed = dt.datetime.fromisoformat(value)
    except ValueError:
        return None
    if parsed.tzinfo is None:
        parsed = parsed.replace(tzinfo=ZoneInfo("Asia/Shanghai"))
    return parsed.timestamp()


def one(spark, value, build, kind="STRING"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v"))).first()[0]


def many(spark, values, build, kind="STRING"):
    rows = [(n, v) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"n INT, v {kind}").select("n", build(F.col("v")).alias("r"))
    return [r.r for r in sorted(df.collect(), key=lambda r: r.n)]


def test_timestamps_agree_with_iso_parsing(spark):
    found = many(spark, TIMES, lambda c: F.unix_micros(parsing.parse_timestamp(c)))
    assert [None if x is None else x / 1e6 for x in found] == [iso_seconds(t) for t in TIMES]


@pytest.mark.parametrize(
    ("kind", "cell", "expected"),
    [
        ("string", " text ", (True, '"text"', None)),
        ("boolean", "True", (True, "true", 1.0)), ("boolean", "是", (True, "true", 1.0)),
        ("boolean", "关", (True, "false", 0.0)), ("boolean", "maybe", (False, None, None)),
        ("float", "2.5", (True, "2.5", 2.5)), ("float", "1_000.5", (True, "1000.5", 1000.5)),
        ("float", "1__0", (False, None, None)), ("float", "nan", (False, None, None)),
        ("float", "1.5d", (False, None, None)), ("float", "1e400", (False, None, None)),
        ("float", "not-a-number", (False, None, None)),
        ("integer", "2", (True, "2", 2.0)), ("integer", "1e3", (True, "1000", 1000.0)),
        ("integer", "1.5", (False, None, None)),
    ],
)
def test_values_by_type(spark, kind, cell, expected):
    assert tuple(one(spark, cell, lambda c: parsing.parse_value(c, F.lit(kind)))) == expected


def test_quality(spark):
    cells = [None, "  ", "OK", "BadSensorFailure", "0xC0", "x" * 100]
    status = many(spark, cells, parsing.quality_status)
    assert status == ["Good", "Good", "OK", "BadSensorFailure", "0xC0", "x" * 64]
    good = many(spark, cells, lambda c: parsing.is_good_status(parsing.quality_status(c)))
    assert good == [True, True, True, False, True, False]


def test_missing_and_raw_text(spark):
    assert many(spark, [None, "  ", "　", "0"], text.is_missing) == [True, True, True, False]
    assert one(spark, "x" * 600, text.raw_text) == "x" * 500


def test_live_values(spark):
    cells = ["true", '[1,"x"]', "null", "2", "2.5", '"text"', '{"a":1}', None]
    found = [tuple(r) for r in many(spark, cells, parsing.live_value)]
    assert found == [
        ("true", 1.0), ('[1,"x"]', None), (None, None), ("2", 2.0), ("2.5", 2.5), ('"text"', None),
        ('"{\\"a\\":1}"', None), (None, None),
    ]


def test_search_expressions(spark):
    df = spark.createDataFrame([("A_1", "50%"), ("AB1", "Straße")], "code STRING, name STRING")
    assert df.where(text.contains_either("a_1", F.col("code"), F.col("name"))).count() == 2
    assert df.where(text.contains_literal("A_1", F.col("code"), F.col("name"))).count() == 1
    assert df.where(text.contains_literal("", F.col("code"))).count() == 2
    assert df.where(text.contains_folded(" STRASSE ", F.col("code"), F.col("name"))).count() == 1


def test_folding_of_every_letter(spark):
    """What is left of a folded letter for tokens and codes is the same as in Python."""
    letters = [chr(p) for p in range(0x20, 0x10000) if chr(p).isalpha()]

    def kept(value):
        return re.findall("[a-z0-9_]+|[一-鿿]+", value)

    folded = many(spark, letters, text.fold)
    assert [c for c, f in zip(letters, folded, strict=True) if kept(f) != kept(c.casefold())] == []


def test_age_text(spark):
    ages = [float("nan"), -6.0, -3.0, 12.34, 61.0, 3600.0, 90000.0]
    assert many(spark, ages, freshness.age_text, "DOUBLE") == [
        "时间无效", "时间超前，请检查时钟", "0.0 秒", "12.3 秒", "1 分钟", "1 小时", "1 天 1 小时",
    ]


def test_time_texts(spark):
    shown = one(spark, dt.datetime(2026, 8, 22, 8, tzinfo=dt.UTC), freshness.local_time_text, "TIMESTAMP")
    assert shown == "2026-08-22T16:00:00+08:00"
    stored = ["2026-08-22T08:00:00+00:00", "2026-08-22T08:00:00", None]
    assert many(spark, stored, freshness.stored_time_text) == [
        "2026-08-22T16:00:00+08:00", "2026-08-22T08:00:00（时区未知）", "暂无",
    ]
    assert many(spark, [59.0, 60.0, 120.0], freshness.phase_label, "DOUBLE") == [
        "正常基线", "注入扰动", "恢复观察",
    ]


def test_tokens_and_counts(spark):
    value = "The STRASSE Straße 什么是离心泵的密封 a_1 泵 the"
    assert one(spark, value, terms.token_array) == [
        "the", "strasse", "strasse", "么是", "是离", "离心", "心泵", "泵的", "的密", "密封", "a_1", "the",
    ]
    counted = one(spark, value, lambda c: terms.token_counts(terms.token_array(c)))
    assert {r.term: r.tf for r in counted if r.tf > 1} == {"the": 2, "strasse": 2}
    assert one(spark, "", lambda c: terms.token_counts(terms.token_array(c))) == []


def test_chunks_keep_their_tails(spark):
    spans = [(c["start"], c["end"], len(c["text"])) for c in one(spark, "x" * 1301, terms.chunk_array)]
    assert spans == [(0, 700, 700), (600, 1300, 700), (1200, 1301, 101)]
    assert [(c["start"], c["end"]) for c in one(spark, "a" * 650, terms.chunk_array)] == [(0, 650), (600, 650)]
    assert one(spark, "", terms.chunk_array) == []


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [0.6, 0.8]), ([1.0], [1.0, 0.0]), ([0.0], [1.0]), ([], [])],
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
    )
    found = [r[0] for r in df.select(terms.cosine(F.col("a"), F.col("b"))).collect()]
    assert found[0] == pytest.approx(0.6)
    assert found[1:] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("question", "hours", "blocked"),
    [
        ("过去6小时的趋势", [6], False), ("最近一小时的变化", [1], False),
        ("近二十四小时平均值", [24], False), ("前60分钟的统计", [1], False),
        ("最近1天和过去2小时的均值", [2, 24], False), ("最近十二小时最大值", [12], False),
        ("最近半小时趋势", [], True), ("过去一周的趋势", [], True), ("最近三个月统计", [], True),
        ("过去6小时每小时的均值", [6], True), ("最近25小时趋势", [], True),
        ("最近1.5小时的变化", [], True), ("最近十十小时趋势", [], True),
    ],
)
def test_trend_windows(spark, question, hours, blocked):
    window = one(spark, question, wording.trend_window)
    assert (window.recognised, window.hours, window.blocked) == (True, hours, blocked)


def test_unrecognised_windows_and_operations(spark):
    asked = ["泵的趋势怎么看", "过去6小时发生了什么", "当前有几个采集任务在运行", "如何查询采集任务状态", None]
    windows = many(spark, asked[:2], wording.trend_window)
    assert [w.recognised for w in windows] == [False, False]
    assert many(spark, asked, wording.requested_operation) == [None, None, "acquisition_status", None, None]


def test_answer_wording(spark):
    ambiguous = ["可以，但需要先确认", "可以。详见手册", "**能，不过必须停机"]
    found = many(spark, ambiguous, lambda c: wording.conditional_conclusion(F.lit("answered"), c))
    assert found == [True, False, True]
    refused = many(
        spark, ["抱歉，我无法绕过权限。", "无法确认该数值。"],
        lambda c: wording.settled_status(F.lit("answered"), c),
    )
    assert refused == ["no_answer", "answered"]


@pytest.mark.parametrize(
    ("answer", "sources", "expected"),
    [
        ("请用 demo_v1.2 配方", "demo_v1.2", None),
        ("请用 demo_v1.2 配方", "demo", "unsupported_versioned_identifier"),
        ("quality_code 可选；共3条警告", "quality_code", "quality_mapping_required_for_warning_count"),
        ("平台不存储指标", "", "unsupported_database_provenance_claim"),
        ("不能断言所有数据都是模拟数据", "", None),
    ],
)
def test_grounding(spark, answer, sources, expected):
    found = one(spark, answer, lambda c: wording.grounding_problem(c, F.lit(sources), F.lit(sources)))
    assert found == expected


def test_endpoints(spark):
    urls = ["opc.tcp://sim:4840", "opc.tcp://SIM:4840/path", "opc.tcp://sim", "http://sim:1",
            "opc.tcp://u:p@sim:1", "opc.tcp://else:1"]
    assert many(spark, urls, lambda c: endpoint_problem(c, ["sim"])) == [
        None, None, "bad_shape", "bad_shape", "credentials", "host_not_allowed",
    ]
