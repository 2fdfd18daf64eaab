"""Reports, listings and unions that no registered query covers."""

from types import SimpleNamespace

from helpers import utc
from pyspark.sql import functions as F

from millrace.operators import importing, retrieval
from millrace.plans.queries import REGISTRY
from millrace.sources import star_binding as star
from millrace.sources import tabular
from millrace.sources.tables import SCHEMAS, all_samples, normalise_roles


def test_issue_report_is_written_per_batch(spark, tmp_path):
    rows = [(1, 2, "bad_quality", "warning", "quality", None, "m", -1, 1), (2, 3, "invalid_value", "error", "value", "x", "m", 0, 1)]
    ddl = ("batch_id LONG, row_number LONG, issue_type STRING, severity STRING, field_name STRING, raw_value STRING, "
           "message STRING, emit_order INT, issue_number INT")
    importing.write_issue_report(spark.createDataFrame(rows, ddl), str(tmp_path / "report"))
    found = spark.read.option("header", True).csv(str(tmp_path / "report")).orderBy("batch_id").collect()
    assert [(r["行号"], r["问题类型"], r["原始值"]) for r in found] == [("2", "bad_quality", None), ("3", "invalid_value", "x")]


def test_source_file_flags(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\n1\n")
    listing = tabular.binary_files(spark, [str(tmp_path / "a.csv")])
    there = listing.first().path
    batches = spark.createDataFrame([(1, there), (2, "gone"), (3, None)], "batch_id LONG, storage_key STRING")
    found = {r.batch_id: r.source_file_available for r in tabular.with_source_file(batches, listing).collect()}
    assert found == {1: True, 2: False, 3: False}


def test_documents_by_update(spark):
    docs = spark.createDataFrame([(1, utc(2026, 1, 1)), (2, utc(2026, 1, 3)), (3, utc(2026, 1, 3))], "document_id LONG, updated_at TIMESTAMP")
    assert [r.document_id for r in retrieval.newest_documents(docs, "updated_at").collect()] == [2, 3, 1]


def test_equal_instants_of_both_sources_stay(spark):
    at = utc(2026, 1, 1)
    live = spark.createDataFrame([(1, 1, None, "opcua", 5, "1", 1.0, at, None, at, "Good", True)], SCHEMAS["tag_sample"])
    filed = live.withColumn("source_type", F.lit("file"))
    assert all_samples(live, filed).count() == 2


def test_roles_are_normalised(spark):
    users = spark.createDataFrame([(1, "observer", True, True), (2, "admin", False, True), (3, "engineer", None, True)], SCHEMAS["user"])
    found = {r.user_id: (r.role, r.is_superuser) for r in normalise_roles(users).collect()}
    assert found == {1: ("admin", True), 2: ("admin", True), 3: ("engineer", False)}


def test_every_device_and_task_has_a_fact(spark, sf_dir, monkeypatch):
    tables = star.bind(spark, sf_dir)
    tasks = tables.acquisition_task.limit(1)
    more = tasks.crossJoin(spark.range(15)).withColumn("task_id", F.col("id")).drop("id")
    line = tables.production_line.first().line_id
    first = tables.device.limit(1).crossJoin(spark.range(35).withColumnRenamed("id", "_n"))
    many = first.withColumn("device_id", F.col("_n") + 100_000).withColumn("line_id", F.lit(line)).drop("_n")
    monkeypatch.setattr(star, "bind", lambda *_: SimpleNamespace(production_line=tables.production_line, tag=tables.tag, device=many, acquisition_task=more))
    assert REGISTRY["all_device_facts"](spark, sf_dir).count() == 35
    assert REGISTRY["task_facts"](spark, sf_dir).count() == 15
