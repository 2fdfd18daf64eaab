"""Sample queries, running results under skew, scope, batches and lifecycle."""

import datetime as dt
import random

import pytest
from helpers import naive, plant_with_tags, stored, utc
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import assets, batches, evaluation, integrity, lifecycle, running
from millrace.operators import samples as queries
from millrace.sources.tables import load_tables, write_samples

NOW = utc(2026, 8, 22, 12)


def sample(ident, tag, at, value=None, good=True, source="opcua", task=1):
    task_id, batch = (task, None) if source == "opcua" else (None, 1)
    return (ident, task_id, batch, source, tag, str(value), value, at, None, at, "Good" if good else "Bad", good)


def tables_with(spark, samples, tags=((1, "A", "float", None, None),), **more):
    return plant_with_tags(spark, list(tags), tag_sample=samples, **more)


def test_bounded_trend(spark):
    start = NOW - dt.timedelta(seconds=1001)
    rows = [sample(n, 1, start + dt.timedelta(seconds=n), float(n), n != 1000) for n in range(1001)]
    t = tables_with(spark, rows)
    found = queries.trend(t, F.lit(NOW), 1, limit=1000).first()
    whole = queries.trend(t, F.lit(NOW), 1).first()
    assert (whole.sample_count, whole.truncated, whole.minimum, whole.first_to_last_change) == (1001, False, 0.0, 999.0)
    assert (found.sample_count, found.truncated, found.bad_quality_count, found.good_numeric_count) == (1000, True, 1, 999)
    assert (found.minimum, found.maximum, found.mean, found.first_to_last_change) == (1.0, 999.0, 500.0, 998.0)
    empty = queries.trend(t, F.lit(NOW), 1, "file").first()
    assert (empty.sample_count, empty.mean, empty.truncated) == (0, None, False)


def test_history_page(spark):
    rows = [sample(n, 1, NOW + dt.timedelta(seconds=n), v) for n, v in enumerate((10.0, 20.0, 30.0))]
    t = tables_with(spark, [*rows, sample(9, 1, NOW, 99.0, task=2)])
    page = queries.history(t, 1, task_id=1, limit=2).collect()
    assert [(r.numeric_value, r.total_count) for r in page] == [(20.0, 3), (30.0, 3)]
    assert queries.history(t, 1, task_id=2).first().numeric_value == 99.0
    with pytest.raises(ValueError):
        queries.history(t, 1, limit=0)
    with pytest.raises(ValueError):
        queries.history(t, 1, start=NOW, end=NOW)


def test_latest_with_an_empty_tag_and_both_forms(spark):
    late = [sample(2, 1, NOW + dt.timedelta(seconds=2), 30.0), sample(1, 1, NOW, 10.0), sample(3, 1, NOW, 20.0)]
    tags = [(1, "A", "float", None, None), (2, "B", "float", None, None)]
    t = tables_with(spark, late, tags, acquisition_node=[(1, 1, "n1", True), (1, 2, "n2", True), (1, 2, "n3", False)])
    rows = {r.tag_id: r for r in queries.latest_task_values(t, 1).collect()}
    assert (len(rows), rows[1].numeric_value, rows[2].sample_id) == (2, 30.0, None)
    a, b = queries.latest(t.tag_sample), queries.latest_by_rank(t.tag_sample)
    assert a.select(*sorted(a.columns)).exceptAll(b.select(*sorted(a.columns))).count() == 0


def test_latest_forms_agree_on_many_samples(spark):
    rows = spark.range(32 * 6250).select(
        (F.col("id") % 32).alias("tag_id"), F.lit(1).alias("task_id"), "id",
        (500 + F.col("id") % 100).cast("double").alias("numeric_value"),
        F.timestamp_seconds((F.col("id") / 32).cast("long") * 7919 % 6250).alias("source_timestamp"),
    )
    a, b = queries.latest(rows), queries.latest_by_rank(rows)
    columns = sorted(a.columns)
    assert a.count() == 32
    assert a.select(*columns).exceptAll(b.select(*columns)).count() == 0


def test_stale_bad_file_sample(spark):
    rows = [sample(1, 1, NOW - dt.timedelta(days=1), 5.0, good=False, source="file")]
    t = tables_with(spark, rows)
    found = queries.latest_values(t, "any", F.lit(NOW)).first()
    assert (found.stale, found.is_good, found.future_timestamp) == (True, False, False)
    assert found.cautions == "质量码异常（Bad）；数据已过期；来源为历史文件导入，不是实时采集"
    assert queries.latest_values(t, "opcua", F.lit(NOW)).first().sample_id is None


def test_positions_of_flat_and_single_series(spark):
    rows = [sample(1, 1, NOW, 5.0), sample(2, 1, NOW + dt.timedelta(seconds=4), 5.0), sample(3, 2, NOW, 1.0)]
    found = {r.id: r for r in queries.series_positions(tables_with(spark, rows).tag_sample).collect()}
    assert [(found[n].time_position, found[n].value_position) for n in (1, 2, 3)] == [(0.0, 0.0), (1.0, 0.0), (0.5, 0.0)]


def hot_rows(spark, n=6000):
    """One group holds most rows, many share one instant."""
    dice = random.Random(7)
    rows = []
    for ident in range(n):
        group = 1 if dice.random() < 0.7 else dice.randrange(2, 9)
        minute = 0 if dice.random() < 0.3 else dice.randrange(6000)
        rows.append((ident, group, utc(2026, 1, 1) + dt.timedelta(minutes=minute), dice.random() < 0.8, float(dice.randrange(40)), f"doc:{ident % 977}:{ident}"))
    return spark.createDataFrame(rows, "id LONG, grp LONG, at TIMESTAMP, good BOOLEAN, score DOUBLE, name STRING").cache()


def test_chunked_results_equal_plain_windows(spark):
    df = hot_rows(spark)
    hour = F.date_trunc("hour", "at")
    over = W.partitionBy("grp").orderBy("at", "id").rowsBetween(W.unboundedPreceding, 0)
    one = F.when(F.col("good"), 0).otherwise(1)
    total = running.running_total(df, ["grp"], hour, [F.col("at"), F.col("id")], one, "t").select("id", "t")
    assert total.exceptAll(df.select("id", F.sum(one).over(over).alias("t"))).count() == 0
    seen = running.previous_marked(df, ["grp"], hour, ["at", "id"], F.col("id"), F.col("good"), "p").select("id", "p")
    before = W.partitionBy("grp").orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1)
    plain = df.select("id", F.last(F.when(F.col("good"), F.col("id")), True).over(before).alias("p"))
    assert seen.exceptAll(plain).count() == 0
    rank = running.exact_rank(df, ["grp"], "score", "name", "r").select("id", "r")
    by = W.partitionBy("grp").orderBy(F.col("score").desc(), "name")
    assert rank.exceptAll(df.select("id", F.row_number().over(by).cast("long").alias("r"))).count() == 0
    first = running.first_rows(df, ["grp"], [F.col("at").asc(), F.col("id").asc()], 7, F.col("id")).select("id", "rank")
    rows = df.select("id", F.row_number().over(W.partitionBy("grp").orderBy("at", "id")).alias("rank")).where("rank <= 7")
    assert first.exceptAll(rows).count() == 0 and first.count() == rows.count()


def test_order_statistics(spark):
    df = hot_rows(spark)
    found = evaluation.latency_percentiles(df, ["grp"], "score").collect()
    values = {}
    for r in df.collect():
        values.setdefault(r.grp, []).append(r.score)
    for r in found:
        ordered = sorted(values[r.grp])
        n = len(ordered)
        assert r.median == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        assert r.p95 == ordered[-(-19 * n // 20) - 1]


def test_segments_join_across_hours(spark):
    rows = [sample(n, 1, NOW + dt.timedelta(minutes=20 * n), 1.0, n not in (4, 5)) for n in range(10)]
    found = queries.quality_segments(tables_with(spark, rows).tag_sample).orderBy("segment").collect()
    assert [(r.segment, r.points) for r in found] == [(0, 4), (2, 4)]


def test_retention_preview(spark):
    ages = [(1, 30, "opcua"), (2, 20, "opcua"), (3, 10, "opcua"), (4, 1, "opcua"), (5, 40, "file")]
    rows = [sample(n, 1, NOW - dt.timedelta(days=d), 1.0, source=s) for n, d, s in ages]
    t = tables_with(spark, rows)
    found = {r.source_type: r for r in lifecycle.retention_preview(t, F.lit(NOW), 7).collect()}
    live = found["opcua"]
    assert (live.matched_rows, live.affected_tags_in_scan, live.high_water_id, live.count_is_exact) == (3, 1, 4, True)
    assert found["file"].matched_rows == 1
    capped = {r.source_type: r for r in lifecycle.retention_preview(t, F.lit(NOW), 7, 2).collect()}["opcua"]
    assert (capped.matched_rows, capped.count_is_exact) == (3, False)
    cut = {r.source_type: r for r in lifecycle.retention_preview(t, F.lit(NOW), 7, 1).collect()}["opcua"]
    assert cut.matched_rows == 2
    assert naive(cut.newest_in_scan) == naive(NOW - dt.timedelta(days=20))
    none = lifecycle.retention_preview(tables_with(spark, []), F.lit(NOW), 7).first()
    assert (none.matched_rows, none.oldest_in_scan, none.high_water_id) == (0, None, 0)


def test_retention_preview_under_skew(spark):
    rows = spark.range(200_000).select(
        "id", F.lit(1).cast("long").alias("task_id"), F.lit(None).cast("long").alias("import_batch_id"),
        F.lit("opcua").alias("source_type"), F.lit(1).cast("long").alias("tag_id"),
        F.timestamp_seconds(F.col("id")).alias("source_timestamp"),
    )
    t = plant_with_tags(spark, [(1, "A", "float", None, None)]).replaced(tag_sample=rows)
    found = lifecycle.retention_preview(t, F.lit(NOW), 7, 70_000).where("source_type = 'opcua'").first()
    assert (found.matched_rows, found.count_is_exact) == (70_001, False)
    assert found.newest_in_scan.timestamp() % 86400 == 70_000 % 86400


def test_overview_with_empty_parents(spark):
    device = [(n, 1, f"D{n}", f"Device {n}", "active", "pump") for n in range(35)]
    tag = [(n, n // 2, f"T{n}", "t", "float", None, None, None, 1000, True) for n in range(68)]
    t = stored(
        spark, plant=[(1, "P1", "P", "active", None), (2, "P2", "P", "active", None)],
        production_line=[(1, 1, "L1", "L", "active", None), (2, 1, "L2", "L", "active", None)],
        device=device, tag=tag,
    )
    rows = assets.asset_overview(t).collect()
    full = [r for r in rows if r.plant_id == 1]
    assert (full[0].line_count, full[0].device_count, full[0].tag_count, full[0].truncated, len(full)) == (2, 35, 68, True, 30)
    empty = [r for r in rows if r.plant_id == 2]
    assert [(r.line_count, r.device_count, r.tag_count, r.device_id) for r in empty] == [(0, 0, 0, None)]


def test_archive_rules(spark):
    rows = [
        ("AI_UI_1234567890123_1", "AI界面测试 AI_UI_1234567890123_1", "合成数据测试", True),
        ("AI_UI_1234567890123_1", "other", "合成数据测试", False),
        ("PLANT_ABCD1234", "Synthetic Plant PLANT_ABCD1234 Updated", "Test Zone", True),
        ("AI_BUSINESS_1234567890123", "AI业务验收演示工厂 1234567890123", "合成演示，不是生产数据", True),
        ("RET_A_1234567890123", "保留预览测试A", None, True), ("RET_A_1234567890123", "保留预览测试B", None, False),
        ("REAL", "Plant", None, False),
    ]
    df = spark.createDataFrame(rows, "code STRING, name STRING, location STRING, expected BOOLEAN")
    assert lifecycle.archive_candidates(df).where("archive <> expected").count() == 0


def test_scope_export_and_restore(spark, sf_dir, tmp_path):
    from millrace.sources.star_binding import bind

    t = bind(spark, sf_dir)
    plants = t.plant.where("plant_id = 1")
    manifest = {r.table_name: r.row_count for r in lifecycle.export_scope(t, plants, str(tmp_path / "out")).collect()}
    counts = {r.table_name: r.inside_rows for r in lifecycle.subset_counts(t, plants).collect()}
    assert manifest == counts and manifest["tag_sample"] > 0


def test_fingerprint_sees_changes_not_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k INT, v STRING")
    base = lifecycle.fingerprint(df).first()
    assert lifecycle.fingerprint(df.orderBy(F.desc("k"))).first() == base
    for other in (df.limit(2), df.na.fill(""), df.union(df)):
        assert lifecycle.fingerprint(other).first() != base


def test_capacity_of_an_empty_table(spark, tmp_path):
    rows = spark.range(0)
    rows.write.parquet(str(tmp_path / "t"))
    found = lifecycle.capacity_estimate(spark, str(tmp_path / "t"), rows).first()
    assert (found.row_count, found.bytes_per_row, found.bytes_per_day) == (0, None, None)


def test_access_and_roles(spark):
    t = stored(
        spark, plant=[(1, "A", "A", "active", None), (2, "B", "B", "active", None)],
        user=[(1, "admin", True, True), (2, "engineer", False, True), (3, "observer", False, True)],
        user_plant_access=[(2, 1), (3, 1)],
    )
    asks = [(1, 2, True), (2, 1, True), (2, 2, True), (3, 1, False), (3, 1, True), (9, 1, False)]
    found = assets.access_decisions(spark.createDataFrame(asks, "user_id LONG, plant_id LONG, write BOOLEAN"), t)
    verdicts = {(r.user_id, r.plant_id, r.write): r.decision for r in found.collect()}
    assert [verdicts[a] for a in asks] == ["allowed", "allowed", "denied_plant", "allowed", "denied_role", "denied_plant"]


def test_delivery_audit(spark):
    def row(task, at, state, written, rows=None, error=0):
        return (task, NOW + dt.timedelta(seconds=at), state, written, written, 0, 0, error, 0, rows or written, 1.0)

    ddl = ("task_id LONG, taken_at TIMESTAMP, connection_state STRING, samples_received LONG, samples_written LONG, "
           "duplicate_count LONG, dropped_count LONG, error_count LONG, reconnect_count LONG, sample_rows LONG, "
           "heartbeat_age_seconds DOUBLE")
    polls = spark.createDataFrame(
        [row(1, 0, "connecting", 0), row(1, 50, "connected", 100), row(1, 100, "connected", 200),
         row(2, 0, "connected", 0), row(2, 50, "error", 90), row(2, 100, "connected", 200),
         row(3, 0, "connected", 0), row(3, 100, "connected", 200, rows=190)], ddl,
    )
    nodes = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "task_id LONG, node_count LONG")
    found = {r.task_id: r for r in batches.delivery_audit(polls, nodes, 1000, 5).collect()}
    assert [found[n].passed for n in (1, 2, 3)] == [True, False, False]
    assert (found[1].expected_samples, found[1].delivery_ratio, found[1].missing_samples) == (200, 1.0, 0)
    assert found[2].non_connected_polls == 1


def test_state_reconciliation(spark):
    desired = spark.createDataFrame(
        [(1, "running", "connected"), (2, "running", "error"), (3, "stopped", "connected"), (4, "stopped", "error")],
        "task_id LONG, desired_state STRING, connection_state STRING",
    )
    owned = spark.createDataFrame([(1,), (3,), (9,)], "task_id LONG")
    found = {r.task_id: r.action for r in batches.reconcile_states(desired, owned).collect()}
    assert found == {1: "keep", 2: "start", 3: "stop", 4: "repair", 9: "stop"}


def test_integrity_of_clean_tables(spark):
    rows = [sample(1, 1, NOW, 1.0)]
    t = tables_with(spark, rows, acquisition_task=[
        (1, 1, "T", "opc.tcp://sim:4840", 1000, 100, 1, 30, "running", "connected", None, None, 0, 0, 1, 1, 0, 0)
    ], acquisition_node=[(1, 1, "n1", True)])
    found = {r.rule: r.violations for r in integrity.integrity_audit(t, ["sim"]).collect()}
    assert set(found.values()) == {0}
    broken = t.replaced(tag_sample=t.tag_sample.union(t.tag_sample).withColumn("import_batch_id", F.lit(5).cast("long")))
    bad = {r.rule: r.violations for r in integrity.integrity_audit(broken, ["sim"]).collect()}
    assert {k for k, v in bad.items() if v} == {"live_sample_unique", "sample_source", "sample_batch"}


def test_fact_table_round_trip_prunes(spark, tmp_path):
    rows = [sample(n, n % 3, NOW + dt.timedelta(days=n % 4), 1.0, source="file" if n % 2 else "opcua") for n in range(40)]
    write_samples(tables_with(spark, rows).tag_sample, str(tmp_path / "tag_sample"))
    t = load_tables(spark, str(tmp_path))
    day = t.tag_sample.where("source_type = 'file'")
    assert day.count() == 20
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_type" in plan


def test_rules_of_a_table_take_two_passes(spark, sf_dir):
    from millrace.plans import workloads
    from millrace.sources import star_binding as star

    t = star.bind(spark, sf_dir)
    found = integrity.integrity_audit(workloads.damaged_tables(t), ["sim"])
    hits = {r.rule: r.violations for r in found.collect()}
    assert len(hits) == 31 and sum(n > 0 for n in hits.values()) >= 26
    # The samples come from the events: one scan for checks and references, one for unique keys.
    rows = {"tag_sample": t.tag_sample}
    alone = integrity.audit({**rows, "tag": t.tag, "acquisition_task": t.acquisition_task, "import_batch": t.import_batch},
                            {r: x for r, x in integrity.stored_rules(["sim"]).items() if x.table == "tag_sample"})
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_id") > 0 and sum("Relation [event_id" in line for line in plan.splitlines()) <= 2 + 1  # and one for the batches' own counts


def test_audit_of_any_rules(spark):
    tables = {
        "a": spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (9, "y")], "id long, name string"),
        "b": spark.createDataFrame([(1,), (1,), (7,), (7,), (8,), (None,)], "a_id long"),
    }
    rules = {
        "name_unique": integrity.Unique("a", ("name",)), "name_unique_above": integrity.Unique("a", ("name",), "id > 1"),
        "to_a": integrity.Reference("b", "a_id", "a", "id"), "small": integrity.Check("a", F.col("id") > 3), "never": integrity.Check("b", F.lit(False)),
    }
    assert {r.rule: r.violations for r in integrity.audit(tables, rules).collect()} == {
        "name_unique": 1, "name_unique_above": 0, "to_a": 3, "small": 2, "never": 0,
    }
