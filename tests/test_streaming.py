"""Streaming acquisition: batches, replays and late data give the batch result."""

import datetime as dt

from helpers import utc
from pyspark.sql import functions as F

from millrace.streaming import acquisition
from millrace.streaming.acquisition import LiveStore, latest_updates, notifications, to_samples

START = utc(2026, 8, 22)


def notification_rows(spark, rows):
    return spark.createDataFrame(rows, acquisition.NOTIFICATION_SCHEMA)


def note(seq, node, at, value="1.5", received=None, task=1):
    return (task, seq, node, value, at, None, received or START + dt.timedelta(seconds=seq), "Good", True)


def node_table(spark):
    return spark.createDataFrame([(1, "n1", 11), (1, "n2", 12)], "task_id LONG, node_id STRING, tag_id LONG")


def feed(spark, folder, batches):
    for n, rows in enumerate(batches):
        notification_rows(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))
        yield n


def test_counts_and_replay(spark, tmp_path):
    inbox, store = tmp_path / "in", LiveStore(spark, str(tmp_path / "live"))
    first = [note(1, "n1", START), note(2, "n1", START, "9.9"), note(3, "gone", START), note(4, "n2", None)]
    late = [note(5, "n1", START - dt.timedelta(days=400)), note(6, "n1", START), note(7, "n2", START + dt.timedelta(seconds=4))]
    for _ in feed(spark, inbox, [first, late]):
        stream = to_samples(notifications(spark, str(inbox), 1), node_table(spark))
        store.start(stream).awaitTermination()
    kept = {(r.tag_id, r.source_timestamp.timestamp()): r.numeric_value for r in store.samples().collect()}
    assert len(kept) == 3 and sorted(kept.values()) == [1.5, 1.5, 1.5]
    totals = store.counters().first()
    assert (totals.samples_received, totals.samples_written, totals.duplicate_count, totals.dropped_count) == (6, 3, 3, 1)
    assert totals.last_sample_at.timestamp() == store.samples().agg(F.max("source_timestamp")).first()[0].timestamp()
    # A batch that runs again replaces itself and counts nothing twice.
    store.store(to_samples(notification_rows(spark, late), node_table(spark)), 1)
    assert store.counters().first().samples_written == 3
    assert store.samples().count() == 3


def test_one_key_repeated_very_often(spark, tmp_path):
    store = LiveStore(spark, str(tmp_path / "live"))
    rows = [note(n, "n1", START, str(n)) for n in range(500)] + [note(500 + n, "n2", START + dt.timedelta(seconds=n)) for n in range(100)]
    store.store(to_samples(notification_rows(spark, rows), node_table(spark)), 0)
    totals = store.counters().first()
    assert (totals.samples_written, totals.duplicate_count) == (101, 499)
    assert store.samples().where("tag_id = 11").first().numeric_value == 0.0


def test_latest_and_states_as_streams(spark, tmp_path):
    inbox = tmp_path / "in"
    list(feed(spark, inbox, [[note(1, "n1", START, "1"), note(2, "n1", START + dt.timedelta(seconds=9), "2")],
                             [note(3, "n1", START + dt.timedelta(seconds=5), "3"), note(4, "n2", START, "4")]]))
    stream = latest_updates(to_samples(notifications(spark, str(inbox), 1), node_table(spark)))
    query = (
        stream.writeStream.outputMode("complete").format("memory").queryName("latest_seen")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = {r.tag_id: r.numeric_value for r in spark.table("latest_seen").collect()}
    assert found == {11: 2.0, 12: 4.0}


def test_bounded_dedupe_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    list(feed(spark, inbox, [[note(1, "n1", START), note(2, "n1", START)], [note(3, "n1", START), note(4, "n2", START)]]))
    stream = acquisition.bounded_dedupe(to_samples(notifications(spark, str(inbox), 1), node_table(spark)), "1 hour")
    query = (
        stream.writeStream.format("memory").queryName("dedupe_seen")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.tag_id for r in spark.table("dedupe_seen").collect()) == [11, 12]


def test_state_guard_stream(spark, tmp_path):
    ddl = "task_id LONG, seq LONG, reported_at TIMESTAMP, state STRING"
    rows = [(1, 1, START, "connected"), (1, 2, START + dt.timedelta(seconds=5), "stopped"), (2, 3, START, "connected"), (2, 4, START, "stopped")]
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "events"))
    tasks = spark.createDataFrame([(1, "running"), (2, "stopped")], "task_id LONG, desired_state STRING")
    events = spark.readStream.schema(ddl).parquet(str(tmp_path / "events"))
    query = (
        acquisition.admitted_states(events, tasks).writeStream.outputMode("complete").format("memory")
        .queryName("states_seen").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {r.task_id: r.connection_state for r in spark.table("states_seen").collect()} == {1: "connected", 2: "stopped"}


def test_lookups_read_only_their_own_places(spark, tmp_path):
    """Repeats are found over many batches and after merging, and no other day or bucket is read."""
    store = LiveStore(spark, str(tmp_path / "live"), buckets=4, merge_above=3)
    days = [START - dt.timedelta(days=n) for n in range(6)]
    nodes = node_table(spark)
    for batch in range(7):
        rows = [note(100 * batch + n, "n1", day) for n, day in enumerate(days[: batch + 1])]
        store.store(to_samples(notification_rows(spark, rows), nodes), batch)
    assert store.samples().count() == 6
    totals = store.counters().first()
    assert (totals.samples_received, totals.samples_written, totals.duplicate_count) == (27, 6, 21)
    table = store.table
    wanted = table.places(table.placed(to_samples(notification_rows(spark, [note(1, "n1", days[2])]), nodes)))
    found = table.at(wanted)
    assert len(wanted) == 1 and found.count() == 1
    assert all(f"sample_date={days[2]:%Y-%m-%d}/bucket={wanted[0].bucket}" in f for f in found.inputFiles())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert len(store._counter_versions()) == 2


def test_merging_keeps_every_row_and_survives_a_crash(spark, tmp_path):
    store = LiveStore(spark, str(tmp_path / "live"), buckets=1, merge_above=100)
    nodes, table = node_table(spark), store.table
    for batch in range(6):
        rows = [note(batch, "n1", START + dt.timedelta(seconds=batch)), note(50 + batch, "n2", START)]
        store.store(to_samples(notification_rows(spark, rows), nodes), batch)
    place = table.places(store.samples().transform(table.placed))[0]
    assert len(table.folders(place)) == 6
    kept = sorted(r.seq for r in store.samples().collect())
    copies = {f.name: sorted(p.read_bytes() for p in (tmp_path / "live/samples" / f.name).glob("*.parquet")) for f in table.folders(place)}
    assert table.compact([place], 5, folders=2) == [place]
    assert [(f.merged, f.upto) for f in table.folders(place)] == [(True, 4), (False, 5)]
    assert sorted(r.seq for r in table.at([place]).collect()) == kept == sorted(r.seq for r in store.samples().collect())
    # A folder that a crash left behind is passed over, and removed by the next merge.
    name = next(n for n in copies if n.endswith("upto=2"))
    folder = tmp_path / "live/samples" / name
    folder.mkdir(parents=True)
    for n, raw in enumerate(copies[name]):
        (folder / f"part-{n}.parquet").write_bytes(raw)
    assert sorted(r.seq for r in table.at([place]).collect()) == kept
    table.compact([place], 6, folders=2)
    assert [(f.merged, f.upto) for f in table.folders(place)] == [(True, 5)] and sorted(r.seq for r in store.samples().collect()) == kept
    # A batch that runs again does not see itself, and replaces its totals.
    before = store.counters().first()
    store.store(to_samples(notification_rows(spark, [note(6, "n1", START + dt.timedelta(seconds=6))]), nodes), 6)
    store.store(to_samples(notification_rows(spark, [note(6, "n1", START + dt.timedelta(seconds=6))]), nodes), 6)
    after = store.counters().first()
    assert (after.samples_received, after.samples_written) == (before.samples_received + 1, before.samples_written + 1)
