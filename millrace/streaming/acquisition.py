"""Live acquisition as Structured Streaming: map, normalise, de-duplicate, count.

A batch writes its samples into day and bucket partitions under its own number, and replaces the table
of running counters. It looks for known keys in the partitions of its own days and buckets only, which are
merged when they hold many batches, so that its cost does not follow the history. A batch that Spark
runs again after a failure looks only at earlier batches, and so writes the same rows and totals again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.functions import parsing
from millrace.streaming.daily import PLACE, DailyTable, Place

NOTIFICATION_SCHEMA = (
    "task_id LONG, seq LONG, node_id STRING, value STRING, source_timestamp TIMESTAMP, "
    "server_timestamp TIMESTAMP, received_at TIMESTAMP, status_code STRING, is_good BOOLEAN"
)
STORED_COLUMNS = (
    "task_id LONG, tag_id LONG, seq LONG, value STRING, numeric_value DOUBLE, source_timestamp TIMESTAMP, "
    "server_timestamp TIMESTAMP, received_at TIMESTAMP, status_code STRING, is_good BOOLEAN"
)
SAMPLE_KEYS = ("task_id", "tag_id", "source_timestamp")
COUNTERS = ("samples_received", "samples_written", "duplicate_count", "dropped_count")


def notifications(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Notification files as a stream. Back-pressure limits a batch; nothing is dropped."""
    return (
        spark.readStream.schema(NOTIFICATION_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def mapped_nodes(nodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Enabled nodes of running tasks."""
    running = tasks.where(F.col("desired_state") == "running").select("task_id")
    return nodes.where("is_enabled").join(running, "task_id", "left_semi").select(
        "task_id", "node_id", "tag_id"
    )


def to_samples(stream: DataFrame, nodes: DataFrame) -> DataFrame:
    """Map notifications to tags and normalise them; an unmapped one keeps a null tag."""
    return stream.join(nodes, ["task_id", "node_id"], "left").withColumn(
        "_live", parsing.live_value(F.col("value"))
    ).select(
        "task_id", "tag_id", "seq", F.col("_live.value").alias("value"),
        F.col("_live.numeric_value").alias("numeric_value"),
        parsing.utc_or(F.col("source_timestamp"), F.col("received_at")).alias("source_timestamp"),
        "server_timestamp", "received_at", "status_code", "is_good",
    )


@dataclass(frozen=True)
class LiveStore:
    """Samples by day and key bucket, and running counters, under one folder.

    ``buckets`` cut a day's keys: about one for each 100 MB of samples a day, since each batch writes a file
    for every day and bucket it touches. Every ``merge_above`` batches the places of a batch are merged.
    """

    spark: SparkSession
    root: str
    buckets: int = 1
    merge_above: int = 8

    @property
    def table(self) -> DailyTable:
        return DailyTable(self.spark, f"{self.root}/samples", STORED_COLUMNS, SAMPLE_KEYS, "source_timestamp", self.buckets)

    @property
    def counters_path(self) -> str:
        return f"{self.root}/counters"

    def samples(self) -> DataFrame | None:
        return self.table.rows()

    def _counter_versions(self) -> list[int]:
        """Batches whose counters are stored whole, oldest first: three at most."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.counters_path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        whole = [s.getPath().getName() for s in files.listStatus(path) if files.exists(path.suffix(f"/{s.getPath().getName()}/_SUCCESS"))]
        return sorted(int(name.removeprefix("upto=")) for name in whole)

    def counters(self, before: int | None = None) -> DataFrame | None:
        """Totals per task up to the newest batch, or the newest below ``before``: one small table is read."""
        known = [v for v in self._counter_versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.counters_path}/upto={known[-1]}") if known else None

    def store(self, batch: DataFrame, batch_id: int) -> None:
        """The ``foreachBatch`` body: first notification of a key wins, for all time."""
        batch = batch.persist()
        try:
            mapped = batch.where(F.col("tag_id").isNotNull())
            rest = [c for c in mapped.columns if c not in SAMPLE_KEYS]
            # Combines on the map side: a key that repeats very often is one row per task.
            first = mapped.groupBy(*SAMPLE_KEYS).agg(
                F.min_by(F.struct(*rest), F.struct("received_at", "seq")).alias("_row")
            ).select(*SAMPLE_KEYS, "_row.*")
            placed = self.table.placed(first)
            places = self.table.places(self.table.placed(mapped))
            stored = self.table.at(places, batch_id)
            if stored is not None:
                keys = [*PLACE, *SAMPLE_KEYS]
                placed = placed.join(stored.select(*keys), keys, "left_anti")
            self.table.add(placed.select(*[c.split()[0] for c in STORED_COLUMNS.split(", ")], *PLACE), batch_id)
            self._count(batch, self._written(places, batch_id), batch_id)
            if batch_id % self.merge_above == 0:
                self.table.compact(places, batch_id, self.merge_above - 1)
        finally:
            batch.unpersist()

    def _written(self, places: list[Place], batch_id: int) -> DataFrame | None:
        """What a batch has stored, read back: the anti join does not run again."""
        found = self.table.at(places)
        return None if found is None else found.where((F.col("upto") == batch_id) & (F.col("kind") == "batch"))

    def _count(self, batch: DataFrame, written: DataFrame | None, batch_id: int) -> None:
        """New totals: those of the last batch before, plus this one's. The last sample never moves back."""
        known = F.col("tag_id").isNotNull()
        change = batch.groupBy("task_id").agg(
            F.count_if(known).alias("samples_received"),
            F.count_if(~known).alias("dropped_count"),
            F.max(F.when(known, F.col("source_timestamp"))).alias("last_sample_at"),
            F.max("received_at").alias("heartbeat_at"),
        )
        if written is None:
            change = change.withColumn("samples_written", F.lit(0).cast("long"))
        else:
            kept = written.groupBy("task_id").agg(F.count("*").alias("samples_written"))
            change = change.join(kept, "task_id", "left").na.fill(0, ["samples_written"])
        change = change.withColumn("duplicate_count", F.col("samples_received") - F.col("samples_written"))
        before = self.counters(batch_id)
        if before is not None:
            change = change.unionByName(before)
        totals = change.groupBy("task_id").agg(
            *[F.sum(c).alias(c) for c in COUNTERS],
            F.max("last_sample_at").alias("last_sample_at"), F.max("heartbeat_at").alias("heartbeat_at"),
        )
        totals.write.mode("overwrite").parquet(f"{self.counters_path}/upto={batch_id}")
        # The version before stays, since this batch may run again.
        for old in self._counter_versions()[:-2]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.counters_path}/upto={old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, samples: DataFrame, interval: str | None = None) -> StreamingQuery:
        """Run the stream: every ``interval``, or once over everything that is available."""
        writer = samples.writeStream.foreachBatch(self.store).option(
            "checkpointLocation", f"{self.root}/checkpoint"
        )
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return writer.trigger(**trigger).start()


def bounded_dedupe(samples: DataFrame, horizon: str) -> DataFrame:
    """De-duplication inside the stream's own state, for keys that repeat within ``horizon``."""
    return samples.where(F.col("tag_id").isNotNull()).withWatermark("source_timestamp", horizon).dropDuplicatesWithinWatermark(
        list(SAMPLE_KEYS)
    )


def latest_updates(samples: DataFrame) -> DataFrame:
    """The newest sample per task and tag, kept as streaming state; one row per node."""
    newest = F.max_by(
        F.struct("value", "numeric_value", "source_timestamp", "status_code", "is_good"),
        F.struct("source_timestamp", "seq"),
    )
    return samples.where(F.col("tag_id").isNotNull()).groupBy("task_id", "tag_id").agg(
        newest.alias("_row")
    ).select("task_id", "tag_id", "_row.*")


def admitted_states(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Streaming form of the state guard: the newest admitted state per task."""
    joined = events.join(tasks.select("task_id", "desired_state"), "task_id")
    admitted = (F.col("desired_state") == "stopped") == (F.col("state") == "stopped")
    return joined.where(admitted).groupBy("task_id").agg(
        F.max_by("state", F.struct("reported_at", "seq")).alias("connection_state")
    )
