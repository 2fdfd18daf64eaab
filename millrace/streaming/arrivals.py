"""Import files as they arrive in a folder, each content once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.importing import ImportMapping, process
from millrace.session import read_if_present, staged
from millrace.sources.tables import Tables, empty_table
from millrace.sources.tabular import PROFILE_SCHEMA, _profile, read_files

_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


@dataclass(frozen=True)
class Arrivals:
    """A watched folder, its ledger of digests, and the table it fills.

    A file is one batch, named by its digest: a second file with the same bytes is listed
    as a duplicate and not read. After a restart Spark repeats the unfinished micro-batch,
    which replaces the same batch partitions as a whole.
    """

    spark: SparkSession
    folder: str
    root: str
    mapping: ImportMapping
    tables: Tables
    plant_id: int

    @property
    def samples_path(self) -> str:
        return f"{self.root}/samples"

    def _partitions(self, name: str) -> DataFrame | None:
        return read_if_present(self.spark, f"{self.root}/{name}")

    def ledger(self) -> DataFrame | None:
        return self._partitions("ledger")

    def counters(self) -> DataFrame | None:
        return self._partitions("counters")

    def take(self, files: DataFrame, micro_batch: int) -> None:
        """The ``foreachBatch`` body."""
        digest = F.sha2("content", 256)
        listed = files.select(
            "path", F.col("length").alias("file_size_bytes"), digest.alias("file_sha256"),
        ).withColumn("batch_id", F.conv(F.substring("file_sha256", 1, 15), 16, 10).cast("long"))
        known = self.ledger()
        first = listed.groupBy("file_sha256").agg(F.min("path").alias("_first"))
        noted = listed.join(first, "file_sha256").withColumn("_seen", F.lit(False))
        if known is not None:
            earlier = known.where((F.col("micro_batch") < micro_batch) & (F.col("status") == "imported")).select(
                "file_sha256"
            ).distinct().withColumn("_before", F.lit(True))
            noted = noted.join(earlier, "file_sha256", "left").withColumn(
                "_seen", F.coalesce("_before", F.lit(False))
            ).drop("_before")
        # An unreadable file fails alone, with its reason in the ledger.
        readable = files.select("path", "content").mapInPandas(_profile, PROFILE_SCHEMA).select("path", "error")
        status = (
            F.when(F.col("_seen") | (F.col("path") != F.col("_first")), "duplicate")
            .when(F.col("error").isNotNull(), "failed")
            .otherwise("imported")
        )
        noted = noted.join(readable, "path").withColumn("status", status).drop("_first", "_seen")
        # Contents are read once more at most, by the import.
        noted = staged(noted, "arrivals")
        # The listing of one micro-batch, limited by maxFilesPerTrigger.
        fresh = [r.path for r in noted.where(F.col("status") == "imported").select("path").collect()]
        if fresh:
            self._import(fresh, noted, micro_batch)
        noted.write.mode("overwrite").parquet(f"{self.root}/ledger/micro_batch={micro_batch}")

    def _import(self, paths: list[str], noted: DataFrame, micro_batch: int) -> None:
        raw = read_files(self.spark, paths).join(noted.select("path", "batch_id"), "path").withColumn(
            "plant_id", F.lit(self.plant_id)
        )
        stored = self._partitions("samples")
        if stored is None:
            stored = empty_table(self.spark, "tag_sample")
        tables = self.tables.replaced(tag_sample=stored)
        result = process(self.spark, raw, self.mapping, tables, self.samples_path)
        result.counters.write.mode("overwrite").parquet(f"{self.root}/counters/micro_batch={micro_batch}")
        result.issues.write.mode("overwrite").parquet(f"{self.root}/issues/micro_batch={micro_batch}")

    def start(self, files_per_batch: int = 100) -> StreamingQuery:
        """Import everything that is there now, then stop."""
        stream = (
            self.spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", "*.{csv,xlsx}")
            .load(self.folder)
        )
        return (
            stream.writeStream.foreachBatch(self.take)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
