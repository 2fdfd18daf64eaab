"""Import of a folder of files, each file a transaction of its own.

Every file gets a batch row with its status. A file that cannot be read, or lacks a mapped column, fails alone
with its reason; the others go on. Samples become visible with their batch row, which is written last: a
run that breaks off publishes nothing, and a repeated run replaces its own batches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.operators.importing import ImportMapping, accepted_samples, classify, counters, existing_keys, issues, within_bounds
from millrace.session import read_if_present, staged
from millrace.sources import tabular
from millrace.sources.tables import Tables
from millrace.streaming.daily import DailyTable

COUNTS = ("total_rows", "accepted_rows", "rejected_rows", "duplicate_rows", "warning_rows", "issue_count")
SAMPLE_COLUMNS = (
    "task_id LONG, import_batch_id LONG, source_type STRING, tag_id LONG, value STRING, numeric_value DOUBLE, "
    "source_timestamp TIMESTAMP, server_timestamp TIMESTAMP, received_at TIMESTAMP, status_code STRING, "
    "is_good BOOLEAN, import_run LONG"
)
KEYS = ("tag_id", "source_timestamp")


@dataclass(frozen=True)
class FolderImport:
    """Samples by day and key bucket, and one row for each file and run."""

    spark: SparkSession
    root: str
    buckets: int = 1

    @property
    def table(self) -> DailyTable:
        return DailyTable(self.spark, f"{self.root}/samples", SAMPLE_COLUMNS, KEYS, "source_timestamp", self.buckets)

    @property
    def batches_path(self) -> str:
        return f"{self.root}/batches"

    def batches(self) -> DataFrame | None:
        """The newest state of every batch."""
        every = read_if_present(self.spark, self.batches_path)
        if every is None:
            return None
        rest = F.struct(*[c for c in every.columns if c not in ("batch_id", "run")])
        return every.groupBy("batch_id").agg(F.max_by(rest, "run").alias("_b"), F.max("run").alias("run")).select("batch_id", "run", "_b.*")

    def samples(self) -> DataFrame | None:
        """Samples of completed batches, each as its newest run has left it."""
        stored = self.table.rows()
        return None if stored is None else self._visible(stored)

    def _visible(self, stored: DataFrame) -> DataFrame | None:
        """Rows whose batch row is written: those of a run that broke off, or was repeated, are not seen."""
        batches = self.batches()
        if batches is None:
            return None
        done = batches.where(F.col("status") == "completed").select(
            F.col("batch_id").alias("import_batch_id"), F.col("run").cast("long").alias("import_run")
        )
        return stored.join(done, ["import_batch_id", "import_run"], "left_semi")

    def known_keys(self, candidates: DataFrame, own: DataFrame | None = None) -> DataFrame | None:
        """Stored keys in the days and buckets of the candidates, but those of the batches ``own``.

        The set of places decides what is listed and read: one wrong date adds its own day and nothing between.
        """
        dated = candidates.where(F.col("source_timestamp").isNotNull())
        found = self.table.at(self.table.places(self.table.placed(dated)))
        visible = None if found is None else self._visible(found)
        if visible is None or own is None:
            return visible
        return visible.join(own.select(F.col("batch_id").alias("import_batch_id")), "import_batch_id", "left_anti")

    def run(self, number: int, folder: str, mapping: ImportMapping, tables: Tables, plant: Column, received_at: Column) -> DataFrame:
        """Import all files below ``folder``; returns the batch rows. ``plant`` is an expression over ``path``."""
        profiles = tabular.profiles_in(self.spark, folder)
        raw, counts = self._rows(folder, profiles, mapping)
        files = staged(_checked(profiles, counts, mapping).withColumn("batch_id", F.xxhash64("path")).withColumn("plant_id", plant), "files")
        good = files.where(F.col("status") == "completed").select("path", "batch_id", "plant_id")

        def stored(candidates: DataFrame) -> DataFrame:
            before = within_bounds(existing_keys(tables.tag_sample), candidates)
            own = self.known_keys(candidates, good)
            return before if own is None else before.unionByName(own.select(*KEYS))

        classified = classify(raw.join(good, "path"), mapping, tables, stored)
        accepted = accepted_samples(classified, received_at).withColumn("import_run", F.lit(number).cast("long"))
        self.table.add(self.table.placed(accepted), number)
        measured = counters(classified, issues(classified, mapping)).select("batch_id", *COUNTS)
        written = self._written(accepted, number)
        rows = (
            files.select("batch_id", "plant_id", "path", "status", "error_message")
            .join(measured, "batch_id", "left").join(written, "batch_id", "left")
            .na.fill(0, [*COUNTS, "published_rows"])
        )
        rows.write.mode("overwrite").parquet(f"{self.batches_path}/run={number}")
        return self.spark.read.parquet(f"{self.batches_path}/run={number}")

    def _written(self, accepted: DataFrame, number: int) -> DataFrame:
        """Rows of a run by batch, as its places hold them now."""
        found = self.table.at(self.table.places(self.table.placed(accepted)))
        mine = accepted.where("false") if found is None else found.where(F.col("import_run") == number)
        return mine.groupBy(F.col("import_batch_id").alias("batch_id")).agg(F.count("*").alias("published_rows"))

    def _rows(self, folder: str, profiles: DataFrame, mapping: ImportMapping) -> tuple[DataFrame, DataFrame]:
        """Rows of all readable files by column name, and the data rows of each file."""
        names = sorted(mapping.source_columns())
        cells, lines = tabular.line_cells(self.spark, folder, profiles)
        frames = [tabular.named_cells(cells, profiles, names)]
        counts = lines.select("path", (F.col("lines") - 1).alias("rows"))
        # Workbooks and files with line breaks in quotes are read whole, each by one task.
        whole = profiles.where(F.col("error").isNull() & ((F.col("file_format") == "xlsx") | F.col("multi_line")))
        for group in tabular.group_files(whole):
            rows = tabular.read_csv(self.spark, group) if group.file_format == "csv" else tabular.read_xlsx(self.spark, group)
            rows = rows.withColumn("path", tabular.same_path(F.col("path")))
            own = [F.col(f"`{n}`") if n in group.header else F.lit(None).cast("string").alias(n) for n in names]
            frames.append(rows.select("path", "source_row", *own))
            counted = rows.groupBy("path").agg(F.count("*").alias("rows"))
            counts = counts.join(counted.select("path"), "path", "left_anti").unionByName(counted)
        return reduce(DataFrame.unionByName, frames), counts


def _checked(profiles: DataFrame, counts: DataFrame, mapping: ImportMapping) -> DataFrame:
    """Files with status and reason: unreadable, without a mapped column though there are rows, or complete."""
    wanted = F.array(*[F.lit(n) for n in sorted(mapping.source_columns())])
    missing = F.array_except(wanted, F.col("header"))
    lacks = (F.size(missing) > 0) & (F.coalesce("rows", F.lit(0)) > 0)
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(
        lacks, F.concat(F.lit(fixed.MISSING_COLUMNS_TEXT), F.array_join(missing, "、"))
    )
    return profiles.join(counts, "path", "left").select(
        "path", F.when(reason.isNull(), "completed").otherwise("failed").alias("status"),
        F.substring(reason, 1, fixed.ERROR_TEXT_LIMIT).alias("error_message"),
    )
