"""A table in day and key-bucket partitions that micro-batches add to and look up by place.

Folders are ``day/bucket/kind/upto``: a batch writes its rows of a place under ``kind=batch`` with its own
number, and a compaction merges a place's folders into one under ``kind=merged``. A lookup lists and
reads only the places it asks for, so its cost follows the batch and not the history.

A batch that runs again replaces its own folders. A compaction covers earlier batches only. It moves a
finished folder to its place and then removes the folders it replaces; a lookup passes over folders that
a merged one covers, so a crash in between changes nothing and the next compaction cleans up.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import read_if_present

PLACE = ("sample_date", "bucket")
FOLDERS = (*PLACE, "kind", "upto")
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Place:
    """One day and bucket; rows without a time have no day."""

    sample_date: object
    bucket: int

    @property
    def folder(self) -> str:
        return f"sample_date={self.sample_date or _NO_DAY}/bucket={self.bucket}"


@dataclass(frozen=True)
class Folder:
    name: str
    merged: bool
    upto: int


@dataclass(frozen=True)
class DailyTable:
    """``columns`` is the DDL of the data columns; ``keys`` choose the bucket, ``time`` the day."""

    spark: SparkSession
    path: str
    columns: str
    keys: tuple[str, ...]
    time: str
    buckets: int = 1

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their day and bucket."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        return rows.withColumn("sample_date", F.to_date(self.time)).withColumn("bucket", bucket)

    def places(self, placed: DataFrame) -> list[Place]:
        """The distinct places of a batch: at most its days times the buckets."""
        return [Place(*r) for r in placed.select(*PLACE).distinct().collect()]

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, folder: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")

    def _listed(self, place: Place) -> list[Folder]:
        found = []
        for status in self._files().globStatus(self._at(f"{place.folder}/kind=*/upto=*")) or []:
            name, kind = status.getPath().getName(), status.getPath().getParent().getName()
            found.append(Folder(f"{place.folder}/{kind}/{name}", kind == "kind=merged", int(name.removeprefix("upto="))))
        return sorted(found, key=lambda folder: folder.upto)

    def folders(self, place: Place) -> list[Folder]:
        """The folders of one place that count; only that place is listed."""
        found = self._listed(place)
        merged = max((f.upto for f in found if f.merged), default=-1)
        return [f for f in found if f.upto > merged or (f.merged and f.upto == merged)]

    def at(self, places: Iterable[Place], before: int | None = None) -> DataFrame | None:
        """Stored rows of some places, of batches below ``before``; nothing else is listed or read."""
        paths = [f"{self.path}/{f.name}" for p in places for f in self.folders(p) if before is None or f.upto < before]
        if not paths:
            return None
        schema = f"{self.columns}, sample_date DATE, bucket INT, kind STRING, upto LONG"
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)

    def add(self, placed: DataFrame, batch_id: int) -> None:
        """Write a batch's rows; a repeated batch replaces what it wrote before."""
        rows = placed.withColumn("kind", F.lit("batch")).withColumn("upto", F.lit(batch_id).cast("long"))
        rows.repartition(*PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(self.path)

    def compact(self, places: Iterable[Place], before: int, folders: int = 8) -> list[Place]:
        """Merge the folders, below batch ``before``, of places that have more than ``folders`` of them."""
        full: dict[int, list[Place]] = {}
        for place in places:
            old = [f for f in self._listed(place) if f.upto < before]
            if len(old) > folders:
                full.setdefault(max(f.upto for f in old), []).append(place)
        for upto, group in full.items():
            target = f"{self.path}-merging/{uuid.uuid4().hex}"
            rows = self.at(group, before).withColumn("kind", F.lit("merged")).withColumn("upto", F.lit(upto).cast("long"))
            rows.repartition(*PLACE).write.partitionBy(*FOLDERS).parquet(target)
            for place in group:
                self._publish(target, place, upto)
            self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(target), True)
        return [p for group in full.values() for p in group]

    def _publish(self, target: str, place: Place, upto: int) -> None:
        """Move a merged folder to its place, then remove what it covers."""
        files, folder = self._files(), f"{place.folder}/kind=merged/upto={upto}"
        if not files.exists(self._at(folder)):
            files.mkdirs(self._at(f"{place.folder}/kind=merged"))
            files.rename(self.spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{folder}"), self._at(folder))
        for old in self._listed(place):
            if old.upto <= upto and old.name != folder:
                files.delete(self._at(old.name), True)

    def rows(self) -> DataFrame | None:
        """All stored rows, without the folder columns other than the day."""
        stored = read_if_present(self.spark, self.path)
        return None if stored is None else stored.drop("bucket", "kind", "upto")
