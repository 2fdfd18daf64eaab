"""Retention previews, capacity, scoped archives and table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import fixed_values as fixed
from millrace.operators.assets import hierarchy
from millrace.operators.running import chunk_offsets
from millrace.session import staged
from millrace.sources.tables import PARENT_FIRST, Tables

_ID_SPAN = 65_536


def _first_by_id(old: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first ``limit + 1`` rows of each group by id."""
    span = F.floor(F.col("id") / _ID_SPAN)
    spans = chunk_offsets(old, keys, span, F.lit(1))
    # The span that holds candidate number limit + 1, or none when there are fewer.
    border = spans.where((F.col("_before") <= limit) & (F.col("_before") + F.col("_total") > limit)).select(
        *keys, F.col("_chunk").alias("_border"), F.col("_before").alias("_taken")
    )
    # Staged: one row per plant and source, and the plan sees its size.
    placed = old.withColumn("_span", span).join(staged(border, "retention-border"), keys, "left")
    whole = placed.where(F.col("_border").isNull() | (F.col("_span") < F.col("_border")))
    place = F.row_number().over(W.partitionBy(*keys, "_span").orderBy("id"))
    cut = (
        placed.where(F.col("_span") == F.col("_border"))
        .withColumn("_place", place)
        .where(F.col("_place") <= limit + 1 - F.col("_taken"))
        .drop("_place")
    )
    return whole.unionByName(cut)


def retention_preview(
    t: Tables, as_of: Column, keep_days: int, limit: int | None = None
) -> DataFrame:
    """What a retention of ``keep_days`` would cover, per plant and source.

    All candidates count. With a ``limit``, counts, tags and times describe the first
    ``limit + 1`` candidates by id only, and beyond ``limit`` the count is a lower bound. The
    last of these ids is then located by counting spans of ids, so that a plant with most of
    the samples is neither sorted nor limited in one task.
    """
    if not 1 <= keep_days <= fixed.RETENTION_MAX_DAYS:
        raise ValueError(f"keep_days must be between 1 and {fixed.RETENTION_MAX_DAYS}")
    keys = ["plant_id", "source_type"]
    cutoff = F.timestamp_add("DAY", F.lit(-keep_days), as_of)
    plant = hierarchy(t).select("tag_id", "plant_id")
    scoped = t.tag_sample.select("id", "tag_id", "source_type", "source_timestamp").join(plant, "tag_id")
    high = scoped.groupBy(*keys).agg(F.max("id").alias("high_water_id"))

    old = scoped.where(F.col("source_timestamp") < cutoff)
    counted = old if limit is None else _first_by_id(old, keys, limit)
    # Tags are counted in two steps: distinct pairs combine on the map side.
    per_tag = counted.groupBy(*keys, "tag_id").agg(
        F.count("*").alias("_rows"), F.min("source_timestamp").alias("_oldest"),
        F.max("source_timestamp").alias("_newest"),
    )
    found = per_tag.groupBy(*keys).agg(
        F.sum("_rows").alias("matched_rows"), F.count("*").alias("affected_tags_in_scan"),
        F.min("_oldest").alias("oldest_in_scan"), F.max("_newest").alias("newest_in_scan"),
    )
    sources = F.explode(F.array(F.lit("opcua"), F.lit("file"))).alias("source_type")
    counts = ["matched_rows", "affected_tags_in_scan", "high_water_id"]
    return (
        t.plant.select("plant_id", sources)
        .join(high, keys, "left")
        .join(found, keys, "left")
        .na.fill(0, counts)
        .select(
            *keys, F.lit(keep_days).alias("keep_days"), cutoff.alias("cutoff"), "high_water_id",
            "matched_rows", (F.lit(True) if limit is None else F.col("matched_rows") <= limit).alias("count_is_exact"),
            "affected_tags_in_scan", "oldest_in_scan", "newest_in_scan",
        )
    )


def capacity_estimate(
    spark: SparkSession, path: str, table: DataFrame, rows_per_second: float = 24.0
) -> DataFrame:
    """Bytes, rows, bytes per row, and the bytes per day at a planned rate.

    File sizes come from the listing; no content is read. The row count comes from the
    Parquet footers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), F.count("*").alias("files"))
    rows = table.agg(F.count("*").alias("row_count"))
    per_row = F.try_divide(F.col("total_bytes"), F.nullif(F.col("row_count"), F.lit(0)))
    return size.withColumn("row_count", rows.scalar()).select(
        "files", "total_bytes", "row_count", per_row.alias("bytes_per_row"),
        F.lit(float(rows_per_second)).alias("rows_per_second"),
        (per_row * rows_per_second * 86400).alias("bytes_per_day"),
    )


def archive_candidates(plants: DataFrame) -> DataFrame:
    """Flag the plants whose code, name and location all match one archive rule."""
    code, name, location = F.col("code"), F.col("name"), F.col("location")
    rest, kind = F.substring_index(code, "_", -1), F.substring(code, 5, 1)

    def spelled(text: str) -> Column:
        parts = {"{code}": code, "{rest}": rest, "{kind}": kind}
        for mark, col in parts.items():
            if mark in text:
                before, after = text.split(mark)
                return F.concat(F.lit(before), col, F.lit(after))
        return F.lit(text)

    verdict = F.lit(False)
    for pattern, names, place in reversed(fixed.ARCHIVE_RULES):
        named = reduce(lambda a, b: a | b, [name == spelled(n) for n in names])
        located = location.isNull() if place is None else F.coalesce(location == place, F.lit(False))
        verdict = F.when(code.rlike(pattern), named & located).otherwise(verdict)
    return plants.withColumn("archive", verdict)


@dataclass(frozen=True)
class _Link:
    table: str
    column: str
    parent: str
    key: str


_CHILDREN = (
    _Link("production_line", "plant_id", "plant", "plant_id"),
    _Link("device", "line_id", "production_line", "line_id"),
    _Link("tag", "device_id", "device", "device_id"),
    _Link("acquisition_task", "plant_id", "plant", "plant_id"),
    _Link("import_batch", "plant_id", "plant", "plant_id"),
    _Link("import_field_mapping", "batch_id", "import_batch", "batch_id"),
    _Link("import_job", "batch_id", "import_batch", "batch_id"),
    _Link("data_quality_issue", "batch_id", "import_batch", "batch_id"),
    _Link("knowledge_document", "plant_id", "plant", "plant_id"),
    _Link("assistant_run", "plant_id", "plant", "plant_id"),
    _Link("user_plant_access", "plant_id", "plant", "plant_id"),
    _Link("retention_preview", "plant_id", "plant", "plant_id"),
)
# Facts belong to a subset through any one of their references.
_ANY_OF = {
    "acquisition_node": (("tag_id", "tag", "tag_id"), ("task_id", "acquisition_task", "task_id")),
    "tag_sample": (
        ("tag_id", "tag", "tag_id"), ("task_id", "acquisition_task", "task_id"),
        ("import_batch_id", "import_batch", "batch_id"),
    ),
}


def _flagged(df: DataFrame, column: str, parent: DataFrame, key: str, flag: str) -> DataFrame:
    ids = parent.select(F.col(key).alias(column)).distinct().withColumn(flag, F.lit(True))
    return df.join(ids, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def membership(t: Tables, plants: DataFrame) -> dict[str, DataFrame]:
    """Every table with a flag ``inside``: does the row belong to the chosen plants?

    One flag splits a table into the subset and its complement with a single join, and the
    two parts are disjoint and complete by construction.
    """
    tables = t.as_dict()
    flagged = {"plant": _flagged(t.plant, "plant_id", plants, "plant_id", "inside")}

    def subset(name: str) -> DataFrame:
        return flagged[name].where("inside")

    for link in _CHILDREN:
        flagged[link.table] = _flagged(
            tables[link.table], link.column, subset(link.parent), link.key, "inside"
        )
    for name, references in _ANY_OF.items():
        df = tables[name]
        for n, (column, parent, key) in enumerate(references):
            df = _flagged(df, column, subset(parent), key, f"_in{n}")
        hits = [F.col(f"_in{n}") for n in range(len(references))]
        flagged[name] = df.withColumn("inside", reduce(lambda a, b: a | b, hits)).select(
            *tables[name].columns, "inside"
        )
    return {name: flagged[name].select(*tables[name].columns, "inside") for name in PARENT_FIRST}


def split_scope(t: Tables, plants: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The rows of the chosen plants and the rows of all others, table by table."""
    flagged = membership(t, plants)
    inside = {n: df.where("inside").drop("inside") for n, df in flagged.items()}
    outside = {n: df.where("NOT inside").drop("inside") for n, df in flagged.items()}
    return inside, outside


def export_scope(t: Tables, plants: DataFrame, path: str) -> DataFrame:
    """Write the subset as one Parquet folder per table and return its manifest."""
    inside, _ = split_scope(t, plants)
    spark = t.plant.sparkSession
    written = {}
    for name, df in inside.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        written[name] = spark.read.parquet(f"{path}/{name}")
    return row_counts(written)


def restore_scope(outside: dict[str, DataFrame], inside: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Put a subset back: the union of the two disjoint parts, table by table."""
    return {name: outside[name].unionByName(inside[name]) for name in outside}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def subset_counts(t: Tables, plants: DataFrame) -> DataFrame:
    """Manifest: rows inside and outside the chosen plants, per table."""
    parts = [
        df.agg(
            F.count_if("inside").alias("inside_rows"), F.count_if(~F.col("inside")).alias("outside_rows")
        ).select(F.lit(name).alias("table_name"), "inside_rows", "outside_rows")
        for name, df in membership(t, plants).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def cross_scope_references(t: Tables, plants: DataFrame) -> DataFrame:
    """References that leave the chosen subset, counted per table and column.

    Such rows need a manual review before an archive: a fact of the subset whose tag, task
    or batch lies outside, or a duplicate batch on the other side of its original.
    """
    flagged = membership(t, plants)
    parts = []
    for name, references in _ANY_OF.items():
        facts = flagged[name].where("inside").drop("inside")
        for column, parent, key in references:
            outside = facts.where(F.col(column).isNotNull()).join(
                flagged[parent].where("inside").select(F.col(key).alias(column)), column, "left_anti"
            )
            parts.append(
                outside.agg(F.count("*").alias("row_count")).select(
                    F.lit(name).alias("table_name"), F.lit(column).alias("reference"), "row_count"
                )
            )
    batch = flagged["import_batch"]
    original = batch.select(F.col("batch_id").alias("duplicate_of_id"), F.col("inside").alias("_original"))
    split = batch.join(original, "duplicate_of_id").where(F.col("inside") != F.col("_original"))
    parts.append(
        split.agg(F.count("*").alias("row_count")).select(
            F.lit("import_batch").alias("table_name"), F.lit("duplicate_of_id").alias("reference"), "row_count"
        )
    )
    return reduce(DataFrame.unionByName, parts)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-independent fingerprint of a table: rows, and two 64-bit row-hash digests.

    The sum wraps in decimal and the xor is kept beside it, so equal rows cannot cancel.
    """
    names = sorted(columns or df.columns)
    row = F.xxhash64(*names, *[F.col(n).isNull() for n in names])
    return df.select(row.alias("h")).agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
    )


def fingerprints(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        fingerprint(df).select(F.lit(name).alias("table_name"), "row_count", "hash_sum", "hash_xor")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


DIGEST_MODULUS = 1 << 61


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """A row as text that any engine can build: whole numbers and flags as they are, times in microseconds,
    other numbers in whole millionths, with a mark for nulls."""
    kinds = dict(df.dtypes)

    def cell(name: str) -> Column:
        col, kind = F.col(name), kinds[name]
        if kind.startswith("timestamp"):
            col = F.unix_micros(col)
        elif kind in ("double", "float"):
            col = F.floor(col * 1_000_000 + 0.5)
        return F.coalesce(col.cast("string"), F.lit(chr(30)))

    return F.concat_ws(chr(31), *[cell(c) for c in columns])


def digests(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]]) -> DataFrame:
    """(``table_name``, ``row_count``, ``digest``): a multiset hash that other engines can repeat.

    The digest is the sum of the first 60 bits of each row's MD5, modulo 2^61: it does not depend on the order
    of rows, counts repeated ones, and combines before the shuffle.
    """
    parts = []
    for name, names in columns.items():
        bits = F.conv(F.substring(F.md5(row_text(tables[name], names)), 1, 15), 16, 10).cast("decimal(38,0)")
        total = F.coalesce(F.sum(bits), F.lit(0)) % F.lit(DIGEST_MODULUS).cast("decimal(38,0)")
        parts.append(tables[name].agg(F.count("*").alias("row_count"), total.cast("long").alias("digest")).select(
            F.lit(name).alias("table_name"), "row_count", "digest"
        ))
    return reduce(DataFrame.unionByName, parts)


def changed_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables whose fingerprints differ."""
    renamed = after.withColumnsRenamed({c: f"{c}_after" for c in ("row_count", "hash_sum", "hash_xor")})
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"{c}_after")) for c in ("row_count", "hash_sum", "hash_xor")],
    )
    return before.join(renamed, "table_name", "full_outer").where(~same).select("table_name")
