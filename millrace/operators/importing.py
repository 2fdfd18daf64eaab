"""Governed import: map, validate, de-duplicate, count and write measurement files.

One declarative plan classifies every measurement by the first rule it breaks. Nothing is
collected: the samples, the issues and the counters are three reads of one staged table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import fixed_values as fixed
from millrace.functions import parsing
from millrace.functions.text import clean, fold, is_missing, lookup, raw_text
from millrace.operators.assets import active_path, hierarchy
from millrace.operators.running import first_rows, running_total
from millrace.session import staged
from millrace.sources.tables import Tables

ROW_KEYS = ("batch_id", "source_row")
CELL_KEYS = ("batch_id", "source_row", "position")
# More than the 500 measurement columns that a wide mapping may have.
MAX_WIDE_COLUMNS = 500
_POSITIONS = 1_024

# Rules in the order in which a measurement is tested; the first broken one counts.
DUPLICATE_RULES = ("duplicate_in_file", "duplicate_existing")
MESSAGES = fixed.ISSUE_MESSAGES
# Rules that share an issue type with another rule.
_ISSUE_OF_RULE = {
    "missing_timestamp": "missing_required", "unknown_pair": "unknown_tag",
    "invalid_boolean": "invalid_value", "invalid_integer": "invalid_value",
    "not_finite": "invalid_value",
}


@dataclass(frozen=True)
class WideColumn:
    """One measurement column of a wide file, and the tag it holds."""

    source_column: str
    tag_code: str
    device_code: str | None = None


@dataclass(frozen=True)
class ImportMapping:
    """How the columns of a file map to measurements. Checked when it is built."""

    timestamp_column: str
    layout: str = "long"
    tag_code_column: str | None = None
    value_column: str | None = None
    device_code_column: str | None = None
    quality_column: str | None = None
    wide_columns: tuple[WideColumn, ...] = ()

    def __post_init__(self) -> None:
        if self.layout == "long":
            if not self.tag_code_column or not self.value_column:
                raise ValueError("a long mapping needs a tag code column and a value column")
            if self.wide_columns:
                raise ValueError("a long mapping has no wide columns")
        elif self.layout == "wide":
            if self.tag_code_column or self.value_column or self.device_code_column:
                raise ValueError("a wide mapping takes its tags from the wide columns only")
            if not self.wide_columns:
                raise ValueError("a wide mapping needs at least one measurement column")
            if len(self.wide_columns) > MAX_WIDE_COLUMNS:
                raise ValueError(f"a wide mapping has at most {MAX_WIDE_COLUMNS} columns")
            names = [w.source_column for w in self.wide_columns]
            if len(set(names)) != len(names):
                raise ValueError("a wide mapping may use each source column once")
        else:
            raise ValueError(f"unknown layout: {self.layout}")

    @property
    def measurements_per_row(self) -> int:
        return len(self.wide_columns) or 1

    def source_columns(self) -> set[str]:
        named = (
            self.timestamp_column, self.tag_code_column, self.value_column,
            self.device_code_column, self.quality_column,
            *(w.source_column for w in self.wide_columns),
        )
        return {n for n in named if n}

    def missing_from(self, header: list[str]) -> list[str]:
        """Mapped columns that the header lacks; the batch fails when there are any."""
        return sorted(self.source_columns() - set(header))

    def fields(self) -> list[tuple[str, str]]:
        pairs = [("timestamp_column", self.timestamp_column), ("quality_column", self.quality_column)]
        pairs += [
            ("tag_code_column", self.tag_code_column),
            ("value_column", self.value_column),
            ("device_code_column", self.device_code_column),
        ]
        pairs += [
            (f"wide_value_{n:03d}", w.source_column) for n, w in enumerate(self.wide_columns, 1)
        ]
        return [(target, source) for target, source in pairs if source]


def field_mapping_rows(batches: DataFrame, mapping: ImportMapping) -> DataFrame:
    """The mapping as stored: one (target_field, source_column) row per batch and field."""
    pairs = F.array(
        *[
            F.struct(F.lit(t).alias("target_field"), F.lit(s).alias("source_column"))
            for t, s in mapping.fields()
        ]
    )
    return batches.select("batch_id", F.explode(pairs).alias("p")).select("batch_id", "p.*")


def source_measurements(raw: DataFrame, mapping: ImportMapping) -> DataFrame:
    """File rows to one row per measurement, with the row's time and quality parsed once.

    ``raw`` holds ``batch_id``, ``plant_id``, ``source_row`` and the file's text columns.
    """
    missing = mapping.missing_from(raw.columns)
    if missing:
        raise ValueError("mapped columns are missing: " + ", ".join(missing))

    def cell(name: str | None) -> Column:
        return F.lit(None).cast("string") if name is None else F.col(f"`{name}`").cast("string")

    def measurement(value_field, tag_field, tag_code, device_code, value) -> Column:
        return F.struct(
            F.lit(value_field).alias("value_field"), F.lit(tag_field).alias("tag_field"),
            tag_code.alias("tag_code_raw"), device_code.alias("device_code_raw"),
            value.alias("value_raw"),
        )

    if mapping.layout == "long":
        cells = [
            measurement(
                mapping.value_column, mapping.tag_code_column, cell(mapping.tag_code_column),
                cell(mapping.device_code_column), cell(mapping.value_column),
            )
        ]
    else:
        cells = [
            measurement(
                w.source_column, w.source_column, F.lit(w.tag_code),
                F.lit(w.device_code).cast("string"), cell(w.source_column),
            )
            for w in mapping.wide_columns
        ]
    # Spread by the rows' own key: it evens out files of any size before the costly
    # parsing, and is the partitioning that the duplicate marks are joined on later.
    row = raw.repartition(*ROW_KEYS).select(
        *ROW_KEYS, "plant_id",
        cell(mapping.timestamp_column).alias("timestamp_raw"),
        cell(mapping.quality_column).alias("quality_raw"),
        F.array(*cells).alias("_cells"),
    )
    # Step by step, so that each text is matched once and not once for every use.
    parsed = (
        row.withColumn("_time", clean(F.col("timestamp_raw")))
        .withColumn("status_code", parsing.quality_status(F.col("quality_raw")))
        .withColumn("_plain", parsing.plain_timestamp(F.col("_time")))
        .withColumn("_parts", F.when(F.col("_plain").isNull(), parsing.timestamp_parts(F.col("_time"))))
        .withColumn(
            "source_timestamp", F.coalesce("_plain", parsing.timestamp_from_parts(F.col("_parts")))
        )
        .withColumn("is_good", parsing.is_good_status(F.col("status_code")))
    )
    return parsed.select(
        *ROW_KEYS, "plant_id", "timestamp_raw", "quality_raw", "source_timestamp", "status_code",
        "is_good", F.posexplode("_cells").alias("position", "_cell"),
    ).select("*", "_cell.*").drop("_cell")


def tag_catalogue(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Usable tags by (plant, device code, tag code) and by (plant, tag code), folded.

    Both have one row per key with the number of tags behind it, so that a repeated code
    is reported as ambiguous and never multiplies a measurement.
    """
    usable = active_path(hierarchy(t)).select(
        "plant_id", fold(F.col("device_code")).alias("_device_key"), fold(F.col("code")).alias("_tag_key"),
        "tag_id", "data_type", "min_value", "max_value",
    )
    detail = F.struct("tag_id", "data_type", "min_value", "max_value")

    def by(*keys: str) -> DataFrame:
        return usable.groupBy("plant_id", *keys).agg(
            F.count("*").alias("_matches"), F.min(detail).alias("_tag")
        )

    return by("_device_key", "_tag_key"), by("_tag_key")


def resolve_tags(measurements: DataFrame, t: Tables, mapping: ImportMapping | None = None) -> DataFrame:
    """Attach the tag of each measurement: by device and tag code, or by tag code alone.

    A wide ``mapping`` names all codes that its files can have. The catalogue is cut to them and staged, so
    that the plan knows how small it is and the measurements are not shuffled to a few codes.
    """
    by_pair, by_code = tag_catalogue(t)
    if mapping is not None and mapping.wide_columns:
        codes = [fold(clean(F.lit(w.tag_code))) for w in mapping.wide_columns]
        devices = [fold(clean(F.lit(w.device_code))) for w in mapping.wide_columns if w.device_code]
        named = F.col("_tag_key").isin(*codes)
        by_pair = staged(by_pair.where(named & F.col("_device_key").isin(*devices)), "import-pairs")
        by_code = staged(by_code.where(named), "import-codes")
    device = clean(F.col("device_code_raw"))
    has_device = F.coalesce(device != "", F.lit(False))
    keyed = (
        measurements.withColumn("_has_device", has_device)
        .withColumn("_tag_key", fold(clean(F.col("tag_code_raw"))))
        .withColumn("_device_key", F.when(has_device, fold(device)))
    )
    pair = by_pair.withColumnsRenamed({"_matches": "_pair_matches", "_tag": "_pair_tag"})
    code = by_code.withColumnsRenamed({"_matches": "_code_matches", "_tag": "_code_tag"})

    def chosen(suffix: str) -> Column:
        return F.when(F.col("_has_device"), F.col(f"_pair_{suffix}")).otherwise(
            F.col(f"_code_{suffix}")
        )

    return (
        keyed.join(pair, ["plant_id", "_device_key", "_tag_key"], "left")
        .join(code, ["plant_id", "_tag_key"], "left")
        .withColumn("_matches", F.coalesce(chosen("matches"), F.lit(0)))
        .withColumn("_tag", F.when(F.col("_matches") == 1, chosen("tag")))
        .drop("_pair_matches", "_pair_tag", "_code_matches", "_code_tag", "_device_key", "_tag_key")
    )


def check_cells(resolved: DataFrame) -> DataFrame:
    """Add the parsed value and the first broken rule before de-duplication."""
    required = is_missing(F.col("tag_code_raw")) | is_missing(F.col("value_raw"))
    data_type = F.col("_tag.data_type")
    text, number, numeric = F.col("_text"), F.col("_number"), F.col("numeric_value")
    # Columns of their own, not fields of a struct: the optimizer inlines struct fields
    # into every use, and each use would parse the text again.
    typed = (
        resolved.withColumn("_text", clean(F.col("value_raw")))
        .withColumn("_folded", fold(text))
        .withColumn("_number", parsing.finite_number(text))
        .withColumn(
            "numeric_value", parsing.typed_number(data_type, parsing.truth_value(F.col("_folded")), number)
        )
        .withColumn("_ok", (data_type == "string") | numeric.isNotNull())
        .withColumn("value", parsing.typed_json(data_type, text, numeric))
    )
    outside = parsing.outside_range(numeric, F.col("_tag.min_value"), F.col("_tag.max_value"))
    # Text that is a number to a parser, but not a finite one.
    unbounded = (data_type != "boolean") & number.isNull() & (
        F.col("_folded").rlike(fixed.NON_FINITE_PATTERN) | text.rlike(fixed.NUMBER_PATTERN)
    )
    ok = F.col("_ok")
    rule = (
        F.when(is_missing(F.col("timestamp_raw")), "missing_timestamp")
        .when(F.col("source_timestamp").isNull(), "invalid_timestamp")
        .when(required, "missing_required")
        .when((F.col("_matches") == 0) & F.col("_has_device"), "unknown_pair")
        .when(F.col("_matches") == 0, "unknown_tag")
        .when(F.col("_matches") > 1, "ambiguous_tag")
        .when(~ok & (data_type == "boolean"), "invalid_boolean")
        .when(~ok & (data_type == "integer") & number.isNotNull(), "invalid_integer")
        .when(~ok & unbounded, "not_finite")
        .when(~ok, "invalid_value")
        .when(outside, "out_of_range")
    )
    span = F.concat(
        F.lit(MESSAGES["out_of_range"] + " ["),
        F.coalesce(F.col("_tag.min_value").cast("string"), F.lit("None")), F.lit(", "),
        F.coalesce(F.col("_tag.max_value").cast("string"), F.lit("None")), F.lit("]"),
    )
    message = F.when(F.col("_rule") == "out_of_range", span).otherwise(
        lookup(MESSAGES, F.col("_rule"))
    )
    return typed.withColumn("_rule", rule).withColumn("_message", message).select(
        *CELL_KEYS, "plant_id", "value_field", "tag_field", "tag_code_raw", "device_code_raw",
        "value_raw", "timestamp_raw", "quality_raw", "source_timestamp", "status_code", "is_good",
        F.col("_tag.tag_id").alias("tag_id"), "value", "numeric_value", "_rule", "_message",
    )


def existing_keys(samples: DataFrame) -> DataFrame:
    """Keys of stored file samples; live samples never block an import."""
    return samples.where(F.col("source_type") == "file").select("tag_id", "source_timestamp")


def within_bounds(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cut the stored keys to the time span of the candidates, as literals for the scan.

    Costs one small job over the staged candidates, and lets the scan of the stored table
    skip whole days and row groups.
    """
    low, high = candidates.agg(F.min("source_timestamp"), F.max("source_timestamp")).first()
    return stored if low is None else stored.where(F.col("source_timestamp").between(F.lit(low), F.lit(high)))


def mark_duplicates(checked: DataFrame, stored: DataFrame) -> DataFrame:
    """Decide first-wins duplicates inside a batch, then duplicates of stored samples.

    The first measurement of a (tag, time) key is found by a ``min`` that combines on the
    map side, however often the key repeats. It goes back to its row by the row's own
    unique key, so a repeated key never gathers its rows in one task. Batches of one run
    count as stored in the order of their ids.
    """
    key = ["tag_id", "source_timestamp"]
    # Row and position in one long keep the aggregate's buffer fixed, hence hashed.
    place = F.col("source_row") * _POSITIONS + F.col("position")
    passed = checked.where(F.col("_rule").isNull())
    firsts = passed.groupBy("batch_id", *key).agg(F.min(place).alias("_first"))
    known = stored.select(*key).distinct().withColumn("_known", F.lit(True))
    earliest = F.min("batch_id").over(W.partitionBy(*key))
    # One map per source row, from the position to whether the key is stored already. A
    # row has at most as many positions as its file has columns.
    stored_mark = F.struct(
        (F.col("_first") % _POSITIONS).cast("int").alias("key"),
        (F.col("_earlier") | F.col("_known").isNotNull()).alias("value"),
    )
    winners = (
        firsts.withColumn("_earlier", earliest < F.col("batch_id"))
        .join(known, key, "left")
        .groupBy("batch_id", F.expr(f"_first div {_POSITIONS}").alias("source_row"))
        .agg(F.map_from_entries(F.collect_list(stored_mark)).alias("_marks"))
    )
    duplicate = F.when(F.col("_stored").isNull(), "duplicate_in_file").when(
        F.col("_stored"), "duplicate_existing"
    )
    rule = F.coalesce("_rule", duplicate)
    return (
        checked.join(winners, list(ROW_KEYS), "left")
        .withColumn("_stored", F.try_element_at("_marks", F.col("position")))
        .withColumn("rule", rule)
        .withColumn("message", F.coalesce("_message", lookup(MESSAGES, F.col("rule"))))
        .withColumn("issue_type", F.coalesce(lookup(_ISSUE_OF_RULE, F.col("rule")), F.col("rule")))
        .drop("_stored", "_marks", "_rule", "_message")
    )


def classify(
    raw: DataFrame, mapping: ImportMapping, t: Tables, stored: DataFrame | Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Every measurement of the files with its ``rule`` and ``issue_type``, null when accepted.

    ``stored`` holds the keys that are there already, or is a function that looks them up for the candidates.

    Staged twice in the shared folder: the cells are parsed once, though the search for
    duplicates reads them twice, and the verdicts serve all reports.
    """
    cells = check_cells(resolve_tags(source_measurements(raw, mapping), t, mapping))
    checked = staged(cells, "import-checked")
    passed = checked.where(F.col("_rule").isNull())
    known = stored(passed) if callable(stored) else within_bounds(stored, passed)
    return staged(mark_duplicates(checked, known), "import-classified")


def accepted_samples(classified: DataFrame, received_at: Column) -> DataFrame:
    """Rows for the fact table. The id is assigned by the caller's table format, if any."""
    return classified.where(F.col("rule").isNull()).select(
        F.lit(None).cast("long").alias("task_id"), F.col("batch_id").alias("import_batch_id"),
        F.lit("file").alias("source_type"), "tag_id", "value", "numeric_value", "source_timestamp",
        F.lit(None).cast("timestamp").alias("server_timestamp"), received_at.alias("received_at"),
        "status_code", "is_good",
    )


def issues(classified: DataFrame, mapping: ImportMapping) -> DataFrame:
    """All issues, in no order.

    A time that is missing or wrong rejects every measurement of its row but is reported
    once. A bad quality is a warning, once per row, and only when the time was good.
    """
    stamp = F.lit(mapping.timestamp_column)
    quality = F.lit(mapping.quality_column).cast("string")
    first = F.col("position") == 0
    by_row = F.col("rule").isin("missing_timestamp", "invalid_timestamp")
    by_tag = F.col("rule").isin("unknown_pair", "unknown_tag", "ambiguous_tag")
    repeated = F.col("rule") == "duplicate_in_file"
    existing = F.col("rule") == "duplicate_existing"
    field = (
        F.when(by_row | existing, stamp).when(by_tag, F.col("tag_field")).otherwise(F.col("value_field"))
    )
    shown = (
        F.when(by_row | repeated, F.col("timestamp_raw"))
        .when(existing, F.date_format("source_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        .when(by_tag, F.col("tag_code_raw"))
        .otherwise(F.col("value_raw"))
    )

    def issue(kind, severity, name, raw, message, position) -> Column:
        return F.struct(
            kind.alias("issue_type"), F.lit(severity).alias("severity"), name.alias("field_name"),
            raw_text(raw).alias("raw_value"), message.alias("message"), position.alias("emit_order"),
        )

    warning = F.when(
        first & F.col("source_timestamp").isNotNull() & ~F.col("is_good"),
        issue(F.lit("bad_quality"), "warning", quality, F.col("quality_raw"),
              F.lit(MESSAGES["bad_quality"]), F.lit(-1)),
    )
    error = F.when(
        F.col("rule").isNotNull() & (first | ~by_row),
        issue(F.col("issue_type"), "error", field, shown, F.col("message"), F.col("position")),
    )
    found = F.array_compact(F.array(warning, error))
    return classified.select("batch_id", "source_row", F.explode(found).alias("i")).select(
        "batch_id", F.col("source_row").alias("row_number"), "i.*"
    )


# Rows of a batch whose issues are numbered together.
ISSUE_CHUNK_ROWS = 4096


def stored_issues(all_issues: DataFrame, limit: int | None = None) -> DataFrame:
    """The issues that a batch keeps, numbered by row and position: all, or the first ``limit``."""
    if limit is None:
        order = [F.col("row_number").asc(), F.col("emit_order").asc(), F.col("issue_type").asc()]
        chunk = F.floor(F.col("row_number") / ISSUE_CHUNK_ROWS)
        numbered = running_total(all_issues, ["batch_id"], chunk, order, F.lit(1), "issue_number")
        return numbered.withColumn("issue_number", F.col("issue_number").cast("int"))
    unique = F.struct("row_number", "emit_order", "issue_type")
    return first_rows(
        all_issues, ["batch_id"],
        [F.col("row_number").asc(), F.col("emit_order").asc(), F.col("issue_type").asc()],
        limit, unique,
    ).withColumnRenamed("rank", "issue_number")


def counters(
    classified: DataFrame, all_issues: DataFrame, limit: int | None = None
) -> DataFrame:
    """The counters of every batch. A row warns at most once, so warnings count rows."""
    measured = classified.groupBy("batch_id").agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("rule").isNull()).alias("accepted_rows"),
        F.count_if(F.col("rule").isNotNull()).alias("rejected_rows"),
        F.count_if(F.col("rule").isin(*DUPLICATE_RULES)).alias("duplicate_rows"),
    )
    reported = all_issues.groupBy("batch_id").agg(
        F.count_if(F.col("severity") == "warning").alias("warning_rows"),
        F.count("*").alias("issue_count"),
    )
    joined = measured.join(reported, "batch_id", "left").na.fill(0, ["warning_rows", "issue_count"])
    if limit is None:
        return joined.withColumn("stored_issue_count", F.col("issue_count")).withColumn("issues_truncated", F.lit(False))
    return joined.withColumn("stored_issue_count", F.least("issue_count", F.lit(limit))).withColumn(
        "issues_truncated", F.col("issue_count") > limit
    )


def issue_summary(all_issues: DataFrame) -> DataFrame:
    """Issues by (batch, severity, type) with the advice for each type."""
    return all_issues.groupBy("batch_id", "severity", "issue_type").agg(
        F.count("*").alias("issue_count")
    ).withColumn("advice", lookup(fixed.ISSUE_ADVICE, F.col("issue_type")))


def issue_report(stored: DataFrame) -> DataFrame:
    """The six report columns of stored issues, ordered by row and number."""
    names = ("row_number", "severity", "issue_type", "field_name", "raw_value", "message")
    ordered = stored.orderBy("batch_id", "row_number", "issue_number")
    return ordered.select(
        "batch_id",
        *[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(label)
          for n, label in zip(names, fixed.ISSUE_REPORT_COLUMNS, strict=True)],
    )


def write_issue_report(stored: DataFrame, path: str) -> None:
    """One CSV folder per batch. The order inside each file is the report's."""
    issue_report(stored).write.mode("overwrite").partitionBy("batch_id").option("header", True).csv(path)


@dataclass(frozen=True)
class ImportResult:
    """The published outcome of an import run."""

    classified: DataFrame
    samples: DataFrame
    issues: DataFrame
    counters: DataFrame


def process(
    spark: SparkSession, raw: DataFrame, mapping: ImportMapping, t: Tables, samples_path: str,
    received_at: Column | None = None, issue_limit: int | None = None,
) -> ImportResult:
    """Import the files in ``raw`` and publish each batch as a whole.

    Samples go to one partition per batch with dynamic overwrite: a failed run publishes
    nothing, and a repeated run replaces its own batches instead of adding to them.
    """
    if received_at is None:
        received_at = F.current_timestamp()
    stored = existing_keys(t.tag_sample)
    if "import_batch_id" in t.tag_sample.columns:
        own = raw.select(F.col("batch_id").alias("import_batch_id")).distinct()
        stored = existing_keys(t.tag_sample.join(own, "import_batch_id", "left_anti"))
    classified = classify(raw, mapping, t, stored)

    accepted_samples(classified, received_at).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("import_batch_id").parquet(samples_path)
    found = issues(classified, mapping)
    return ImportResult(
        classified, spark.read.parquet(samples_path), stored_issues(found, issue_limit),
        counters(classified, found, issue_limit),
    )
