"""Measurement files: profile, read, inspect, fingerprint, suggest mappings.

File bytes reach Python only for the 64 KiB profile and for workbooks. CSV rows are read by
Spark's own reader, one call per group of files that share encoding, delimiter and header.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import fixed_values as fixed
from millrace.functions.text import fold, let
from millrace.operators.running import previous_marked
from millrace.session import staged
from millrace.sources import workbook

PROFILE_SCHEMA = (
    "path STRING, file_format STRING, encoding STRING, delimiter STRING, quote STRING, "
    "multi_line BOOLEAN, header ARRAY<STRING>, sheet STRING, error STRING"
)


class TabularError(ValueError):
    pass


def file_format(path: str) -> str:
    """The format by suffix; anything but CSV and XLSX is refused."""
    for suffix, name in fixed.FILE_SUFFIXES.items():
        if path.casefold().endswith(suffix):
            return name
    raise TabularError(f"only .csv and .xlsx files are supported: {path}")


def check_header(header: Sequence[str | None]) -> list[str]:
    """Trimmed header names, all present and unique."""
    names = [(name or "").strip() for name in header]
    if not any(names):
        raise TabularError("the file has no header row")
    if not all(names):
        raise TabularError("every source column needs a header")
    if len(set(names)) != len(names):
        raise TabularError("source column headers must be unique")
    return names


def detect_encoding(content: bytes) -> str:
    """The first encoding that decodes every byte; a block at a time, so that no second copy is made."""
    for name in fixed.CSV_ENCODINGS:
        decoder = codecs.getincrementaldecoder(name)()
        try:
            for begin in range(0, len(content), fixed.DECODE_BLOCK):
                decoder.decode(content[begin : begin + fixed.DECODE_BLOCK])
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            continue
        return name
    raise TabularError("CSV files must be UTF-8 or GB18030")


def sniff(text: str) -> tuple[str, str]:
    """(delimiter, quote character) of a CSV sample.

    Where the lines do not agree (lines of blanks between them are enough for that), the header decides: a
    comma if it holds one, else the delimiter that it holds most often, else a comma. Quotes are double then.
    """
    try:
        dialect = csv.Sniffer().sniff(text, delimiters=fixed.CSV_DELIMITERS)
    except csv.Error:
        header = "".join((text.splitlines() or [""])[0].split('"')[::2])
        if "," in header:
            return ",", '"'
        return max(fixed.CSV_DELIMITERS, key=lambda d: (header.count(d), d == ",")), '"'
    return dialect.delimiter, dialect.quotechar or '"'


def _profile_one(path: str, content: bytes) -> tuple:
    try:
        kind = file_format(path)
        if kind == "xlsx":
            rows = workbook.sheet_rows(content)
            first = next(rows, None)
            if first is None:
                raise TabularError("the worksheet is empty")
            header = check_header(first[1])
            return path, kind, None, None, None, False, header, workbook.sheet_name(content), None
        encoding = detect_encoding(content)
        # Only the dialect is guessed from a sample; it ends with a whole character.
        delimiter, quote = sniff(codecs.getincrementaldecoder(encoding)().decode(content[: fixed.SNIFF_BYTES]))
        lines = io.TextIOWrapper(io.BytesIO(content), encoding=encoding, newline="")
        reader = csv.reader(lines, delimiter=delimiter, quotechar=quote)
        header = check_header(next(reader, []))
        multi = has_quoted_break(content, quote.encode())
        return path, kind, encoding, delimiter, quote, multi, header, None, None
    except (TabularError, workbook.WorkbookError) as error:
        return path, None, None, None, None, False, None, None, str(error)


def has_quoted_break(content: bytes, quote: bytes) -> bool:
    """Whether a line break lies inside quotes, which rules out splitting the file."""
    inside = content.split(quote)[1::2]
    return any(b"\n" in part or b"\r" in part for part in inside)


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in PROFILE_SCHEMA.split(", ")]
    for batch in batches:
        rows = [_profile_one(p, bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
        yield pd.DataFrame(rows, columns=names)


def binary_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths))


def fingerprints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Size and SHA-256 of each file."""
    return binary_files(spark, paths).select(
        "path", F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("file_sha256"),
    )


def profile(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Encoding, delimiter, header and sheet of each file, or the reason it is unreadable."""
    return binary_files(spark, paths).select("path", "content").mapInPandas(_profile, PROFILE_SCHEMA)


def changed_files(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files whose digest differs from the one recorded at preview."""
    before = recorded.select("path", F.col("file_sha256").alias("recorded_sha256"))
    return current.join(before, "path").where(F.col("file_sha256") != F.col("recorded_sha256"))


def with_source_file(batches: DataFrame, listing: DataFrame) -> DataFrame:
    """Batches with a flag for whether the source file still exists."""
    there = listing.select(F.col("path").alias("storage_key")).distinct().withColumn("_there", F.lit(True))
    return batches.join(there, "storage_key", "left").withColumn(
        "source_file_available", F.coalesce("_there", F.lit(False))
    ).drop("_there")


@dataclass(frozen=True)
class FileGroup:
    """Files that one reader call can take."""

    file_format: str
    encoding: str | None
    delimiter: str | None
    quote: str | None
    multi_line: bool
    header: tuple[str, ...]
    paths: tuple[str, ...]


def group_files(profiles: DataFrame) -> list[FileGroup]:
    """Group the profiled files. Headers and the caller's own paths are all that is collected."""
    bad = profiles.where(F.col("error").isNotNull()).select("path", "error").first()
    if bad is not None:
        raise TabularError(f"{bad.error}: {bad.path}")
    keys = ["file_format", "encoding", "delimiter", "quote", "multi_line", "header"]
    rows = profiles.groupBy(*keys).agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    return [FileGroup(*[r[k] for k in keys[:5]], tuple(r.header), tuple(r.paths)) for r in rows]


def _spark_encoding(name: str | None) -> str:
    return "UTF-8" if name == "utf-8-sig" else "GB18030"


def read_csv(spark: SparkSession, group: FileGroup) -> DataFrame:
    """Rows of a group of CSV files as text, with ``path`` and ``source_row``.

    Files split into blocks. A row's number is its place in its block plus the rows of the
    file's earlier blocks; the sums are over blocks, so a huge file is not sorted.
    """
    schema = ", ".join(f"`{name}` STRING" for name in group.header)
    reader = (
        spark.read.schema(schema)
        .option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
        .option("sep", group.delimiter).option("quote", group.quote).option("escape", group.quote)
        .option("encoding", _spark_encoding(group.encoding))
        .option("multiLine", group.multi_line)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
    )
    rows = reader.csv(list(group.paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
        *[F.col(f"`{name}`") for name in group.header],
    )
    return _number_rows(rows)


def _number_rows(rows: DataFrame, first: int = 2) -> DataFrame:
    """Rows with their place in the file; ``first`` is the number of the first row that was read."""
    offsets, _ = _block_offsets(rows)
    return _numbered(rows, offsets, first)


def _block_offsets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each block of a file starts to count, and the number of rows of each file."""
    blocks = rows.groupBy("path", "_block").agg(F.count("*").alias("_rows"), F.min("_seen").alias("_start"))
    before = W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(
        "path", "_block", "_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    # Staged, so that the plan knows how small the table of blocks is, and the files are not
    # read again for it.
    offsets = staged(offsets.join(blocks.select("path", "_block", "_rows"), ["path", "_block"]), "csv-blocks")
    return offsets.drop("_rows"), offsets.groupBy("path").agg(F.sum("_rows").alias("lines"))


def _numbered(rows: DataFrame, offsets: DataFrame, first: int) -> DataFrame:
    number = F.col("_before") + F.col("_seen") - F.col("_start") + first
    return rows.join(offsets, ["path", "_block"]).withColumn("source_row", number).drop(
        "_block", "_seen", "_start", "_before", "_rows"
    )


def same_path(path: Column) -> Column:
    """A path as every reader spells it."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def profiles_in(spark: SparkSession, folder: str, glob: str = "*.{csv,xlsx}") -> DataFrame:
    """Profiles of all files below a folder, staged: contents are read for them once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    found = files.select(same_path(F.col("path")).alias("path"), "content").mapInPandas(_profile, PROFILE_SCHEMA)
    return staged(found, "profiles")


def line_cells(spark: SparkSession, folder: str, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``path``, ``source_row``, ``cells``) of all CSV files below a folder, and the lines of each file.

    One reader takes all files, whatever their encoding, delimiter and header: files are split into blocks of
    lines, a line is decoded and parsed as its file's profile says, and no list of files leaves the
    executors. Empty lines are no rows; a line of blanks is one. Files with line breaks inside quotes are
    not read here.
    """
    plain = profiles.where((F.col("file_format") == "csv") & ~F.col("multi_line"))
    shape = plain.agg(F.max(F.size("header")).alias("width"), F.collect_set(F.struct("delimiter", "quote")).alias("kinds")).first()
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]").text(folder)
    rows = (
        lines.select(same_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("_block"), "value")
        .where(F.octet_length("value") > 0)
        .withColumn("_seen", F.monotonically_increasing_id())
    )
    offsets, counts = _block_offsets(rows.drop("value"))
    how = plain.select("path", "encoding", "delimiter", "quote")
    decoded = F.when(F.col("encoding") == "gb18030", F.decode(F.col("value").cast("binary"), "GB18030")).otherwise(F.col("value"))
    named = _numbered(rows, offsets, 1).where("source_row > 1").join(how, "path").withColumn("line", decoded)
    cells = F.lit(None).cast("array<string>")
    names = [f"c{n}" for n in range(shape["width"] or 0)]
    for kind in shape["kinds"] or []:  # three delimiters and two quotes at most
        options = {
            "sep": kind.delimiter, "quote": kind.quote, "escape": kind.quote, "mode": "PERMISSIVE", "emptyValue": "",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
        }
        parsed = F.from_csv(F.col("line"), F.lit(", ".join(f"{c} STRING" for c in names)), options)
        fits = (F.col("delimiter") == kind.delimiter) & (F.col("quote") == kind.quote)
        # Bound once: each line is parsed once, for all its cells.
        cells = F.when(fits, let(parsed, lambda row: F.array(*[row[c] for c in names]))).otherwise(cells)
    return named.select("path", "source_row", cells.alias("cells")), counts


def named_cells(cells: DataFrame, profiles: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cells by header name; a name that a file lacks is null."""
    place = lambda name: F.array_position("header", F.lit(name)).cast("int") - 1
    picked = [F.get("cells", F.when(place(name) >= 0, place(name))).alias(name) for name in names]
    return cells.join(profiles.select("path", "header"), "path").select("path", "source_row", *picked)


def _workbook_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = list(workbook.sheet_rows(bytes(content)))[1:]
            yield pd.DataFrame(
                {"path": path, "source_row": [n for n, _ in rows], "cells": [c for _, c in rows]}
            )


def read_xlsx(spark: SparkSession, group: FileGroup) -> DataFrame:
    """Rows of a group of workbooks as text; a workbook is one task, blank rows are kept."""
    rows = binary_files(spark, group.paths).select("path", "content").mapInPandas(
        _workbook_rows, "path STRING, source_row LONG, cells ARRAY<STRING>"
    )
    cells = [F.get("cells", F.lit(n)).alias(name) for n, name in enumerate(group.header)]
    return rows.select("path", "source_row", *cells)


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All rows of the files as text, with ``path`` and ``source_row``."""
    frames = [
        read_csv(spark, g) if g.file_format == "csv" else read_xlsx(spark, g)
        for g in group_files(profile(spark, paths))
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@dataclass(frozen=True)
class Preview:
    columns: list[str]
    rows: DataFrame
    encoding: str | None
    sheet: str | None


def inspect(spark: SparkSession, path: str, limit: int = fixed.PREVIEW_ROWS) -> Preview:
    """Columns, first rows, encoding and sheet of one file."""
    found = profile(spark, [path]).first()
    if found.error:
        raise TabularError(found.error)
    rows = read_files(spark, [path])
    if rows.isEmpty():
        raise TabularError("the file has a header but no data rows")
    return Preview(list(found.header), rows.orderBy("source_row").limit(limit), found.encoding, found.sheet)


def alias_table(spark: SparkSession) -> DataFrame:
    """(field, alias, rank) of every known header alias."""
    rows = [
        (field, alias.casefold(), rank)
        for field, aliases in fixed.HEADER_ALIASES.items()
        for rank, alias in enumerate(aliases)
    ]
    return spark.createDataFrame(rows, "field STRING, alias STRING, alias_rank INT")


def suggest_mappings(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mapping suggestion per file from ``(file_id, position, header)`` rows.

    For each field the header with the best alias rank wins; of headers that fold to the
    same text, the last one. A full suggestion needs the time, the tag and the value, and
    decides between the long and the wide layout.
    """
    best = (
        headers.withColumn("alias", fold(F.col("header")))
        .join(aliases, "alias")
        .groupBy("file_id", "field")
        .agg(F.min_by("header", F.struct("alias_rank", -F.col("position"))).alias("header"))
    )
    wide = best.groupBy("file_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("header"))).alias(f) for f in fixed.HEADER_ALIASES]
    )
    files = headers.select("file_id").distinct()
    full = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fixed.REQUIRED_ALIAS_FIELDS])
    return files.join(wide, "file_id", "left").withColumn(
        "layout", F.when(full, "long").otherwise("wide")
    ).withColumn("suggested", full)


def duplicate_files(uploads: DataFrame, statuses: Sequence[str] = fixed.OPEN_BATCH_STATUSES) -> DataFrame:
    """Each upload with the newest earlier open batch of the same plant and digest.

    Copies of one file may be many, so the look-back runs inside days and is carried from
    day to day.
    """
    open_batch: Column = F.col("status").isin(*statuses)
    return previous_marked(
        uploads, ["plant_id", "file_sha256"], F.date_trunc("day", "created_at"),
        ["created_at", "batch_id"], F.col("batch_id"), open_batch, "duplicate_of_id",
    )
