"""Shared helpers: tables, words, free column names, and files in the shared folder."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import configure

# The six white-space characters that separate words, as a Java and Python pattern class.
SPACES = r"[\x20\x09-\x0D]"
SPACE_CHARACTERS = " \t\n\x0b\x0c\r"

# Rows per Arrow batch: texts can be very long, so that few of them travel at once.
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on; batches to Python workers stay small."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_words(text: str | None) -> list[bytes]:
    """Words between the six white-space characters; ``bytes.split`` knows exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_SEPARATE = bytes.maketrans(bytes(range(33, 48)) + b":;<=>?@[\\]^_`{|}~", b" " * 32)


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(_SEPARATE).split() if text else []


def words(text: Column) -> Column:
    """The same words as an array column; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARACTERS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES + "+"))


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, or the first of ``wanted_2``, ``wanted_3``... that no column has."""
    used = {name.lower() for name in taken}
    name, number = wanted, 1
    while name.lower() in used:
        number += 1
        name = f"{wanted}_{number}"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, even if it holds dots or back-quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def files_at(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of a folder or file that all executors share.

    Local paths and any scheme that pyarrow opens (file, hdfs, s3, gs, abfs) work.
    """
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def publish(folder: str, name: str, attempt: str, write) -> str:
    """Write a file under a name of the attempt, then move it to its final name.

    A task that runs again, or twice at once, replaces the file by an equal one; readers never
    see a part of it. ``write`` gets the open output stream.
    """
    fs, root = files_at(folder)
    fs.create_dir(root, recursive=True)
    draft, final = f"{root}/.{name}.{attempt}", f"{root}/{name}"
    with fs.open_output_stream(draft) as out:
        write(out)
    fs.move(draft, final)
    return f"{folder}/{name}"
