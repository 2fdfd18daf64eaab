"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options that results or plans depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # GB18030 files need the full set of Java charsets.
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    ship_package(spark)
    return spark


# Static options for a session of one's own. Without call-site capture for every
# expression, plans build several times faster.
SESSION_OPTIONS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
}

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables, as named by the cluster.

    A local temporary folder stands in only where all executors are on this machine, as in unit
    tests; elsewhere a missing setting is an error, since executors would not see each other's files.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(CHECKPOINT_KEY, named)
    return qualified(spark, named.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the default file system, so that Python tasks and Spark read the same place."""
    if ":" in path.split("/", 1)[0]:
        return path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so that several uses share one computation, and survives the loss of
    executors. The result is columnar: later reads still prune columns and push filters.
    """
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def file_stamps(spark: SparkSession, *paths: str) -> tuple:
    """Length and modification time of files or folders: changed content changes them."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        found.append((files.getContentSummary(place).getLength(), files.getFileStatus(place).getModificationTime()))
    return tuple(found)


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """A partitioned Parquet table, or ``None`` while nothing has been written to it."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
