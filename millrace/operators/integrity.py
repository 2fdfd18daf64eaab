"""Integrity audit: uniqueness, references, ranges and formats of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions.text import is_code
from millrace.sources.tables import Tables


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row. Rows with a null in the key do not conflict."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set but leads nowhere."""
    return child.where(F.col(column).isNotNull()).join(
        parent.select(F.col(key).alias(column)), column, "left_anti"
    )


def within(name: str, bounds: tuple[int, int]) -> Column:
    return F.coalesce(F.col(name).between(*bounds), F.lit(False))


def endpoint_problem(url: Column, hosts: Sequence[str]) -> Column:
    """Why an endpoint URL is refused, null when it is acceptable."""
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^@/]*)@)?([^:/@]+)(?::(\d+))?(?:/.*)?$"
    text = F.btrim(url)
    scheme, login, host, port = (F.regexp_extract(text, shape, n) for n in (1, 2, 3, 4))
    return (
        F.when((F.lower(scheme) != fixed.ENDPOINT_SCHEME) | (host == "") | (port == ""), "bad_shape")
        .when(login != "", "credentials")
        .when(~F.lower(host).isin(*hosts), "host_not_allowed")
    )


@dataclass(frozen=True)
class Unique:
    """No two rows of a table share these columns; ``where`` limits the rule to some rows."""

    table: str
    keys: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class Reference:
    """A set value of ``column`` is a key of ``parent``."""

    table: str
    column: str
    parent: str
    key: str


@dataclass(frozen=True)
class Check:
    """Rows for which ``hit`` holds break the rule."""

    table: str
    hit: Column


Rule = Unique | Reference | Check


def audit(tables: dict[str, DataFrame], rules: dict[str, Rule]) -> DataFrame:
    """(``rule``, ``violations``) of every rule, in at most two passes over a table.

    One pass emits a row for each broken check and each set reference, and counts them by value before any
    shuffle; the values are then held against all parents' keys in one anti join. The other emits each row's
    unique keys and counts those that several rows hold.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, df in tables.items():
        mine = {rule: r for rule, r in rules.items() if r.table == name}
        looked_up = {rule: r for rule, r in mine.items() if not isinstance(r, Unique)}
        if looked_up:
            parts.append(_values(df, looked_up))
        unique = {rule: r for rule, r in mine.items() if isinstance(r, Unique)}
        if unique:
            parts.append(_repeated(df, unique))
    found = reduce(DataFrame.unionByName, parts)
    sources = {(r.parent, r.key) for r in rules.values() if isinstance(r, Reference)}
    if sources:
        keys = reduce(DataFrame.unionByName, [
            tables[parent].select(F.lit(f"{parent}.{key}").alias("parent"), F.col(key).cast("string").alias("value"))
            for parent, key in sorted(sources)
        ])
        # Rows of other kinds have no parent, and so always stay.
        found = found.join(keys, ["parent", "value"], "left_anti")
    counted = found.groupBy("rule").agg(F.sum("n").alias("n"))
    names = spark.createDataFrame([(rule,) for rule in rules], "rule string")
    return names.join(counted, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


def _values(df: DataFrame, rules: dict[str, Reference | Check]) -> DataFrame:
    """(``rule``, ``parent``, ``value``, ``n``): references by value, and broken checks without a parent."""
    emitted = []
    for rule, r in rules.items():
        if isinstance(r, Reference):
            value, parent = F.col(r.column).cast("string"), F.lit(f"{r.parent}.{r.key}")
            shown = F.col(r.column).isNotNull()
        else:
            value, parent = F.lit(None).cast("string"), F.lit(None).cast("string")
            shown = F.coalesce(r.hit, F.lit(False))
        emitted.append(F.when(shown, F.struct(F.lit(rule).alias("rule"), parent.alias("parent"), value.alias("value"))))
    rows = df.select(F.explode(F.array_compact(F.array(*emitted))).alias("v")).select("v.*")
    return rows.groupBy("rule", "parent", "value").agg(F.count("*").alias("n"))


def _repeated(df: DataFrame, rules: dict[str, Unique]) -> DataFrame:
    """The number of key values that more than one row holds; keys with a null do not conflict."""
    columns = sorted({k for r in rules.values() for k in r.keys})
    kinds = dict(df.dtypes)
    emitted = []
    for rule, r in rules.items():
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in r.keys], F.expr(r.where))
        cells = [(F.col(c) if c in r.keys else F.lit(None).cast(kinds[c])).alias(c) for c in columns]
        emitted.append(F.when(whole, F.struct(F.lit(rule).alias("rule"), *cells)))
    rows = df.select(F.explode(F.array_compact(F.array(*emitted))).alias("k")).select("k.*")
    groups = rows.groupBy("rule", *columns).agg(F.count("*").alias("copies")).where("copies > 1")
    none = F.lit(None).cast("string")
    return groups.groupBy("rule").agg(F.count("*").alias("n")).select("rule", none.alias("parent"), none.alias("value"), "n")


def stored_rules(hosts: Sequence[str]) -> dict[str, Rule]:
    """The rules of the stored tables."""
    col = F.col
    one_source = F.when(
        col("source_type") == "opcua", col("task_id").isNotNull() & col("import_batch_id").isNull()
    ).otherwise(col("task_id").isNull() & col("import_batch_id").isNotNull())
    return {
        "plant_code_unique": Unique("plant", ("code",)),
        "line_code_unique": Unique("production_line", ("plant_id", "code")),
        "device_code_unique": Unique("device", ("line_id", "code")),
        "tag_code_unique": Unique("tag", ("device_id", "code")),
        "node_tag_unique": Unique("acquisition_node", ("tag_id",)),
        "node_id_unique": Unique("acquisition_node", ("task_id", "node_id")),
        "live_sample_unique": Unique("tag_sample", ("task_id", "tag_id", "source_timestamp"), "source_type = 'opcua'"),
        "file_sample_unique": Unique("tag_sample", ("tag_id", "source_timestamp"), "source_type = 'file'"),
        "line_plant": Reference("production_line", "plant_id", "plant", "plant_id"),
        "device_line": Reference("device", "line_id", "production_line", "line_id"),
        "tag_device": Reference("tag", "device_id", "device", "device_id"),
        "node_tag": Reference("acquisition_node", "tag_id", "tag", "tag_id"),
        "node_task": Reference("acquisition_node", "task_id", "acquisition_task", "task_id"),
        "sample_tag": Reference("tag_sample", "tag_id", "tag", "tag_id"),
        "sample_task": Reference("tag_sample", "task_id", "acquisition_task", "task_id"),
        "sample_batch": Reference("tag_sample", "import_batch_id", "import_batch", "batch_id"),
        "issue_batch": Reference("data_quality_issue", "batch_id", "import_batch", "batch_id"),
        "grant_plant": Reference("user_plant_access", "plant_id", "plant", "plant_id"),
        "tag_range": Check("tag", F.expr("min_value > max_value")),
        "sample_source": Check("tag_sample", ~one_source),
        "tag_code_format": Check("tag", ~is_code(col("code"))),
        "tag_sampling_interval": Check("tag", ~within("sampling_interval_ms", fixed.SAMPLING_INTERVAL_MS)),
        "task_publishing_interval": Check("acquisition_task", ~within("publishing_interval_ms", fixed.PUBLISHING_INTERVAL_MS)),
        "task_batch_size": Check("acquisition_task", ~within("batch_size", fixed.FLUSH_ROWS)),
        "task_first_delay": Check("acquisition_task", ~within("reconnect_delay_seconds", fixed.FIRST_DELAY_SECONDS)),
        "task_last_delay": Check("acquisition_task", ~within("max_reconnect_delay_seconds", fixed.LAST_DELAY_SECONDS)),
        "task_delay_order": Check("acquisition_task", F.expr("reconnect_delay_seconds > max_reconnect_delay_seconds")),
        "task_node_count": Check("task_nodes", ~within("node_count", fixed.NODES_PER_TASK)),
        "task_endpoint": Check("acquisition_task", endpoint_problem(col("endpoint_url"), hosts).isNotNull()),
        "document_title_length": Check("knowledge_document", ~F.length("title").between(*fixed.TITLE_CHARACTERS)),
        "document_content_length": Check("knowledge_document", ~F.length("content").between(*fixed.CONTENT_CHARACTERS)),
    }


def integrity_audit(t: Tables, hosts: Sequence[str]) -> DataFrame:
    """One row per rule with the number of violating keys or rows; the fact table is read twice."""
    rules = stored_rules(hosts)
    needed = {r.table for r in rules.values()} | {r.parent for r in rules.values() if isinstance(r, Reference)}
    tables = {name: df for name, df in t.as_dict().items() if name in needed}
    tables["task_nodes"] = t.acquisition_node.groupBy("task_id").agg(F.count("*").alias("node_count"))
    return audit(tables, rules)
