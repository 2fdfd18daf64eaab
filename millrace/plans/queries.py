"""The registered queries: every operator over whole tables, by name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import lru_cache, reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import freshness as fresh
from millrace.functions import terms
from millrace.functions.text import canonical_row
from millrace.operators import assets, batches, evaluation, importing, integrity, lifecycle, retrieval
from millrace.operators import samples as sample_queries
from millrace.operators.transactions import COUNTS, FolderImport
from millrace.plans import workloads
from millrace.session import configure, file_stamps, fresh_folder
from millrace.sources import star_binding as star
from millrace.sources import tabular
from millrace.sources.tables import all_samples
from millrace.streaming.acquisition import LiveStore, mapped_nodes, notifications, to_samples

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ALLOWED_HOSTS = ("sim",)
ISSUE_LIMIT = 50
HISTORY_TAG = 7
SCOPE = "plant_id < 2"


def registered(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    REGISTRY[query.__name__] = run
    return query


def _longs(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.col(name).cast("long"))
    return df


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


# --- samples ---------------------------------------------------------------------------


@registered
def latest_task_values(spark, sf_dir):
    return sample_queries.latest_task_values(star.bind(spark, sf_dir))


@registered
def latest_by_rank(spark, sf_dir):
    live = sample_queries.from_source(star.samples(spark, sf_dir), "opcua")
    return sample_queries.latest_by_rank(live).select(
        "task_id", "tag_id", "id", "value", "numeric_value", "source_timestamp", "is_good"
    )


@registered
def latest_value_freshness(spark, sf_dir):
    return sample_queries.latest_values(star.bind(spark, sf_dir), "any", star.as_of())


@registered
def readable_samples(spark, sf_dir):
    return sample_queries.readable(star.bind(spark, sf_dir))


@registered
def readable_live_samples(spark, sf_dir):
    return sample_queries.readable(star.bind(spark, sf_dir), live_only=True)


@registered
def tag_history_page(spark, sf_dir):
    return sample_queries.history_pages(star.samples(spark, sf_dir), 5)


@registered
def tag_history_filtered(spark, sf_dir):
    """One tag's newest good live samples of a task within a time range, with the count of all that match."""
    start, end = dt.datetime(2024, 1, 3, tzinfo=dt.UTC), dt.datetime(2024, 1, 28, tzinfo=dt.UTC)
    found = sample_queries.history(
        star.bind(spark, sf_dir), HISTORY_TAG, task_id=HISTORY_TAG % 125 // 5, start=start, end=end, is_good=True, limit=3
    )
    return found.select("id", "task_id", "tag_id", "source_timestamp", "value", "is_good", "total_count")


@registered
def samples_of_both_sources(spark, sf_dir):
    """Live and file samples put together again as one fact table, counted by source and tag."""
    every = star.samples(spark, sf_dir)
    live, filed = (sample_queries.from_source(every, source) for source in ("opcua", "file"))
    both = all_samples(live.drop("import_batch_id"), filed.drop("task_id"))
    return both.groupBy("source_type", "tag_id").agg(
        F.count("*").alias("samples"), F.count("task_id").alias("with_task"), F.count("import_batch_id").alias("with_batch")
    )


@registered
def tag_trend_all(spark, sf_dir):
    found = sample_queries.trend(star.bind(spark, sf_dir), star.as_of(), 24, "opcua")
    return _rounded(found, "mean", "first_to_last_change").drop("window_start", "window_end")


@registered
def trend_facts(spark, sf_dir):
    found = sample_queries.trend(star.bind(spark, sf_dir), star.as_of(), 24, "opcua")
    return evaluation.trend_facts(found, "opcua")


@registered
def quality_segments(spark, sf_dir):
    return sample_queries.quality_segments(star.samples(spark, sf_dir))


@registered
def series_position(spark, sf_dir):
    found = sample_queries.series_positions(star.samples(spark, sf_dir))
    return _rounded(found, "time_position", "value_position")


@registered
def frames_to_long(spark, sf_dir):
    return sample_queries.frames_to_long(workloads.frames(spark, sf_dir))


@registered
def replay_phases(spark, sf_dir):
    """Samples by phase, on the seconds since each tag's first sample."""
    samples = star.samples(spark, sf_dir)
    first = samples.groupBy("tag_id").agg(F.min("source_timestamp").alias("t0"))
    elapsed = fresh.seconds_between(F.col("source_timestamp"), F.col("t0")) / 3600
    return samples.join(first, "tag_id").groupBy(
        "tag_id", fresh.phase_label(elapsed).alias("phase")
    ).agg(F.count("*").alias("samples"))


@registered
def task_nodes(spark, sf_dir):
    return sample_queries.task_nodes(star.bind(spark, sf_dir))


@registered
def cross_plant_tasks(spark, sf_dir):
    proposed = workloads.proposed_nodes(spark, sf_dir).select("mapping_id", "task_id", "tag_id")
    return sample_queries.cross_plant_tasks(star.bind(spark, sf_dir), proposed)


# --- assets and scope ------------------------------------------------------------------


@registered
def access_decisions(spark, sf_dir):
    return assets.access_decisions(workloads.requests(spark, sf_dir), star.bind(spark, sf_dir))


@registered
def missing_plants(spark, sf_dir):
    wanted = workloads.requests(spark, sf_dir).select("request_id", "plant_id")
    return assets.missing_plants(wanted, star.bind(spark, sf_dir))


@registered
def mapping_options(spark, sf_dir):
    return assets.mapping_options(star.bind(spark, sf_dir))


@registered
def tags_by_plant(spark, sf_dir):
    return assets.tags_by_plant(star.bind(spark, sf_dir))


@registered
def parent_names(spark, sf_dir):
    return assets.with_parent_names(star.bind(spark, sf_dir))


@registered
def scoped_samples(spark, sf_dir):
    """Samples that one user's grants admit, counted by plant and tag state."""
    t = star.bind(spark, sf_dir)
    tags = assets.in_scope(assets.hierarchy(t), assets.granted_plants(t, 3, admin=False))
    per_tag = t.tag_sample.groupBy("tag_id").agg(F.count("*").alias("n"))
    return per_tag.join(tags.select("tag_id", "plant_id", "is_enabled"), "tag_id").groupBy(
        "plant_id", "is_enabled"
    ).agg(F.sum("n").alias("samples"), F.count("*").alias("tags"))


@registered
def dashboard_by_user(spark, sf_dir):
    return assets.dashboard_by_user(star.bind(spark, sf_dir))


@registered
def asset_overview(spark, sf_dir):
    return assets.asset_overview(star.bind(spark, sf_dir), 5)


@registered
def device_facts(spark, sf_dir):
    return evaluation.device_facts(assets.asset_overview(star.bind(spark, sf_dir)))


@registered
def all_device_facts(spark, sf_dir):
    """As ``device_facts``, whose SQL keeps 30 devices a plant, with every device."""
    counts = assets.device_tag_counts(star.bind(spark, sf_dir))
    return evaluation.device_facts(counts.withColumnRenamed("tag_count", "device_tag_count"))


@registered
def find_tags(spark, sf_dir):
    return assets.find_tags(star.bind(spark, sf_dir), "1", 20)


@registered
def search_nodes(spark, sf_dir):
    return assets.search_nodes(star.bind(spark, sf_dir), "NS=2;S=CUSTOMER#00000001")


@registered
def list_page(spark, sf_dir):
    tags = assets.filter_assets(star.tags(spark, sf_dir), search="customer#0_00", data_type="float")
    return assets.page_with_total(tags, ["code", "tag_id"], 10, 25).select(
        "tag_id", "code", "name", "data_type", "total_count"
    )


@registered
def asset_lists(spark, sf_dir):
    """The lists of plants, lines and devices: active plants, the lines of two plants, the devices of some lines."""
    t = star.bind(spark, sf_dir)
    lists = {
        "plant": (assets.filter_assets(t.plant, status="active"), "plant_id", F.lit(None)),
        "line": (assets.filter_assets(t.production_line, plant_id=2), "line_id", F.col("plant_id")),
        "device": (assets.filter_assets(t.device, search="_3", line_id=4).unionByName(assets.filter_assets(t.device, line_id=7)), "device_id", F.col("line_id")),
    }
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), parent.cast("long").alias("parent_id"), "code", "name", "status")
        for kind, (df, key, parent) in lists.items()
    ])


# --- batches, tasks, delivery ----------------------------------------------------------


@registered
def batch_list(spark, sf_dir):
    return batches.newest_batches(star.bind(spark, sf_dir), 5)


@registered
def batch_inspection(spark, sf_dir):
    view, _ = batches.inspect_batches(star.bind(spark, sf_dir))
    return view


@registered
def batch_issue_examples(spark, sf_dir):
    _, examples = batches.inspect_batches(star.bind(spark, sf_dir))
    return examples


@registered
def stored_issue_summary(spark, sf_dir):
    return batches.issue_summary(star.bind(spark, sf_dir))


@registered
def issue_page(spark, sf_dir):
    return batches.issue_page(star.bind(spark, sf_dir), 1, 2, 20).select(
        "id", "batch_id", "row_number", "issue_type"
    )


@registered
def newest_jobs(spark, sf_dir):
    return batches.newest_jobs(star.bind(spark, sf_dir))


@registered
def batch_totals(spark, sf_dir):
    return batches.batch_totals(star.bind(spark, sf_dir))


@registered
def task_status(spark, sf_dir):
    return batches.task_status(star.bind(spark, sf_dir), 3)


@registered
def task_facts(spark, sf_dir):
    return evaluation.task_facts(batches.all_task_status(star.bind(spark, sf_dir)))


@registered
def fleet_totals(spark, sf_dir):
    return batches.fleet_totals(star.bind(spark, sf_dir))


@registered
def counter_differences(spark, sf_dir):
    return batches.counter_differences(star.bind(spark, sf_dir))


@registered
def documents_per_plant(spark, sf_dir):
    return batches.documents_per_plant(star.bind(spark, sf_dir))


@registered
def node_mapping_audit(spark, sf_dir):
    return batches.audit_node_mappings(workloads.proposed_nodes(spark, sf_dir), star.bind(spark, sf_dir))


@registered
def startable_tasks(spark, sf_dir):
    return batches.startable_tasks(star.bind(spark, sf_dir))


@registered
def integrity_audit(spark, sf_dir):
    return integrity.integrity_audit(star.bind(spark, sf_dir), ALLOWED_HOSTS)


@registered
def integrity_audit_damaged(spark, sf_dir):
    """The same audit of tables in which every rule is broken somewhere."""
    return integrity.integrity_audit(workloads.damaged_tables(star.bind(spark, sf_dir)), ALLOWED_HOSTS)


@registered
def delivery_audit(spark, sf_dir):
    t = star.bind(spark, sf_dir)
    nodes = t.acquisition_node.where("is_enabled").groupBy("task_id").agg(F.count("*").alias("node_count"))
    polls = workloads.snapshots(spark, t.tag_sample)
    return batches.delivery_audit(polls, nodes, interval_ms=360_000_000, poll_seconds=5)


@registered
def state_histogram(spark, sf_dir):
    return batches.state_histogram(workloads.snapshots(spark, star.samples(spark, sf_dir)))


@registered
def state_reconcile(spark, sf_dir):
    """Desired tasks against the tasks whose newest event shows activity."""
    t = star.bind(spark, sf_dir)
    events = workloads.state_events(spark, sf_dir)
    newest = events.groupBy("task_id").agg(
        F.max_by("state", F.struct("reported_at", "seq")).alias("state")
    )
    owned = newest.where(F.col("state").isin("connected", "connecting", "reconnecting"))
    return batches.reconcile_states(
        t.acquisition_task.select("task_id", "desired_state", "connection_state"), owned
    )


@registered
def state_guard(spark, sf_dir):
    t = star.bind(spark, sf_dir)
    return batches.guarded_states(workloads.state_events(spark, sf_dir), t.acquisition_task)


# --- import ----------------------------------------------------------------------------


def _classified(spark, sf_dir):
    t = star.bind(spark, sf_dir)
    raw = workloads.raw_long(spark, sf_dir)
    return importing.classify(raw, workloads.LONG_MAPPING, t, importing.existing_keys(t.tag_sample))


@registered
def import_classified(spark, sf_dir):
    return _longs(
        _classified(spark, sf_dir).select(
            "batch_id", "source_row", "position", "tag_id", "source_timestamp", "value",
            "numeric_value", "status_code", "is_good", "rule", "issue_type",
        ),
        "position",
    )


@registered
def import_accepted(spark, sf_dir):
    return importing.accepted_samples(_classified(spark, sf_dir), star.as_of()).select(
        "import_batch_id", "tag_id", "value", "numeric_value", "source_timestamp", "status_code", "is_good"
    )


@registered
def import_counters(spark, sf_dir):
    classified = _classified(spark, sf_dir)
    found = importing.issues(classified, workloads.LONG_MAPPING)
    return importing.counters(classified, found, ISSUE_LIMIT)


@registered
def import_issues(spark, sf_dir):
    found = importing.issues(_classified(spark, sf_dir), workloads.LONG_MAPPING)
    return _longs(importing.stored_issues(found, ISSUE_LIMIT), "issue_number", "emit_order")


@registered
def all_import_counters(spark, sf_dir):
    """As ``import_counters``, whose SQL keeps 50 issues a batch, with every issue stored."""
    classified = _classified(spark, sf_dir)
    return importing.counters(classified, importing.issues(classified, workloads.LONG_MAPPING))


@registered
def all_import_issues(spark, sf_dir):
    """As ``import_issues``, whose SQL keeps 50 issues a batch, with every issue stored."""
    found = importing.issues(_classified(spark, sf_dir), workloads.LONG_MAPPING)
    return _longs(importing.stored_issues(found), "issue_number", "emit_order")


@registered
def import_issue_summary(spark, sf_dir):
    found = importing.issues(_classified(spark, sf_dir), workloads.LONG_MAPPING)
    return importing.issue_summary(found)


@registered
def import_wide(spark, sf_dir):
    t = star.bind(spark, sf_dir)
    raw = workloads.raw_wide(spark, sf_dir)
    classified = importing.classify(
        raw, workloads.WIDE_MAPPING, t, importing.existing_keys(t.tag_sample)
    )
    return classified.groupBy("batch_id", "value_field", "rule").agg(
        F.count("*").alias("measurements"), F.round(F.sum("numeric_value"), 2).alias("total")
    )


@registered
def field_mapping_rows(spark, sf_dir):
    every = star.batches(spark, sf_dir)
    return importing.field_mapping_rows(every, workloads.LONG_MAPPING).unionByName(
        importing.field_mapping_rows(every, workloads.WIDE_MAPPING)
    )


@registered
def import_from_files(spark, sf_dir):
    """The whole path through files: write CSV, profile, read, number, import, publish."""
    folder = fresh_folder(spark, "import-files")
    raw = workloads.raw_long(spark, sf_dir)
    raw.select("plant_id", *workloads.RAW_COLUMNS).write.option("header", True).partitionBy("plant_id").csv(folder)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.csv"
    ).load(folder)
    paths = [r.path for r in listing.select("path").collect()]
    rows = tabular.read_files(spark, paths)
    named = rows.withColumn(
        "plant_id", F.regexp_extract("path", "plant_id=([0-9]+)", 1).cast("long")
    ).withColumn("batch_id", F.xxhash64("path"))
    t = star.bind(spark, sf_dir)
    result = importing.process(
        spark, named, workloads.LONG_MAPPING, t, fresh_folder(spark, "import-samples"), star.as_of()
    )
    plant = named.select("batch_id", "plant_id").distinct()
    stored = result.samples.groupBy(F.col("import_batch_id").alias("batch_id")).agg(
        F.count("*").alias("published_rows")
    )
    counts = ("total_rows", "accepted_rows", "rejected_rows", "duplicate_rows", "warning_rows", "issue_count")
    return (
        result.counters.join(plant, "batch_id")
        .join(stored, "batch_id", "left")
        .groupBy("plant_id")
        .agg(*[F.sum(c).alias(c) for c in (*counts, "published_rows")])
    )


@registered
def import_file_batches(spark, sf_dir):
    """A folder of files in five forms, with broken ones among them: each file is a batch of its own."""
    folder = fresh_folder(spark, "mixed-files")
    workloads.write_mixed_files(spark, sf_dir, folder)
    plant = F.when(F.col("path").contains("/good/"), F.regexp_extract("path", "plant_id=([0-9]+)", 1).cast("long"))
    store = FolderImport(spark, fresh_folder(spark, "folder-import"))
    store.run(1, folder, workloads.LONG_MAPPING, star.bind(spark, sf_dir), plant, star.as_of())
    visible = store.samples().groupBy(F.col("import_batch_id").alias("batch_id")).agg(F.count("*").alias("visible"))
    rows = store.batches().join(visible, "batch_id", "left").na.fill(0, ["visible"])
    return rows.groupBy("plant_id", "status", "error_message").agg(
        F.count("*").alias("files"), *[F.sum(c).alias(c) for c in (*COUNTS, "published_rows")], F.sum("visible").alias("visible_rows")
    )


@registered
def duplicate_files(spark, sf_dir):
    return tabular.duplicate_files(workloads.uploads(spark, sf_dir)).select(
        "batch_id", "plant_id", "status", "duplicate_of_id"
    )


@registered
def source_files_available(spark, sf_dir):
    """Uploads whose stored file is still listed."""
    uploads = workloads.uploads(spark, sf_dir).withColumn("storage_key", F.concat(F.lit("page-"), F.col("batch_id") % 3000))
    listing, _ = workloads.recorded_pages(spark, sf_dir)
    return tabular.with_source_file(uploads, listing).select("batch_id", "storage_key", "source_file_available")


@registered
def header_suggestions(spark, sf_dir):
    return tabular.suggest_mappings(workloads.file_headers(spark, sf_dir), tabular.alias_table(spark))


@registered
def changed_files(spark, sf_dir):
    return tabular.changed_files(*workloads.recorded_pages(spark, sf_dir)).select("path")


# --- lifecycle -------------------------------------------------------------------------


@registered
def retention_preview(spark, sf_dir):
    found = lifecycle.retention_preview(star.bind(spark, sf_dir), star.as_of(), 7)
    return _longs(found, "keep_days")


@registered
def capacity_estimate(spark, sf_dir):
    return lifecycle.capacity_estimate(spark, f"{sf_dir}/events.parquet", star.samples(spark, sf_dir))


@registered
def scoped_subset_counts(spark, sf_dir):
    t = star.bind(spark, sf_dir)
    return lifecycle.subset_counts(t, t.plant.where(SCOPE))


@registered
def cross_scope_refs(spark, sf_dir):
    t = star.bind(spark, sf_dir)
    return lifecycle.cross_scope_references(t, t.plant.where(SCOPE))


@registered
def table_fingerprint(spark, sf_dir):
    return lifecycle.fingerprints(star.bind(spark, sf_dir).as_dict())


@registered
def archive_restore_check(spark, sf_dir):
    """Tables that differ after a subset is taken out and put back: none."""
    t = star.bind(spark, sf_dir)
    inside, outside = lifecycle.split_scope(t, t.plant.where(SCOPE))
    before = lifecycle.fingerprints({n: t.as_dict()[n] for n in inside})
    return lifecycle.changed_tables(before, lifecycle.fingerprints(lifecycle.restore_scope(outside, inside)))


@registered
def restored_digests(spark, sf_dir):
    """Digests of every table after a subset is taken out and put back, beside those before and of a damaged copy."""
    t = star.bind(spark, sf_dir)
    columns = {name: tuple(kinds) for name, kinds in workloads.DIGESTED.items()}
    inside, outside = lifecycle.split_scope(t, t.plant.where(SCOPE))
    states = {
        "before": t.as_dict(), "restored": lifecycle.restore_scope(outside, inside), "damaged": workloads.damaged_tables(t).as_dict(),
        "inside": inside,
    }
    return reduce(DataFrame.unionByName, [
        lifecycle.digests(tables, columns if state != "inside" else {"tag": columns["tag"]}).select(F.lit(state).alias("state"), "*")
        for state, tables in states.items()
    ])


@registered
def changed_table_check(spark, sf_dir):
    """Tables whose fingerprints tell a damaged copy from the original."""
    t = star.bind(spark, sf_dir)
    damaged = workloads.damaged_tables(t).as_dict()
    return lifecycle.changed_tables(lifecycle.fingerprints(t.as_dict()), lifecycle.fingerprints(damaged))


@registered
def canonical_rows(spark, sf_dir):
    tags = star.tags(spark, sf_dir)
    return tags.select("tag_id", canonical_row("tag_id", "code", "is_enabled", "max_value").alias("row_text"))


# --- retrieval -------------------------------------------------------------------------


@registered
def chunk_documents(spark, sf_dir):
    found = retrieval.chunks(star.documents(spark, sf_dir).drop("vector"))
    return _longs(found, "chunk_index", "start", "end").select(
        "document_id", "plant_id", "chunk_index", "start", "end", "text", "evidence_id"
    )


@registered
def document_frequencies(spark, sf_dir):
    return retrieval.document_frequency(_chunk_index(spark, sf_dir))


@lru_cache(maxsize=16)
def _index_path(application: str, sf_dir: str, stamp: tuple) -> str:
    """Where the chunk index of a corpus lies: built once per application, and again if a source file changes."""
    spark = SparkSession.getActiveSession()
    path = fresh_folder(spark, "chunk-index")
    documents = star.documents(spark, sf_dir).select("document_id", "plant_id", "title", "version", "content", "vector")
    # Chunks overlap and share the vector of their document: zstd finds these repeats, the default does not.
    retrieval.indexed(documents).write.option("compression", "zstd").parquet(path)
    return path


def _chunk_index(spark, sf_dir):
    stamp = file_stamps(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet")
    return spark.read.parquet(_index_path(spark.sparkContext.applicationId, sf_dir, stamp))


def _retrieved(spark, sf_dir, strategy):
    found = retrieval.retrieve_from(_chunk_index(spark, sf_dir), star.questions(spark, sf_dir), strategy)
    return _longs(found, "start", "end")


@registered
def bm25_top5(spark, sf_dir):
    return _retrieved(spark, sf_dir, "lexical")


@registered
def vector_top5(spark, sf_dir):
    return _retrieved(spark, sf_dir, "vector")


@registered
def hybrid_top5(spark, sf_dir):
    return _retrieved(spark, sf_dir, "auto")


@registered
def evidence_payload(spark, sf_dir):
    """Stored evidence of questions whose vectors are compared with documents of the same model only."""
    asked = workloads.distant_questions(spark, sf_dir, star.questions(spark, sf_dir))
    found = retrieval.evidence_payload(
        workloads.dated_vectors(_chunk_index(spark, sf_dir)), star.documents(spark, sf_dir), asked,
        model=workloads.EMBEDDING_MODEL,
    )
    return _longs(found, "start", "end", "version")


@registered
def embedding_similarity(spark, sf_dir):
    """Cosine of every document's vector with the vector of its plant's first document."""
    docs = star.documents(spark, sf_dir).where(F.col("vector").isNotNull()).select(
        "document_id", "plant_id", "vector"
    )
    first = docs.groupBy("plant_id").agg(F.min_by("vector", "document_id").alias("base"))
    return docs.join(first, "plant_id").select(
        "document_id", F.round(terms.cosine(F.col("vector"), F.col("base")), 6).alias("similarity")
    )


@registered
def document_versions(spark, sf_dir):
    current = star.documents(spark, sf_dir)
    return _longs(
        retrieval.upsert_documents(current, workloads.incoming_documents(spark, sf_dir)), "version"
    )


@registered
def document_store(spark, sf_dir):
    """The table after an upsert, written and read back, with its chunks and the conflicts that writers are told."""
    after, conflicts = retrieval.store_documents(
        star.documents(spark, sf_dir), workloads.incoming_documents(spark, sf_dir), fresh_folder(spark, "documents")
    )
    chunked = retrieval.chunks(after.drop("vector")).groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    rows = after.select(
        "document_id", "plant_id", "title", "version", "content_sha256", F.length("content").alias("characters"),
        F.col("vector").isNotNull().alias("has_vector"),
    )
    found = rows.join(chunked, "document_id", "left").na.fill(0, ["chunk_count"]).join(conflicts, "document_id", "left")
    return _longs(found, "version", "characters", "expected_version", "current_version")


@registered
def seed_documents(spark, sf_dir):
    seeds = workloads.incoming_documents(spark, sf_dir)
    return retrieval.seed_documents(star.documents(spark, sf_dir), seeds).select("document_id", "title")


@registered
def retrieval_metrics(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir), "recall", "reciprocal_rank")


def _metrics(spark, sf_dir):
    questions = star.questions(spark, sf_dir)
    evidence = _retrieved(spark, sf_dir, "auto")
    good = star.given(spark, sf_dir, "labels").where("quality = 1").select(
        F.col("doc_id").alias("document_id")
    )
    titles = star.documents(spark, sf_dir).select("document_id", "title").join(good, "document_id", "left_semi")
    required = titles.withColumnRenamed("document_id", "query_id").join(
        questions.select("query_id"), "query_id", "left_semi"
    )
    return evaluation.retrieval_metrics(questions, evidence, required)


@registered
def retrieval_metrics_summary(spark, sf_dir):
    found = evaluation.metrics_summary(_metrics(spark, sf_dir))
    return _rounded(found, "mean_recall", "all_sources_rate", "mean_reciprocal_rank", "hit_rate")


# --- questions and answers -------------------------------------------------------------


@registered
def latency_percentiles(spark, sf_dir):
    runs = star.given(spark, sf_dir, "events").select(
        F.col("event_type").alias("mode"), F.col("value").alias("elapsed_ms")
    )
    return _rounded(evaluation.latency_percentiles(runs, ["mode"], "elapsed_ms"), "median")


@registered
def run_quota(spark, sf_dir):
    return evaluation.run_quota(star.runs(spark, sf_dir), star.as_of(), 3)


@registered
def question_windows(spark, sf_dir):
    asked = workloads.asked_questions(spark, sf_dir)
    ruled = evaluation.question_rules(asked, requested="requested_hours")
    return ruled.withColumn("hours", F.array_join("hours", ",")).drop("question", "requested_hours")


@registered
def answer_audit(spark, sf_dir):
    audited = evaluation.answer_audit(workloads.given_answers(spark, sf_dir))
    return audited.select("answer_id", "ambiguous", "problem", "final_status")


@registered
def citation_audit(spark, sf_dir):
    audited = evaluation.citation_audit(workloads.given_answers(spark, sf_dir))
    return audited.select(
        "answer_id", F.size("unknown_citations").cast("long").alias("unknown_count"), "citations_valid"
    )


@registered
def stale_evidence(spark, sf_dir):
    return _longs(
        evaluation.stale_evidence(
            workloads.evidence_rows(spark, sf_dir), star.documents(spark, sf_dir)
        ),
        "version", "current_version",
    )


@registered
def stale_evidence_found(spark, sf_dir):
    """Evidence of answers that cited an edition before the current one."""
    cited = workloads.evidence_rows(spark, sf_dir).withColumn(
        "version", F.greatest(F.lit(1), F.col("version") - (F.col("answer_id") % 2).cast("int"))
    )
    return _longs(evaluation.stale_evidence(cited, star.documents(spark, sf_dir)), "version", "current_version")


@registered
def last_snapshots(spark, sf_dir):
    return _longs(evaluation.last_snapshots(workloads.evidence_rows(spark, sf_dir)), "version")


@registered
def structure_scores(spark, sf_dir):
    scored = evaluation.structure_scores(workloads.answer_cases(spark, sf_dir))
    return scored.select(
        "case_id", "status_allowed", "required_calls_in_order", "forbidden_calls_absent",
        "no_call_errors", "citations_valid", "required_documents_cited", "reference_terms_present",
        "canaries_absent", "structural_pass",
    )


# --- streaming -------------------------------------------------------------------------


def _streamed(spark, sf_dir):
    """Run all notifications through the stream, until everything is stored."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    nodes = mapped_nodes(star.nodes(spark, sf_dir), star.tasks(spark, sf_dir))
    store = LiveStore(spark, fresh_folder(spark, "live"))
    store.start(to_samples(workloads.notifications(spark, sf_dir, events), nodes)).awaitTermination()
    return store


SLOTS = 4


def _streamed_in_slots(spark, sf_dir):
    """The same notifications in four arrivals: repeats land in another one, and the stream restarts for each."""
    inbox, store = fresh_folder(spark, "inbox"), LiveStore(spark, fresh_folder(spark, "live"), merge_above=2)
    nodes = mapped_nodes(star.nodes(spark, sf_dir), star.tasks(spark, sf_dir))
    arriving = workloads.notifications(spark, sf_dir).withColumn("slot", workloads.arrival_slot(SLOTS))
    for slot in range(SLOTS):
        arriving.where(F.col("slot") == slot).drop("slot").write.mode("append").parquet(inbox)
        stream = notifications(spark, inbox, files_per_batch=10_000)
        store.start(to_samples(stream, nodes)).awaitTermination()
    return store


@registered
def stream_over_batches(spark, sf_dir):
    """Running counters after several micro-batches, and which notification of each key was first."""
    store = _streamed_in_slots(spark, sf_dir)
    kept = store.samples().groupBy("task_id").agg(
        F.count("*").alias("stored_samples"), F.sum("seq").alias("seq_total"), F.count_distinct("tag_id").alias("tags")
    )
    return store.counters().join(kept, "task_id", "left")


@registered
def stream_dedup_counters(spark, sf_dir):
    return _streamed(spark, sf_dir).counters().drop("heartbeat_at")


@registered
def stream_stored_samples(spark, sf_dir):
    """The samples that the stream keeps, per tag."""
    return _streamed(spark, sf_dir).samples().groupBy("task_id", "tag_id").agg(
        F.count("*").alias("samples"), F.max("source_timestamp").alias("newest"),
        F.round(F.sum("numeric_value"), 2).alias("total"),
    )
