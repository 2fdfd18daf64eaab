"""Batch retrieval: chunks, BM25, exact cosine, rank fusion, for many questions at once.

Statistics are per plant. The tokenised chunks are staged once as a columnar index that
streams past blocks of questions (:mod:`millrace.operators.scoring`): a task returns the best chunks of
each question only. Rankings are followed as far as the selection needs. Fusing two rankings stops by
the threshold algorithm: once no chunk beyond both depths can enter; what one list lacks of the other is
counted for the few rows in question, so that no list of candidates is ever ranked as a whole.
:func:`scores_by_posting` and :func:`scores_by_candidate` give the scores of all pairs where these are wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import fixed_values as fixed
from millrace.functions import terms
from millrace.functions.text import let
from millrace.operators import scoring
from millrace.operators.running import SALTS, bounded_broadcast
from millrace.session import staged

VECTOR_BLOCK = 1_024
# Terms of all questions that are broadcast: about 100 bytes each.
BROADCAST_TERMS = 200_000
BLOCK_QUESTIONS = 2_000
# Tasks for each core that build a chunk index.
INDEX_PARTS = 4
# How far both rankings are followed at first; four times as far for questions that need more.
FIRST_DEPTH = 128
# Blocks of question vectors that are broadcast: 8 MB each at 1,024 dimensions.
BROADCAST_BLOCKS = 16


def chunks(documents: DataFrame) -> DataFrame:
    """One row per chunk with absolute offsets and the evidence id."""
    exploded = documents.select(
        *[c for c in documents.columns if c != "content"],
        F.explode(terms.chunk_array(F.col("content"))).alias("c"),
    )
    return exploded.select(
        *[c for c in documents.columns if c != "content"],
        F.col("c.index").alias("chunk_index"), F.col("c.start").alias("start"),
        F.col("c.end").alias("end"), F.col("c.text").alias("text"),
        terms.evidence_id(F.col("document_id"), F.col("version"), F.col("c.index")).alias("evidence_id"),
    )


def bags(chunked: DataFrame) -> DataFrame:
    """Chunks with their bag of words over title and text, and its length."""
    words = terms.token_array(F.concat_ws(" ", "title", "text"))
    return (
        chunked.withColumn("_tokens", words)
        .withColumn("bag", terms.token_counts(F.col("_tokens")))
        .withColumn("length", F.size("_tokens"))
        .drop("_tokens")
    )


def indexed(documents: DataFrame) -> DataFrame:
    """The rows of a chunk index, to be written to any place.

    Cutting and counting words costs far more than reading: documents are dealt out in small parts, as the few
    partitions of a join before, sized by bytes, leave cores idle.
    """
    parts = INDEX_PARTS * documents.sparkSession.sparkContext.defaultParallelism
    return bags(chunks(documents.repartition(parts)))


def index(documents: DataFrame) -> DataFrame:
    """The chunk index of a corpus, staged in the shared folder."""
    return staged(indexed(documents), "chunk-index")


def plant_statistics(bagged: DataFrame) -> DataFrame:
    """Chunks and average chunk length per plant."""
    return bagged.groupBy("plant_id").agg(
        F.count("*").alias("chunk_count"), F.avg("length").alias("average_length")
    )


def document_frequency(bagged: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Chunks per (plant, term), for all terms or the wanted ones."""
    postings = bagged.select("plant_id", F.explode("bag.term").alias("term"))
    if wanted is not None:
        postings = postings.join(
            bounded_broadcast(wanted, BROADCAST_TERMS), ["plant_id", "term"], "left_semi"
        )
    return postings.groupBy("plant_id", "term").agg(F.count("*").alias("frequency"))


def weighted_terms(queries: DataFrame, bagged: DataFrame) -> DataFrame:
    """Question terms found in the plant: count in the question, weight, selectivity.

    Terms are ranked from rare to common. A term is ``selective`` unless it and all more
    common ones together stay below the lexical gate. Terms that no chunk has count as
    well: they cannot match, so they only lower what the others can reach.
    """
    bag = queries.select(
        "query_id", "plant_id", terms.token_array(F.col("query")).alias("_tokens")
    ).withColumn("query_length", F.size("_tokens"))
    exploded = bag.where("query_length > 0").select(
        "query_id", "plant_id", "query_length",
        F.explode(terms.token_counts(F.col("_tokens"))).alias("t"),
    ).select("query_id", "plant_id", "query_length", "t.term", F.col("t.tf").alias("query_tf"))
    wanted = exploded.select("plant_id", "term").distinct()
    frequency = document_frequency(bagged, wanted)
    known = exploded.join(frequency, ["plant_id", "term"]).join(
        plant_statistics(bagged), "plant_id"
    )
    # A question's terms are few, so ranking them inside the question is a small sort.
    common_first = W.partitionBy("query_id").orderBy(F.col("frequency").desc(), "term").rowsBetween(
        W.unboundedPreceding, 0
    )
    reach = F.sum("query_tf").over(common_first) / F.col("query_length")
    return known.withColumn("selective", reach >= fixed.LEXICAL_GATE).withColumn(
        "weight", terms.inverse_frequency(F.col("chunk_count"), F.col("frequency"))
    )


def _similarities(batches: Iterator[pd.DataFrame], gate: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            left, right = np.stack(row.query_vectors), np.stack(row.chunk_vectors)
            # One unit matrix product per pair of blocks; only passing pairs are emitted.
            found = (left / np.linalg.norm(left, axis=1, keepdims=True)) @ (
                right / np.linalg.norm(right, axis=1, keepdims=True)
            ).T
            q, c = np.nonzero(np.round(found, 4) >= gate)
            yield pd.DataFrame(
                {
                    "query_id": np.asarray(row.query_ids)[q],
                    "evidence_id": np.asarray(row.evidence_ids, dtype=object)[c],
                    "document_id": np.asarray(row.document_ids)[c],
                    "semantic": found[q, c],
                }
            )


def semantic_pairs(queries: DataFrame, chunked: DataFrame, gate: float = fixed.SEMANTIC_GATE) -> DataFrame:
    """Pairs of question and chunk of one plant whose cosine, at four digits, reaches the gate.

    ``semantic`` is the whole cosine, so that the caller can also hold it against the gate itself.

    Both sides are packed into blocks of vectors. A task multiplies two blocks, so a plant
    with most of the chunks is many blocks, and pairs below the gate never leave the task.
    """
    def blocks(df: DataFrame, key: str, **packed: str) -> DataFrame:
        usable = df.where(terms.valid_vector(F.col("vector"))).withColumn("_width", F.size("vector"))
        # The number of blocks follows the number of rows, so that blocks keep their size.
        sizes = usable.groupBy("plant_id", "_width").agg(F.count("*").alias("_n"))
        names = list(packed.values())
        return (
            usable.join(sizes, ["plant_id", "_width"])
            .withColumn("_block", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / VECTOR_BLOCK)))
            .groupBy("plant_id", "_width", "_block")
            .agg(F.collect_list(F.struct(*names)).alias("_rows"))
            .select("plant_id", "_width", *[F.col(f"_rows.{c}").alias(a) for a, c in packed.items()])
        )

    left = blocks(queries, "query_id", query_ids="query_id", query_vectors="vector")
    right = blocks(
        chunked, "evidence_id",
        evidence_ids="evidence_id", document_ids="document_id", chunk_vectors="vector",
    )
    few = left.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    if few:
        pairs = right.join(F.broadcast(left), ["plant_id", "_width"])
    else:
        # Every part of a plant's chunk blocks meets all question blocks of the plant.
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part")
        spread = right.withColumn("_part", F.pmod(F.xxhash64("evidence_ids"), F.lit(SALTS)).cast("int"))
        pairs = spread.join(left.select("*", parts), ["plant_id", "_width", "_part"])
    pairs = pairs.select("query_ids", "query_vectors", "evidence_ids", "document_ids", "chunk_vectors")
    types = {c: df.schema[c].dataType.simpleString() for df in (queries, chunked)
             for c in ("query_id", "document_id") if c in df.columns}
    schema = (
        f"query_id {types['query_id']}, evidence_id string, "
        f"document_id {types['document_id']}, semantic double"
    )
    return pairs.mapInPandas(lambda batches: _similarities(batches, gate), schema)


def _shared_terms(query_terms: Column, bag: Column) -> Column:
    """The terms of a question that a chunk has, with both counts and the weight."""

    def matched(found: Column) -> Column:
        each = F.transform(
            query_terms,
            lambda t: F.struct(
                F.coalesce(F.try_element_at(found, t["term"]), F.lit(0)).alias("tf"),
                t["query_tf"].alias("query_tf"), t["weight"].alias("weight"),
            ),
        )
        return F.filter(each, lambda m: m["tf"] > 0)

    return let(F.map_from_entries(bag), matched)


def scores_by_posting(weighted: DataFrame, bagged: DataFrame) -> DataFrame:
    """Score every pair that shares a term, with the question terms broadcast.

    The postings of a chunk come from one row, so the partial aggregate of a map task is
    already the whole pair.
    """
    postings = bagged.select(
        "plant_id", "evidence_id", "document_id", "length", F.explode("bag").alias("p")
    ).select("plant_id", "evidence_id", "document_id", "length", "p.term", "p.tf")
    part = F.col("weight") * terms.term_weight(F.col("tf"), F.col("length"), F.col("average_length"))
    return (
        postings.join(F.broadcast(weighted), ["plant_id", "term"])
        .groupBy("query_id", "evidence_id", "document_id")
        .agg(
            (F.sum(F.least("tf", "query_tf")) / F.max("query_length")).alias("lexical"),
            F.sum(part).alias("bm25"),
        )
    )


def scores_by_candidate(weighted: DataFrame, bagged: DataFrame, extra: DataFrame | None) -> DataFrame:
    """Score the pairs that share a selective term, and the extra pairs."""
    postings = bagged.select("plant_id", "evidence_id", F.explode("bag.term").alias("term"))
    wanted = weighted.where("selective").select("query_id", "plant_id", "term")
    pairs = postings.join(wanted, ["plant_id", "term"]).select("query_id", "evidence_id")
    if extra is not None:
        pairs = pairs.unionByName(extra.select("query_id", "evidence_id"))
    asked = weighted.groupBy("query_id", "query_length", "average_length").agg(
        F.collect_list(F.struct("term", "query_tf", "weight")).alias("_terms")
    )
    detail = bagged.select("evidence_id", "document_id", "bag", "length")
    matched = (
        pairs.distinct().join(asked, "query_id").join(detail, "evidence_id")
        .withColumn("_shared", _shared_terms(F.col("_terms"), F.col("bag")))
    )
    overlap = F.aggregate(
        "_shared", F.lit(0), lambda total, m: total + F.least(m["tf"], m["query_tf"])
    )
    bm25 = F.aggregate(
        "_shared", F.lit(0.0),
        lambda total, m: total
        + m["weight"] * terms.term_weight(m["tf"], F.col("length"), F.col("average_length")),
    )
    return matched.select(
        "query_id", "evidence_id", "document_id",
        (overlap / F.col("query_length")).alias("lexical"), bm25.alias("bm25"),
    )


def retrieve(
    documents: DataFrame, queries: DataFrame, strategy: str = "auto", limit: int = fixed.EVIDENCE_LIMIT,
    model: str | None = None,
) -> DataFrame:
    """The best chunks for every question, with their scores and ranks.

    ``documents`` is ``(document_id, plant_id, title, content, version[, vector[, embedding_model]])`` and
    ``queries`` is ``(query_id, plant_id, query[, vector])``. The strategies are ``lexical``, ``vector`` and
    ``auto``, which fuses both rankings. With a ``model``, only vectors of that model are compared.
    A question without tokens finds nothing.
    """
    semantic = "vector" in documents.columns and "vector" in queries.columns
    optional = [c for c in ("vector", "embedding_model") if semantic and c in documents.columns]
    kept = ["document_id", "plant_id", "title", "version", "content", *optional]
    return retrieve_from(index(documents.select(*kept)), queries, strategy, limit, model)


def question_blocks(asked: DataFrame) -> Iterator[tuple[list[scoring.Question], list[tuple]]]:
    """Questions in blocks of about ``BROADCAST_TERMS`` terms and ``BLOCK_QUESTIONS`` questions, one at a
    time on the driver, with (number, query_id) rows."""
    sizes = asked.agg(F.sum(F.size("bag")), F.count("*")).first()
    if not sizes[1]:
        return
    count = min(max(-(-sizes[0] // max(1, BROADCAST_TERMS)), -(-sizes[1] // BLOCK_QUESTIONS)), sizes[1])
    for number in range(count):
        block = asked if count == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == number)
        found = block.collect()
        if found:
            yield (
                [scoring.Question(n, r.plant_id, r.length, [tuple(t) for t in r.bag], r.vector) for n, r in enumerate(found)],
                [(n, r.query_id) for n, r in enumerate(found)],
            )


def _pool(bagged: DataFrame, block: Broadcast, depth: int, strategy: str, semantic: bool) -> DataFrame:
    """The best ``depth`` chunks of every question and list, each once, with the ranks known from the lists."""
    lists = staged(scoring.best_lists(bagged, block, depth, semantic, strategy != "vector"), "best").where("query_no >= 0")
    near = F.bround("semantic", 4)
    score = F.when(F.col("list") == scoring.WORDS, F.col("bm25")).otherwise(near)
    # Each task gave at most ``depth`` rows of a question, so that few of them meet here.
    order = W.partitionBy("query_no", "list").orderBy(score.desc(), F.col("evidence_id"))
    best = lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth)
    return best.groupBy("query_no", "evidence_id", "document_id").agg(
        F.min(F.when(F.col("list") == scoring.WORDS, F.col("place"))).alias("by_words"),
        F.min(F.when(F.col("list") == scoring.MEANING, F.col("place"))).alias("by_meaning"),
        F.max("lexical").alias("lexical"), F.max("bm25").alias("bm25"), F.max(near).alias("semantic"),
    )


def _with_counted_ranks(pool: DataFrame, bagged: DataFrame, block: Broadcast) -> DataFrame:
    """Ranks of the pool's rows in the list that did not give them, by counting what stands before them."""
    missing = {
        scoring.WORDS: pool.where("by_words IS NULL").select("query_no", F.col("bm25").alias("score"), "evidence_id"),
        scoring.MEANING: pool.where(F.col("by_meaning").isNull() & (F.col("semantic") >= fixed.SEMANTIC_GATE)).select(
            "query_no", F.col("semantic").alias("score"), "evidence_id"
        ),
    }
    wanted: dict[tuple, list] = {}
    for name, rows in missing.items():
        for r in rows.collect():  # at most two lists' depth for each question of the block
            wanted.setdefault((r.query_no, name), []).append((r.score, r.evidence_id))
    if not wanted:
        return pool
    arrays = {k: (np.array([s for s, _ in v]), np.array([e for _, e in v], object)) for k, v in wanted.items()}
    counted = scoring.better_counts(bagged, block, pool.sparkSession.sparkContext.broadcast(arrays))
    per_row = counted.groupBy("query_no", "evidence_id").agg(
        F.max(F.when(F.col("list") == scoring.WORDS, F.col("above") + 1)).alias("_words"),
        F.max(F.when(F.col("list") == scoring.MEANING, F.col("above") + 1)).alias("_meaning"),
    )
    return (
        pool.join(per_row, ["query_no", "evidence_id"], "left")
        .withColumn("by_words", F.coalesce("by_words", "_words"))
        .withColumn("by_meaning", F.coalesce("by_meaning", "_meaning"))
        .drop("_words", "_meaning")
    )


def _selected(pool: DataFrame, strategy: str, limit: int) -> DataFrame:
    """The first ``limit`` of the pool with two chunks of a document at most."""
    part = lambda place: F.coalesce(1 / (fixed.FUSION_OFFSET + F.col(place)), F.lit(0.0))
    score = F.col("semantic") if strategy == "vector" else part("by_words")
    if strategy == "auto":
        score = score + part("by_meaning")
    best = [F.col("score").desc(), F.col("evidence_id").asc()]
    return (
        pool.withColumn("score", score)
        .withColumn("_d", F.row_number().over(W.partitionBy("query_no", "document_id").orderBy(*best)))
        .where(F.col("_d") <= fixed.CHUNKS_PER_DOCUMENT)
        .withColumn("rank", F.row_number().over(W.partitionBy("query_no").orderBy(*best)).cast("long"))
        .where(F.col("rank") <= limit)
        .drop("_d")
    )


def _unsettled(pool: DataFrame, chosen: DataFrame, strategy: str, limit: int, depth: int) -> set[int]:
    """Questions whose selection a chunk outside the pool could still enter.

    A list shorter than ``depth`` is whole. By one list, the selection is settled once it is full. With two,
    a chunk outside both has ranks beyond ``depth``, and so a known largest score.
    """
    main = "by_meaning" if strategy == "vector" else "by_words"
    sizes = pool.groupBy("query_no").agg(
        F.count_if(F.col(main) <= depth).alias("held"), F.count_if(F.col("by_meaning") <= depth).alias("near")
    )
    full = chosen.groupBy("query_no").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    state = sizes.where(F.col("held") >= depth).join(full, "query_no", "left")
    settled = F.col("n") >= limit
    if strategy == "auto":
        lists = 1 + (F.col("near") >= depth).cast("int")
        settled = settled & (F.col("least") > lists / (fixed.FUSION_OFFSET + depth + 1))
    return {r.query_no for r in state.where(~F.coalesce(settled, F.lit(False))).select("query_no").collect()}


def retrieve_from(
    bagged: DataFrame, queries: DataFrame, strategy: str = "auto", limit: int = fixed.EVIDENCE_LIMIT,
    model: str | None = None,
) -> DataFrame:
    """:func:`retrieve` on an index that already exists."""
    if strategy not in ("lexical", "vector", "auto"):
        raise ValueError(f"unknown strategy: {strategy}")
    semantic = strategy != "lexical" and "vector" in bagged.columns and "vector" in queries.columns
    if strategy == "vector" and not semantic:
        raise ValueError("the vector strategy needs vectors on both sides")
    if semantic and model is not None and "embedding_model" in bagged.columns:
        bagged = bagged.withColumn("vector", F.when(F.col("embedding_model") == model, F.col("vector")))
    tokens = terms.token_array(F.col("query"))
    vector = F.when(terms.valid_vector(F.col("vector")), F.col("vector")) if semantic else F.lit(None).cast("array<double>")
    asked = staged(
        queries.select("query_id", "plant_id", tokens.alias("tokens"), vector.alias("vector"))
        .where(F.size("tokens") > 0)
        .select("query_id", "plant_id", terms.token_counts(F.col("tokens")).alias("bag"), F.size("tokens").alias("length"), "vector"),
        "questions",
    )
    spark, parts = bagged.sparkSession, []
    for questions, names in question_blocks(asked):
        statistics = scoring.plant_statistics(bagged, questions)
        depth, left = max(FIRST_DEPTH if strategy == "auto" else FIRST_DEPTH // 4, limit), questions
        while left:
            block = spark.sparkContext.broadcast(scoring.QuestionBlock(left, statistics))
            pool = _pool(bagged, block, depth, strategy, semantic)
            if strategy == "auto" and semantic:
                pool = staged(pool, "pool")
                pool = _with_counted_ranks(pool, bagged, block)
            pool = staged(pool, "pool")
            chosen = _selected(pool, strategy, limit)
            unsettled = _unsettled(pool, chosen, strategy, limit, depth)
            settled = chosen.where(~F.col("query_no").isin(*unsettled)) if unsettled else chosen
            ids = spark.createDataFrame(names, f"query_no int, query_id {dict(queries.dtypes)['query_id']}")
            parts.append(settled.join(ids, "query_no"))
            left, depth = [q for q in left if q.number in unsettled], depth * 4
    detail = bagged.select("evidence_id", "title", "start", "end")
    if not parts:
        empty = F.lit(None)
        parts = [asked.where("false").select(
            "query_id", empty.cast("long").alias("rank"), empty.cast("string").alias("evidence_id"),
            empty.cast(dict(bagged.dtypes)["document_id"]).alias("document_id"),
            *[empty.cast("double").alias(c) for c in ("lexical", "semantic", "bm25", "score")],
        )]
    columns = ["query_id", "rank", "evidence_id", "document_id", "lexical", "semantic", "bm25", "score"]
    top = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    return top.join(detail, "evidence_id").select(
        "query_id", "rank", "evidence_id", "document_id", "title", "start", "end",
        F.bround("lexical", 4).alias("lexical_score"), F.col("semantic").alias("semantic_score"),
        F.bround("bm25", 4).alias("bm25_score"), F.bround("score", 6).alias("score"),
    )


def evidence_payload(
    bagged: DataFrame, documents: DataFrame, queries: DataFrame, strategy: str = "auto", model: str | None = None
) -> DataFrame:
    """What an answer stores with each piece of evidence: scores, text, version, digest and the mode of the search.

    A question's mode is ``hybrid`` or ``vector`` if it was compared by meaning, that is if it has a vector and
    its plant any document of the model; else ``lexical``.
    """
    found = retrieve_from(bagged, queries, strategy, model=model)
    semantic = strategy != "lexical" and "vector" in bagged.columns and "vector" in queries.columns
    compared = F.lit(False)
    asked = queries.select("query_id", "plant_id")
    if semantic:
        fits = F.col("vector").isNotNull()
        if model is not None and "embedding_model" in bagged.columns:
            fits = fits & (F.col("embedding_model") == model)
        with_vectors = bagged.groupBy("plant_id").agg(F.bool_or(fits).alias("_any"))
        given = queries.select("query_id", "plant_id", terms.valid_vector(F.col("vector")).alias("_own"))
        asked = given.join(with_vectors, "plant_id", "left")
        compared = F.col("_own") & F.coalesce("_any", F.lit(False))
    named = "vector" if strategy == "vector" else "hybrid"
    modes = asked.select("query_id", F.when(compared, named).otherwise("lexical").alias("mode"))
    texts = bagged.select("evidence_id", "version", "text")
    digests = documents.select("document_id", "content_sha256")
    return found.join(texts, "evidence_id").join(digests, "document_id").join(modes, "query_id").withColumn(
        "lexical_plus_semantic", F.bround(F.col("lexical_score") + F.col("semantic_score"), 4)
    )


def attach_vectors(
    chunked: DataFrame, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], model: str
) -> DataFrame:
    """Add vectors from a caller's function, which sees batches of texts on the executors.

    Vectors that are empty, too long, not finite or all zero become null, as does the model.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embed(batch["text"].tolist())
            if len(vectors) != len(batch):
                raise ValueError("the embedder must return one vector per chunk")
            yield batch.assign(vector=[list(map(float, v)) for v in vectors])

    schema = chunked.drop("vector").schema.simpleString()[len("struct<"):-1] + ",vector:array<double>"
    filled = chunked.drop("vector").mapInPandas(run, schema)
    good = terms.valid_vector(F.col("vector"))
    return filled.withColumn("vector", F.when(good, F.col("vector"))).withColumn(
        "embedding_model", F.when(F.col("vector").isNotNull(), F.lit(model))
    )


def mixed_dimensions(chunked: DataFrame) -> DataFrame:
    """Documents whose chunk vectors do not all have one size."""
    sizes = chunked.where(F.col("vector").isNotNull()).groupBy("document_id").agg(
        F.min(F.size("vector")).alias("smallest"), F.max(F.size("vector")).alias("largest")
    )
    return sizes.where("smallest <> largest")


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versioned upsert: new, updated, conflicting and untouched documents.

    ``incoming`` is ``(document_id, plant_id, title, content, expected_version)``. An
    update needs the current version; anything else is a conflict and keeps the old row.
    """
    old = current.select(
        "document_id", F.col("plant_id").alias("_plant"), F.col("title").alias("_title"),
        F.col("content").alias("_content"), F.col("version").alias("_version"),
    )
    given, stored = F.col("content").isNotNull(), F.col("_version").isNotNull()
    result = (
        F.when(given & ~stored, "created")
        .when(given & stored & F.col("expected_version").eqNullSafe(F.col("_version")), "updated")
        .when(given & stored, "conflict")
        .otherwise("kept")
    )
    takes = F.col("result").isin("created", "updated")

    def pick(name: str) -> Column:
        return F.when(takes, F.col(name)).otherwise(F.col(f"_{name}"))

    return (
        old.join(incoming, "document_id", "full_outer")
        .withColumn("result", result)
        .withColumn("_plant_id", F.col("_plant"))
        .select(
            "document_id", pick("plant_id").alias("plant_id"), pick("title").alias("title"),
            F.sha2(pick("content"), 256).alias("content_sha256"),
            (F.coalesce("_version", F.lit(0)) + F.when(takes, 1).otherwise(0)).cast("int").alias("version"),
            "result",
        )
    )


def merged_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The document table after a versioned upsert, with what became of each row.

    As :func:`upsert_documents`, with everything a document is stored with. A new content takes the place of
    the old one, and its vector and model go, as they belong to the old text. ``result`` and
    ``expected_version`` tell writers about conflicts; :func:`store_documents` leaves them out.
    """
    old = current.withColumnsRenamed({c: f"_{c}" for c in current.columns if c != "document_id"})
    fresh = incoming.select("document_id", "plant_id", "title", "content", "expected_version")
    both = old.join(fresh, "document_id", "full_outer")
    given, stored = F.col("content").isNotNull(), F.col("_version").isNotNull()
    result = (
        F.when(given & ~stored, "created")
        .when(given & stored & F.col("expected_version").eqNullSafe(F.col("_version")), "updated")
        .when(given & stored, "conflict")
        .otherwise("kept")
    )
    takes = F.col("result").isin("created", "updated")
    same = F.col("content").eqNullSafe(F.col("_content"))
    kinds = dict(current.dtypes)

    def column(name: str) -> Column:
        if name in ("plant_id", "title", "content"):
            return F.when(takes, F.col(name)).otherwise(F.col(f"_{name}"))
        if name == "content_sha256":
            return F.sha2(F.when(takes, F.col("content")).otherwise(F.col("_content")), 256)
        if name == "version":
            return (F.coalesce("_version", F.lit(0)) + takes.cast("int")).cast(kinds[name])
        if name in ("vector", "embedding_model"):
            return F.when(~takes | same, F.col(f"_{name}"))
        return F.col(f"_{name}")

    return both.withColumn("result", result).select(
        "document_id", *[column(c).alias(c) for c in current.columns if c != "document_id"], "result", "expected_version"
    )


def store_documents(current: DataFrame, incoming: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the merged table to a new place; returns it read back, and the conflicts with the version they met."""
    merged = staged(merged_documents(current, incoming), "merged-documents")
    merged.drop("result", "expected_version").write.parquet(path)
    conflicts = merged.where("result = 'conflict'").select("document_id", "expected_version", F.col("version").alias("current_version"))
    return current.sparkSession.read.parquet(path), conflicts


def seed_documents(current: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds whose title is not there yet; an existing document is never overwritten."""
    return seeds.join(current.select("plant_id", "title"), ["plant_id", "title"], "left_anti")


def reembed_candidates(current: DataFrame, seeds: DataFrame) -> DataFrame:
    """Stored documents that still equal their seed, and so may be embedded again."""
    return current.join(
        seeds.select("plant_id", "title", "content"), ["plant_id", "title", "content"], "left_semi"
    )


def newest_documents(documents: DataFrame, order: str) -> DataFrame:
    """Documents by last update, newest first."""
    return documents.orderBy(F.col(order).desc(), "document_id")
