"""Ranked lexical search by norm buckets: the best documents of each item, by integer term impacts.

A document is a vector of impacts, one for each of its terms; the score of an item is the product of
its term counts with that vector. Vectors are put in order of length and cut into buckets. An item
meets the buckets from the longest down with the score of its ``k``-th best document so far:

* a bucket whose longest vector times the length of the item cannot reach that score is left out
  (Cauchy-Schwarz);
* inside a bucket, the heaviest terms of the item must have impacts within the region that a vector of
  sufficient score can have, and what these terms give together with the rest of either length must
  reach the score;
* what is left is scored exactly in 64-bit integers.

Bounds carry a margin far above rounding, and a document that may tie with the ``k``-th score is
never left out, so that the result is exact. The first scores come from the longest vectors.

The items are the stated query set. They go to the tasks in blocks of at most ``BLOCK_BYTES`` of text,
each against all documents; a single item has to fit into a task. Vectors hold the terms of the block
only, as no other term adds to a product, while document counts, lengths and frequencies cover the whole
texts of all documents. Spark orders the vectors by ranges of (length, id), so that copies of one
text are dealt over many tasks. A task returns ``k`` rows for each item at most.

Cases: null and empty texts, and texts without terms, have no vector and are not counted. Items
without terms get no rows. Each row is a document, and each row of the items an item, even if ids
repeat. Documents without id count in all statistics but are not returned. Equal scores are ordered
by id. Empty tables on either side give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import column, table, union_all
from millrace.session import staged

BEST = 10
BLOCK_BYTES = 1 << 20
BUCKET_ROWS = 512
# A bucket is worked on as a table of vectors and the terms they hold, of so many cells unless one vector has more.
BUCKET_CELLS = 1 << 22
# The heaviest terms of an item that are looked at before a vector is scored.
FOCUS = 4
# Vectors whose length is above this quantile give the first scores.
FIRST_SHARE = 0.02
MARGIN = 1e-9

# Capitals become small letters; all other ASCII characters but digits and small letters part terms.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def impacts(weights: np.ndarray, counts: np.ndarray, lengths: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """What one occurrence of a term in an item adds: all in 64-bit integers, rounded down."""
    m = 25 + (75 * lengths * documents) // tokens
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


class Items:
    """The items of a block as sparse count vectors over the block's own vocabulary."""

    def __init__(self, texts: list[str | None]):
        counted = [Counter(terms(t)) for t in texts]
        self.vocabulary = {t: n for n, t in enumerate(sorted(set().union(*counted)))} if counted else {}
        self.terms, self.counts = [], []
        for c in counted:
            self.terms.append(np.array([self.vocabulary[t] for t in c], np.int64))
            self.counts.append(np.array(list(c.values()), np.int64))


def term_vectors(docs: DataFrame, id_column: str, text_column: str, vocabulary: Broadcast) -> DataFrame:
    """(``doc``, ``n`` terms of the whole text, ``terms``, ``counts`` of those in the vocabulary)."""
    source = docs.select(column(id_column).alias("doc"), column(text_column).alias("text")).where(F.col("text") != "")
    schema = f"doc {dict(source.dtypes)['doc']}, n bigint, terms array<int>, counts array<int>"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            sizes, places, found, counts = [], [0], [], []
            rows = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                split = terms(text)
                if not split:
                    continue
                rows.append(row)
                sizes.append(len(split))
                for term, count in Counter(split).items():
                    if (at := number(term)) is not None:
                        found.append(at)
                        counts.append(count)
                places.append(len(found))
            offsets = pa.array(places, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                ],
                ["doc", "n", "terms", "counts"],
            )

    return source.mapInArrow(vectors, schema)


def lists_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and which row each belongs to."""
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), sizes)


def impact_vectors(vectors: DataFrame, weights: Broadcast, documents: int, tokens: int) -> DataFrame:
    """(``length``, ``doc``, ``terms``, ``impacts``) of documents with an id and any impact above 0."""
    schema = f"length double, doc {dict(vectors.dtypes)['doc']}, terms array<int>, impacts array<bigint>"

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = lists_of(batch.column(2))
            counts, _ = lists_of(batch.column(3))
            n = batch.column(1).to_numpy()
            values = impacts(weights.value[found], counts, n[owner], documents, tokens)
            squares = np.bincount(owner, values.astype(np.float64) ** 2, len(n))
            starts = np.searchsorted(owner, np.arange(len(n) + 1))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.sqrt(squares)), batch.column(0), batch.column(2), lists], ["length", "doc", "terms", "impacts"])

    return vectors.where("doc IS NOT NULL").mapInArrow(weighed, schema).where("length > 0")


class Search:
    """The best documents of each item so far, while buckets of vectors go past."""

    def __init__(self, items: Items, best: int, floor: np.ndarray):
        self.items, self.best = items, best
        self.norms = np.array([math.sqrt(float((c * c).sum())) for c in items.counts])
        self.floor = floor.copy()  # a score that ``best`` documents are known to reach
        self.scores = [np.zeros(0, np.int64) for _ in items.terms]
        self.docs = [np.zeros(0, object) for _ in items.terms]
        self.met = self.scored = self.left_out = 0

    def bucket(self, part: pa.RecordBatch, heavy: np.ndarray) -> None:
        """One bucket of (``length``, ``doc``, ``terms``, ``impacts``), the longest vector first."""
        found, owner = lists_of(part.column(2))
        held = np.unique(found)
        if part.num_rows > 1 and part.num_rows * len(held) > BUCKET_CELLS:
            half = part.num_rows // 2
            self.bucket(part.slice(0, half), heavy)
            self.bucket(part.slice(half), heavy)
            return
        dense = np.zeros((part.num_rows, len(held) + 1), np.int64)  # the last column is that of all other terms
        dense[owner, np.searchsorted(held, found)] = lists_of(part.column(3))[0]
        length, docs = part.column(0).to_numpy(), np.array(part.column(1).to_pylist(), object)
        longest = float(length[0])
        for q, (asked, counts) in enumerate(zip(self.items.terms, self.items.counts, strict=True)):
            if not len(asked):
                continue
            floor, norm = float(self.floor[q]), self.norms[q]
            if longest * norm * (1 + MARGIN) < floor:
                self.left_out += len(length)
                continue
            self.met += len(length)
            found = np.searchsorted(held, asked)
            found[held[np.minimum(found, len(held) - 1)] != asked] = len(held)
            rows = self.candidates(length, dense, found, counts, norm, floor, heavy[asked])
            if not len(rows):
                continue
            self.scored += len(rows)
            score = dense[np.ix_(rows, found)] @ counts
            good = (score >= max(int(self.floor[q]), 1)).nonzero()[0]
            if len(good):
                self.keep(q, score[good], docs[rows[good]])

    def candidates(self, length, dense, found, counts, norm, floor, heavy) -> np.ndarray:
        """The rows that may reach ``floor``, by their impacts at the item's heaviest terms."""
        rows = np.arange(len(length))
        if floor <= 0:
            return rows
        focus = np.argsort(-counts * heavy, kind="stable")[:FOCUS]
        # The cosine that a vector of this length needs, and what is left outside the focus.
        needed = np.minimum(floor * (1 - MARGIN) / (norm * length), 1.0)
        given, square = np.zeros(len(rows)), np.zeros(len(rows))
        rest = 1.0
        for f in focus:
            share = counts[f] / norm
            part = dense[rows, found[f]] / length[rows]
            slack = np.sqrt(np.maximum((1 - needed[rows] ** 2) * (1 - share * share), 0)) + MARGIN
            most = np.where(share >= needed[rows], 1 + MARGIN, needed[rows] * share + slack)
            inside = (part >= needed[rows] * share - slack) & (part <= most)
            given, square, part, rows = given[inside] + share * part[inside], square[inside] + part[inside] ** 2, part[inside], rows[inside]
            rest -= share * share
        bound = given + np.sqrt(np.maximum(1 - square, 0) * max(rest, 0.0)) + MARGIN
        return rows[bound >= needed[rows]]

    def keep(self, q: int, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate((self.scores[q], scores)), np.concatenate((self.docs[q], docs))
        order = np.lexsort((docs, -scores))[: self.best]
        self.scores[q], self.docs[q] = scores[order], docs[order]
        if len(order) == self.best:
            self.floor[q] = max(self.floor[q], int(self.scores[q][-1]))


def best_in_buckets(by_length: DataFrame, items: Broadcast, floors: Broadcast, heavy: Broadcast, best: int) -> DataFrame:
    """(``item``, ``doc``, ``score``) of the best documents of each task, and its counters as item -1, -2, -3."""
    schema = f"item int, doc {dict(by_length.dtypes)['doc']}, score bigint"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kind = Search(items.value, best, floors.value), None
        for batch in batches:
            kind = batch.column(1).type
            for start in range(0, batch.num_rows, BUCKET_ROWS):
                state.bucket(batch.slice(start, BUCKET_ROWS), heavy.value)
        if kind is None:
            return
        numbers = [-1, -2, -3] + [q for q, s in enumerate(state.scores) for _ in s]
        docs = [None] * 3 + [d for ds in state.docs for d in ds]
        scores = [state.met, state.scored, state.left_out] + [int(x) for s in state.scores for x in s]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(docs, kind), pa.array(scores, pa.int64())], ["item", "doc", "score"])

    return by_length.mapInArrow(search, schema)


def effort(results: DataFrame) -> dict[str, int]:
    """Pairs of item and document that were met in buckets, scored, and left out with their bucket."""
    rows = results.where("item < 0").groupBy("item").agg(F.sum("score").alias("n")).collect()
    counts = {r["item"]: r["n"] for r in rows}
    return {"met": counts.get(-1, 0), "scored": counts.get(-2, 0), "left_out": counts.get(-3, 0)}


def ranked(rows: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return rows.where("item >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def block_results(docs: DataFrame, id_column: str, text_column: str, block: list[tuple], best: int) -> DataFrame:
    """(``item`` number within the block, ``doc``, ``score``) from every task that searched."""
    context = docs.sparkSession.sparkContext
    items = Items([text for _, text in block])
    vectors = staged(term_vectors(docs, id_column, text_column, context.broadcast(items.vocabulary)), "vectors")
    documents, tokens = vectors.agg(F.count("*"), F.sum("n")).first()
    documents, tokens = documents or 0, tokens or 1
    seen = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = np.zeros(len(items.vocabulary), np.int64)
    for row in seen.collect():  # a number for each term of the block at most
        df[row["term"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    weighed = impact_vectors(vectors, context.broadcast(weights), documents, tokens)
    ordered = weighed.repartitionByRange(F.desc("length"), "doc").sortWithinPartitions(F.desc("length"), "doc")
    by_length = staged(ordered, "lengths")

    shared, heavy = context.broadcast(items), context.broadcast(weights)
    nothing = context.broadcast(np.zeros(len(block), np.int64))
    bound = by_length.agg(F.percentile_approx("length", 1 - FIRST_SHARE)).first()[0]
    floors = np.zeros(len(block), np.int64)
    if bound is not None:
        longest = by_length.where(F.col("length") >= bound).sortWithinPartitions(F.desc("length"), "doc")
        first = ranked(best_in_buckets(longest, shared, nothing, heavy, best), best)
        for row in first.where(F.col("rank") == best).collect():  # one row for each item of the block
            floors[row["item"]] = row["score"]
    # Files may be cut and packed anew when read: their rows are put in order again within each task.
    again = by_length.sortWithinPartitions(F.desc("length"), "doc")
    return best_in_buckets(again, shared, context.broadcast(floors), heavy, best)


def item_blocks(items: DataFrame, item_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes`` of text, one block at a time on the driver."""
    source = items.select(column(item_column).alias("item"), column(text_column).alias("text")).where(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return
    blocks = -(-size // block_bytes)
    for number in range(blocks):
        yield [tuple(r) for r in source.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).collect()]


def search(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", best: int = BEST, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(``item_id``, ``rank``, ``doc_id``, ``score``) of the ``best`` documents of every item; columns keep the given names."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[id_column], dict(items.dtypes)[item_column]
    parts = []
    for block in item_blocks(items, item_column, item_text, block_bytes):
        if not block:
            continue
        found = ranked(block_results(docs, id_column, text_column, block, best), best)
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], f"item int, id {kinds[1]}")
        parts.append(found.join(names, "item").select("id", "rank", "doc", "score"))
    if not parts:
        return spark.createDataFrame([], f"`{item_column}` {kinds[1]}, rank int, `{id_column}` {kinds[0]}, score bigint")
    return union_all(parts).toDF(item_column, "rank", id_column, "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op13_ranked_search": r"""
WITH pieces AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counted AS (
    SELECT doc_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf
    FROM pieces GROUP BY ALL
), lengths AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id
), corpus AS (
    SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM lengths
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus
), asked AS (
    SELECT item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS q
    FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL
), scores AS (
    SELECT a.item_id, c.doc_id,
           CAST(sum(a.q * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (25 + (75 * l.n * o.documents) // o.tokens)))) AS BIGINT) AS score
    FROM asked a JOIN counted c USING (term) JOIN weights w USING (term) JOIN lengths l USING (doc_id), corpus o
    GROUP BY a.item_id, c.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
""",
}
