"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment.

Words are lower-case and without punctuation. Passage and item are aligned locally over words: a
match scores 2, a mismatch, and a gap of one word, -1. The score over that of a perfect copy is the
similarity; from ``threshold`` on the document is contaminated.

The search loses no such passage. A score that reaches the threshold needs a certain number of
matches, and so few other words that its stretch of the text is short. The occurrences of the
items' words are counted over all documents; the rarest words of each item are its seeds, as many
that every sufficient passage holds ``k`` of them, however many words of the item were changed and
however often the changed copy repeats. Where ``k`` seeds stand close enough, the stretch that such
a passage could fill is aligned, unless its words rule the score out.

The benchmark is the stated query set: it goes to the tasks in blocks of at most ``BLOCK_BYTES``
of text, each against all documents. Documents never meet each other, nothing is shuffled but
counts of the items' own words, and a passage that fills a third of the corpus is aligned where
it is read.

Cases: null and empty texts match nothing. Items of fewer than ``MIN_WORDS`` words are no evidence
of a copy and are left out, as are null items. Rows with the same id are judged one by one and
their matches joined. Very long texts are read whole; only passages are aligned. Empty tables on
either side give no matches. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import plain_words, table, union_all

MIN_WORDS = 8
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20
# A third of the matches that an item needs must be seeds: fewer let more texts through to the
# alignment, more make more words seeds.
SEED_SHARE = 3
# Texts that are searched side by side hold about so many words.
GROUP_WORDS = 1 << 16

_FILTER_BITS = 22


def word_hashes(text: str | None) -> np.ndarray:
    split = plain_words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))


class Lookup:
    """Finds which words of a text belong to a small sorted set."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the text, and in the sorted set."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
        real = self.keys[place] == found[at]
        return at[real], place[real]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and where in the passage it ends (exclusive).

    One row for each word of the item; gaps along the passage are a running maximum.
    """
    n = len(passage)
    ramp = np.arange(n + 1, dtype=np.int32) * -GAP
    above = np.zeros(n + 1, np.int32)
    best, end = 0, 0
    for word in item:
        row = np.zeros(n + 1, np.int32)
        np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def word_counts(docs: DataFrame, text_column: str, keys: np.ndarray) -> dict[int, int]:
    """Occurrences of the given words in all texts: at most one number per key."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        seen = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += np.bincount(lookup.hits(word_hashes(text))[1], minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"word": lookup.keys[some].view(np.int64), "n": seen[some]})

    counted = docs.select(text_column).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"] % 2**64: r["n"] for r in counted.collect()}


class Seeds:
    """Finds the stretches of texts that can hold a passage similar to an item."""

    def __init__(self, items: list[np.ndarray], occurrences: dict[int, int], threshold: float):
        self.items = items
        self.words = [np.unique(h, return_counts=True) for h in items]
        self.needed = np.array([threshold * MATCH * len(h) for h in items])
        self.span, self.least = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        holders: dict[int, list[int]] = {}
        for n, h in enumerate(items):
            matches = int(np.ceil(self.needed[n] / MATCH - 1e-9))
            # All matched, and every point above the needed score spent on a word of the text.
            self.span[n] = len(h) + int(MATCH * len(h) - self.needed[n] + 1e-9)
            wanted = len(h) - matches + max(1, matches // SEED_SHARE)
            found = Counter(h.tolist())
            chosen = 0
            for word in sorted(found, key=lambda w: (occurrences.get(w, 0), w)):
                if chosen >= wanted:
                    break
                chosen += found[word]
                holders.setdefault(word, []).append(n)
            self.least[n] = matches - (len(h) - chosen)
        self.lookup = Lookup(np.fromiter(holders, np.uint64, len(holders)))
        lists = [holders[int(k)] for k in self.lookup.keys]
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.cumsum(self.counts) - self.counts
        kind = np.uint16 if len(items) < 1 << 16 else np.int32
        self.holders = np.fromiter((n for own in lists for n in own), kind, int(self.counts.sum()))
        self.apart = int(self.span.max(initial=0)) + 1

    def stretches(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, begin, end) of all stretches with enough seeds, those of a text and an item in order."""
        # Texts lie one after the other, so far apart that no stretch of one has seeds of another.
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.cumsum(sizes + self.apart) - sizes - self.apart
        at, key = self.lookup.hits(np.concatenate(texts))
        at = at + np.repeat(np.arange(len(texts)), sizes)[at] * self.apart
        many = self.counts[key]
        where = np.repeat(self.starts[key] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item, at = self.holders[where], np.repeat(at, many)
        order = np.argsort(item, kind="stable")
        item, at = item[order].astype(np.int64), at[order]
        last = np.arange(len(item)) + self.least[item] - 1
        first = np.flatnonzero(last < len(item))
        last = last[first]
        close = (item[last] == item[first]) & (at[last] - at[first] < self.span[item[first]])
        first, last = first[close], last[close]
        item = item[first]
        low, high = at[last] - self.span[item] + 1, at[first] + self.span[item]
        text = np.searchsorted(offsets, at[first], "right") - 1
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(item))[: len(begin)] - 1
        low = np.maximum(low[begin] - offsets[text[begin]], 0)
        high = np.minimum(high[end] - offsets[text[begin]], sizes[text[begin]])
        yield from zip(text[begin].tolist(), item[begin].tolist(), low.tolist(), high.tolist(), strict=True)

    def similar(self, texts: list[np.ndarray]) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, start, end) of the best passage of every text and item that are alike."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for text, n, begin, end in self.stretches(texts):
            own, passage, needed = self.items[n], texts[text][begin:end], self.needed[n]
            if not _possible(*self.words[n], passage, needed):
                continue
            score, stop = align(own, passage)
            if score >= needed and ((text, n) not in best or score / (MATCH * len(own)) > best[text, n][0]):
                _, back = align(own[::-1], passage[:stop][::-1])
                best[text, n] = (score / (MATCH * len(own)), begin + stop - back, begin + stop)
        return [(*at, *found) for at, found in sorted(best.items())]


def _possible(words: np.ndarray, times: np.ndarray, passage: np.ndarray, needed: float) -> bool:
    """Whether the score can be reached if the ``words`` of the item, each so many ``times``, may match in any order."""
    place = np.minimum(words.searchsorted(passage), len(words) - 1)
    inside = words[place] == passage
    found = np.bincount(place[inside], minlength=len(words))
    if MATCH * int(np.minimum(found, times).sum()) < needed:
        return False
    gained = np.append(0, np.cumsum(np.where(inside, MATCH, MISMATCH)))
    return (gained - np.minimum.accumulate(gained)).max() >= needed


def groups_of(sizes: list[int], limit: int = GROUP_WORDS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` words together."""
    begin = held = 0
    for n, size in enumerate(sizes):
        if n > begin and held + size > limit:
            yield begin, n
            begin, held = n, 0
        held += size
    if sizes:
        yield begin, len(sizes)


def blocks_of(items: list[tuple], limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    block, size = [], 0
    for item in items:
        if block and size + 8 * len(item[1]) > limit:
            yield block
            block, size = [], 0
        block.append(item)
        size += 8 * len(item[1])
    if block:
        yield block


def _matches(docs: DataFrame, block: list[tuple], item_type: str, id_column: str, text_column: str, threshold: float) -> DataFrame:
    items = [h for _, h in block]
    occurrences = word_counts(docs, text_column, np.unique(np.concatenate(items)))
    shared = docs.sparkSession.sparkContext.broadcast(([i for i, _ in block], Seeds(items, occurrences, threshold)))
    id_type = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {id_type}, item_id {item_type}, similarity double, start_word int, end_word int"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seeds = shared.value
        for batch in batches:
            rows, found = [], {"item_id": [], "similarity": [], "start_word": [], "end_word": []}
            texts = [word_hashes(t) for t in batch.column(1).to_pylist()]
            for begin, end in groups_of([len(t) for t in texts]):
                for n, item, *hit in seeds.similar(texts[begin:end]):
                    rows.append(begin + n)
                    for column, value in zip(found, (names[item], *hit), strict=True):
                        found[column].append(value)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            kinds = (None, pa.float64(), pa.int32(), pa.int32())
            arrays = [pa.array(v, t) if t else pa.array(v, pa_type) for v, t in zip(found.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *arrays], [id_column, *found])

    pa_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]
    return docs.select(id_column, text_column).mapInArrow(search, schema)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, ``item_id``, ``similarity``, ``start_word``, ``end_word``): the best passage of every
    document and benchmark item that are alike. Items need an id of an integer or text type."""
    item_type = dict(benchmark.dtypes)[item_id]
    chosen = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(item_id, item_text)
    items = [(i, h) for i, h in ((r[0], word_hashes(r[1])) for r in chosen.orderBy(item_id).toLocalIterator()) if len(h) >= MIN_WORDS]
    usable = docs.where(F.col(id_column).isNotNull())
    if not items:
        return usable.select(
            id_column, F.lit(None).cast(item_type).alias("item_id"), F.lit(None).cast("double").alias("similarity"),
            F.lit(None).cast("int").alias("start_word"), F.lit(None).cast("int").alias("end_word"),
        ).where("false")
    found = union_all([_matches(usable, b, item_type, id_column, text_column, threshold) for b in blocks_of(items)])
    best = F.max(F.struct("similarity", -F.col("start_word"), -F.col("end_word"))).alias("_best")
    return found.groupBy(id_column, "item_id").agg(best).select(
        id_column, "item_id", "_best.similarity", (-F.col("_best").getField("col2")).alias("start_word"),
        (-F.col("_best").getField("col3")).alias("end_word"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents that hold no passage of the benchmark; rows without id stay."""
    marked = docs.select(F.col(id_column).alias("_id"), F.col("text"))
    hit = contaminated(marked, benchmark, "_id").select(F.col("_id").alias(id_column)).distinct()
    return docs.join(hit, id_column, "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
