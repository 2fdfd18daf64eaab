"""Substring de-duplication: repeated windows of words, found through super-k-mers.

Each window of ``WINDOW`` words has a minimiser, the smallest hash of its runs of ``MINIMISER``
words. Consecutive windows with the same minimiser form a super-k-mer: a stretch of words that
holds them all. Super-k-mers are first told apart by minimiser alone: a window that occurs twice has a
minimiser that occurs twice, so that stretches with a minimiser of their own stay where they are. The
others travel as packed strings, equal strings as one with its first place, to the bucket of their
minimiser. There their windows are sorted, which puts equal windows next to each other, the first
place first. A bucket with more than ``BUCKET_STRINGS`` different strings is dealt out
window by window instead, each to its own place, so that no task gathers a hot minimiser.

Every word that is covered by a window whose words also start earlier (at a smaller id, or earlier in
the same document) is removed; windows are judged on the input. Strings are compared as such;
hashes choose buckets, and 128-bit digests stand for whole packed strings when results return.

Cases: null and empty texts have no words; the digest is that of the empty string. Texts of fewer
words than a window lose nothing. Rows without id lose nothing and take no part. An id stands for
one text: repeated rows of it are the same place, not a repeat. Very long texts give more
super-k-mers, never longer tasks than their own text. Empty tables give empty results; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import split_words, table
from millrace.llm.minhash import mix
from millrace.session import fresh_folder, staged

WINDOW = 20
MINIMISER = 7
BUCKET_STRINGS = 2000

_P = np.uint64(0x9E3779B97F4A7C15)


def super_kmers(hashed: np.ndarray, window: int, m: int) -> tuple[np.ndarray, ...]:
    """(minimiser, first window, number of windows, places of the minimiser) of each super-k-mer of
    at least ``window`` hashed words. A stretch of recurring words holds its minimiser more than once."""
    rolled = np.zeros(len(hashed) - m + 1, np.uint64)
    for k in range(m):
        rolled = mix(rolled * _P + hashed[k : k + len(rolled)])
    least = rolled[: len(hashed) - window + 1].copy()
    for k in range(1, window - m + 1):
        np.minimum(least, rolled[k : k + len(least)], out=least)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[first, len(least)])
    size = count + window - m
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(begin - first, size)
    held = np.add.reduceat((rolled[at] == np.repeat(least[first], size)).astype(np.int64), begin)
    return least[first].view(np.int64), first, count, held


def _compact(df: DataFrame, label: str) -> DataFrame:
    """Staged with a stronger compression: neighbouring packed strings overlap."""
    path = fresh_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def places(docs: DataFrame, window: int, m: int) -> DataFrame:
    """(``mini``, ``id``, ``start``, ``n``, ``held``) of all super-k-mers; docs have ``id`` and ``text``."""
    id_type = dict(docs.dtypes)["id"]
    schema = f"id {id_type}, mini bigint, start int, n int, held int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, owners = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                split = split_words(text)
                if len(split) >= window:
                    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
                    parts.append(super_kmers(hashed, window, m))
                    owners.append(np.full(len(parts[-1][0]), n))
            if parts:
                mini, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
                ids = batch.column(0).take(pa.array(np.concatenate(owners)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(mini), *(pa.array(c.astype(np.int32)) for c in rest)], ["id", "mini", "start", "n", "held"]
                )

    return docs.where("id is not null and text is not null").mapInArrow(cut, schema)


def packed(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(``id``, ``mini``, ``start``, ``digest``, ``words``): spans of documents as packed strings."""
    joined = docs.join(spans.groupBy("id").agg(F.collect_list(F.struct("start", "n", "mini")).alias("spans")), "id")
    schema = f"id {dict(docs.dtypes)['id']}, mini bigint, start int, digest binary, words binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], {"mini": [], "start": [], "digest": [], "words": []}
            for n, (text, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                split = split_words(text)
                for span in spans:
                    start = span["start"]
                    string = b" ".join(split[start : start + span["n"] + window - 1])
                    owners.append(n)
                    for name, value in zip(found, (span["mini"], start, xxhash.xxh3_128_digest(string), string), strict=True):
                        found[name].append(value)
                if len(owners) >= 20_000 or n == batch.num_rows - 1:
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(v, k) for v, k in zip(found.values(), kinds, strict=True))],
                        ["id", *found],
                    )
                    owners, found = [], {"mini": [], "start": [], "digest": [], "words": []}

    return joined.select("id", "text", "spans").mapInArrow(pack, schema)


def first_places(strings: DataFrame, window: int) -> DataFrame:
    """Strings with the first place of each of their windows (``ids``, ``starts``).

    Strings whose windows occur nowhere else are left out. ``strings`` has ``mini``, ``digest``,
    ``words``, the first place ``id`` and ``start``, and how many ``places`` the string has.
    """
    id_type = dict(strings.dtypes)["id"]
    schema = f"digest binary, ids array<{id_type}>, starts array<int>"
    # The list of hot minimisers is short next to the strings; written, its size is known to the plan.
    sizes = strings.groupBy("mini").agg(F.count("*").alias("size"))
    crowded = staged(sizes.where(F.col("size") > BUCKET_STRINGS).select("mini"), "crowded")
    cold = strings.join(crowded, "mini", "left_anti")
    hot = strings.join(crowded, "mini", "left_semi")

    def sort_bucket(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) == 1:
            _, digest, string, place, start, places = rows[0]
            split = string.split(b" ")
            n = len(split) - window + 1
            if len(set(split[:n])) == n:  # windows that begin with different words are different
                if places > 1:
                    yield digest, [place] * n, list(range(start, start + n))
                return
        windows = []
        for n, (_, _, string, place, start, _) in enumerate(rows):
            split = string.split(b" ")
            windows += [(b" ".join(split[k : k + window]), place, start + k, n, k) for k in range(len(split) - window + 1)]
        windows.sort()
        firsts: dict[int, list] = {}
        for _, same in groupby(windows, key=lambda w: w[0]):
            same = list(same)
            for _, _, _, n, k in same:
                firsts.setdefault(n, []).append((k, same[0][1], same[0][2], len(same)))
        for n, (_, digest, _, _, _, places) in enumerate(rows):
            if places > 1 or any(count > 1 for *_, count in firsts[n]):
                ordered = sorted(firsts[n])
                yield digest, [f[1] for f in ordered], [f[2] for f in ordered]

    def sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held: list[tuple] = []
        for _, bucket in groupby(rows(), key=lambda r: r[0]):
            held += sort_bucket(list(bucket))
            if len(held) >= 5000:
                yield as_batch(held)
                held = []
        if held:
            yield as_batch(held)

    def as_batch(held: list[tuple]) -> pa.RecordBatch:
        digest, ids, starts = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(ids), pa.array(starts, pa.list_(pa.int32()))], ["digest", "ids", "starts"])

    columns = ("mini", "digest", "words", "id", "start", "places")
    sorted_cold = cold.select(*columns).repartition("mini").sortWithinPartitions("mini").mapInArrow(sort_windows, schema)
    # Hot minimisers: each window goes its own way, equal ones are combined before they travel.
    split = F.split(F.col("words").cast("string"), " ")
    each = hot.select(
        "digest", "id", "start", split.alias("w"), F.explode(F.sequence(F.lit(0), F.array_size(split) - window)).alias("k")
    ).select("digest", "k", F.array_join(F.slice("w", F.col("k") + 1, window), " ").alias("window"), "id", (F.col("start") + F.col("k")).alias("start"))
    firsts = each.groupBy("window").agg(F.min(F.struct("id", "start")).alias("first"))
    sorted_hot = (
        each.select("digest", "k", "window").join(firsts, "window").groupBy("digest")
        .agg(F.sort_array(F.collect_list(F.struct("k", "first"))).alias("f"))
        .select("digest", F.col("f.first.id").alias("ids"), F.col("f.first.start").alias("starts"))
    )
    return sorted_cold.unionByName(sorted_hot)


def repeated_spans(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """(``id``, ``begins``, ``ends``): the words to remove of each document that has any."""
    found = staged(places(docs, window, m), "places")
    shared = found.groupBy("mini").agg(F.sum("held").alias("c")).where("c > 1").select("mini")
    stretches = _compact(packed(docs, found.join(shared, "mini"), window), "stretches")
    strings = staged(
        stretches.groupBy("mini", "digest").agg(
            F.any_value("words").alias("words"), F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("places")
        ).select("mini", "digest", "words", "first.id", "first.start", "places"),
        "strings",
    )
    firsts = staged(first_places(strings, window), "firsts")
    id_type = dict(docs.dtypes)["id"]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, begins, ends = [], [], []
            for n, (name, start, ids, starts) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                low = high = None
                for k, (first_id, first_start) in enumerate(zip(ids, starts, strict=True)):
                    if (first_id, first_start) != (name, start + k):
                        if high is not None and start + k <= high:
                            high = start + k + window
                            continue
                        if high is not None:
                            owners.append(n), begins.append(low), ends.append(high)
                        low, high = start + k, start + k + window
                if high is not None:
                    owners.append(n), begins.append(low), ends.append(high)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["id", "begin", "end"]
            )

    occurrences = stretches.select("id", "start", "digest").join(firsts, "digest").select("id", "start", "ids", "starts")
    cut = occurrences.mapInArrow(spans, f"id {id_type}, begin int, end int")
    return cut.groupBy("id").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """(id, ``n_words``, ``n_removed``, ``kept_text``, ``kept_sha256``) of every row."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    joined = source.join(staged(repeated_spans(source, window, m), "spans"), "id", "left").select("id", "text", "begins", "ends")
    schema = f"id {dict(source.dtypes)['id']}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"n_words": [], "n_removed": [], "kept_text": [], "kept_sha256": []}
            for text, begins, ends in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                split = split_words(text)
                total = len(split)
                if begins:
                    change = np.zeros(total + 1, np.int64)
                    np.add.at(change, begins, 1)
                    np.add.at(change, ends, -1)
                    stays = np.cumsum(change[:-1]) == 0
                    split = [split[n] for n in np.flatnonzero(stays).tolist()]
                kept = b" ".join(split)
                for column, value in zip(found, (total, total - len(split), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()), strict=True):
                    found[column].append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(found.values(), kinds, strict=True))], ["id", *found])

    return joined.mapInArrow(remove, schema).withColumnRenamed("id", id_column)


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
