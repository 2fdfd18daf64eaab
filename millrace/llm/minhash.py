"""Near-duplicates by DartMinHash signatures, banded candidate search and exact verification.

A text is the set of its five-word shingles (a text of one to four words is one shingle), with
weight 1, or with the number of their occurrences for ``weights="count"``. Every unit of weight is
a region on which an element throws hashed darts: the first region holds weights up to 1, the
next from 1 to 2, then 2 to 4 and so on. Darts arrive as a Poisson process whose intensity is the
width of the region, each at a hashed moment, position and coordinate; those beyond the weight
miss. Per coordinate the earliest dart stays. Two texts agree in a coordinate with the
probability of their (weighted) Jaccard similarity, and only about ``k log k`` darts are looked at.

Bands of ``ROWS`` coordinates are join keys; texts of similarity 0.8 share none of ``BANDS`` with
a probability of 4e-7. Copies with equal words count as one text. Within a bucket every text is
compared with one centre; then texts of buckets that still hold several components meet across
these where a rare shingle near their front says that they can be similar (see :func:`apart`), so
that a group of thousands of copies costs a multiple of its size and not its square. All
comparisons are exact and no pair that could change a class is left out.

Cases: null texts, and those without words, are like nothing and form classes of their own. Rows
without id get no class. Rows that share an id share a class. Ties do not matter: a class is named
after its smallest id. Empty tables give empty results; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import split_words, table
from millrace.llm.components import components
from millrace.session import staged

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 4, 28
# Texts whose signatures are computed together, about 40 MB of work arrays at once.
GROUP_TEXTS, GROUP_ELEMENTS = 1000, 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that each bit of the result depends on all bits."""
    h = (h ^ (h >> _S33)) * _A
    h = (h ^ (h >> _S33)) * _B
    return h ^ (h >> _S33)


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and up to 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740992.0


def shingles(text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``n``-word shingles in ascending order, and their counts."""
    split = split_words(text)
    if not split:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    n = min(n, len(split))
    rolled = np.zeros(len(split) - n + 1, np.uint64)
    for k in range(n):
        rolled = mix(rolled * _P + hashed[k : k + len(rolled)])
    return np.unique(rolled, return_counts=True)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, n: int, k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates, as hashes, for each of ``n`` sets; weights above 0.

    ``owners`` says which set (0 to n - 1) an element belongs to. Sets throw side by side, each up to
    its own moment; those with a coordinate that no dart has hit throw again for twice as long.
    """
    total = np.bincount(owners, weights, n)
    until = (k * np.log(k) + 2 * k) / total
    signature = np.zeros((n, k), np.uint64)
    todo = np.arange(n)
    while len(todo):
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        # Regions of an element: up to 1, 1 to 2, 2 to 4, ... as far as its weight reaches.
        seeds, rates, lows, regions = [], [], [], []
        low, width, level = 0.0, 1.0, 0
        inside = np.flatnonzero(wanted[owners])
        while len(inside):
            seeds.append(mix(elements[inside] + np.uint64((level + 1) * int(_P) % 2**64)))
            rates.append(np.full(len(inside), width))
            lows.append(np.full(len(inside), low))
            regions.append(inside)
            low, width, level = low + width, low + width, level + 1
            inside = inside[weights[inside] > low]
        seed, rate, start, element = map(np.concatenate, (seeds, rates, lows, regions))
        moment = np.zeros(len(seed))
        moments, darts, slots = [], [], []
        throw = 0
        while len(seed):
            throw += 1
            dart = mix(seed ^ np.uint64(throw * int(_A) % 2**64))
            moment = moment - np.log(unit(dart)) / rate
            flying = np.flatnonzero(moment <= until[owners[element]])
            seed, rate, start, element = seed[flying], rate[flying], start[flying], element[flying]
            dart, moment = dart[flying], moment[flying]
            hit = start + rate * unit(mix(dart + _P)) <= weights[element]
            moments.append(moment[hit])
            darts.append(dart[hit])
            slots.append(owners[element[hit]] * k + (mix(dart[hit] ^ _B) % np.uint64(k)).astype(np.int64))
        dart, moment, slot = map(np.concatenate, (darts, moments, slots))
        earliest = np.full(n * k, np.inf)
        np.minimum.at(earliest, slot, moment)
        first = moment == earliest[slot]
        chosen = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(chosen, slot[first], dart[first])
        full = np.isfinite(earliest).reshape(n, k).all(axis=1)
        done = todo[full[todo]]
        signature[done] = chosen.reshape(n, k)[done]
        todo = todo[~full[todo]]
        until[todo] *= 2
    return signature


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The signature of one set; see :func:`dart_signatures`."""
    return dart_signatures(elements, weights, np.zeros(len(elements), np.int64), 1, k)[0]


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One key for each band of a signature, or of each row of several."""
    parts = signature.reshape(*signature.shape[:-1], bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _P
    for column in range(rows):
        key = mix(key * _P + parts[..., column])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_column: str, text_column: str, weights: str, rows: int, bands: int) -> DataFrame:
    """(``id``, ``copy`` hash of the words, ``size`` in weight, ``bands``) of all texts with words."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull()
    )
    schema = f"id {dict(source.dtypes)['id']}, copy binary, size bigint, bands array<bigint>"
    out_schema = pa.schema(
        [("copy", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )

    def signed(texts: list[str]) -> Iterator[tuple]:
        """Signatures of many texts together; a very long one closes its group."""
        held, size = [], 0
        for n, text in enumerate(texts):
            elements, counts = shingles(text)
            if len(elements):
                w = counts.astype(np.float64) if weights == "count" else np.ones(len(elements))
                held.append((n, xxhash.xxh3_128_digest(b" ".join(split_words(text))), elements, w))
                size += len(elements)
            if held and (size >= GROUP_ELEMENTS or len(held) == GROUP_TEXTS or n == len(texts) - 1):
                numbers, copies, sets, sizes = zip(*held, strict=True)
                owners = np.repeat(np.arange(len(held)), [len(e) for e in sets])
                found = dart_signatures(np.concatenate(sets), np.concatenate(sizes), owners, len(held), rows * bands)
                yield numbers, copies, [int(w.sum()) for w in sizes], band_keys(found, rows, bands)
                held, size = [], 0

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, copies, sizes, keys in signed(batch.column(1).to_pylist()):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                part = pa.RecordBatch.from_arrays([pa.array(copies, pa.binary()), pa.array(sizes, pa.int64()), lists], out_schema)
                ids = batch.column(0).take(pa.array(numbers, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *part.columns], ["id", *part.schema.names])

    return source.mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, id_column: str, text_column: str, wanted: DataFrame, weights: str) -> DataFrame:
    """(``node``, ``elements``) of the texts that some pair needs; with counts, one element each time."""
    source = docs.select(F.col(id_column).alias("node"), F.col(text_column).alias("text")).join(wanted, "node", "left_semi")
    schema = f"node {dict(source.dtypes)['node']}, elements array<bigint>"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                elements, counts = shingles(text)
                if weights == "count":  # the n-th occurrence is an element of its own
                    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    elements = mix(np.repeat(elements, counts) + nth.astype(np.uint64) * _P)
                found.append(elements.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "elements"])

    return source.mapInArrow(sets, schema).groupBy("node").agg(F.any_value("elements").alias("elements"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose exact similarity reaches the bound."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    shared = F.size(F.array_intersect("ea", "eb"))
    return both.where(shared >= similarity * (F.size("ea") + F.size("eb") - shared) - 1e-9).select("a", "b")


def apart(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs across components that may still be similar, among texts of buckets with several.

    Elements are put in one order, rare ones first. Texts of ``x`` and ``y`` elements that share at
    least ``least`` have a common element among the first ``x - least + 1`` and ``y - least + 1`` of
    that order: their first common one, since the others come after it in both. So only texts that share a rare
    element near their front meet, and no similar pair is lost.
    """
    named = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    split = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    open_texts = staged(named.join(split, "bucket", "left_semi").select("node", "label").distinct(), "open")
    each = sets.join(open_texts, "node", "left_semi").select("node", F.explode("elements").alias("e"))
    often = each.groupBy("e").agg(F.count("*").alias("f")).where("f > 1")
    # Elements of one text only cannot be shared, but they hold the front places.
    ordered = each.join(often, "e", "left").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "e"))).alias("o")
    )
    size = F.size("o")
    front = F.slice("o", 1, size - F.ceil(size * similarity - 1e-9).cast("int") + 1)
    placed = staged(
        ordered.select("node", size.alias("s"), F.posexplode(front).alias("i", "x")).where("x.f > 1")
        .select("node", "s", "i", F.col("x.e").alias("e")).join(open_texts, "node"),
        "fronts",
    )
    other = placed.select("e", F.col("node").alias("a"), F.col("s").alias("sa"), F.col("i").alias("ia"), F.col("label").alias("la"))
    least = F.ceil((F.col("sa") + F.col("s")) * similarity / (1 + similarity) - 1e-9)
    met = placed.join(other, "e").where(
        (F.col("la") < F.col("label")) & (F.col("i") <= F.col("s") - least) & (F.col("ia") <= F.col("sa") - least)
    )
    return met.select("a", F.col("node").alias("b")).distinct()


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after adding links; ``labels`` are those of the links before."""
    if labels is None:
        return staged(components(links, "a", "b"), "labels")
    seen = links
    for side in ("a", "b"):
        seen = (
            seen.join(labels.select(F.col("node").alias(side), "component"), side, "left")
            .withColumn(side, F.coalesce("component", side)).drop("component")
        )
    merged = components(seen, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = labels.join(merged, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = merged.select(F.col("component").alias("node"), F.col("top").alias("component"))
    return staged(moved.unionByName(fresh.join(labels, "node", "left_anti")), "labels")


def near_duplicate_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY,
    weights: str = "binary", rows: int = ROWS, bands: int = BANDS,
) -> DataFrame:
    """(id, ``class_id``, ``n_shingles``) of every row with an id.

    Texts are in one class if links of at least ``similarity`` connect them.
    """
    signed = staged(signatures(docs, id_column, text_column, weights, rows, bands), "signatures")
    texts = signed.groupBy("copy").agg(F.min("id").alias("node"), F.min_by("size", "id").alias("size"))
    # One row per text: only the smallest id of a copy group searches.
    reps = signed.join(texts.select("copy", F.col("node").alias("id")), ["copy", "id"], "left_semi").dropDuplicates(["copy"])
    keyed = staged(reps.select(F.explode("bands").alias("bucket"), F.col("id").alias("node"), "size"), "bands")
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    near = staged(keyed.join(crowded, "bucket"), "crowded")
    # The centre of a bucket is the text that meets most others in all its buckets.
    met = near.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = near.join(met, "node")
    centres = ranked.groupBy("bucket").agg(F.max(F.struct("met", "node", "size")).alias("c"))
    members = staged(
        near.join(centres, "bucket").select("bucket", "node", "size", F.col("c.node").alias("centre"), F.col("c.size").alias("centre_size")),
        "members",
    )
    sets = staged(shingle_sets(docs, id_column, text_column, members.select("node").distinct(), weights), "sets")

    fits = F.expr(f"least(sa, sb) >= {similarity} * greatest(sa, sb) - 1e-9")
    first = (
        members.where("node <> centre")
        .select(F.col("centre").alias("a"), F.col("node").alias("b"), F.col("centre_size").alias("sa"), F.col("size").alias("sb"))
        .where(fits).select("a", "b").distinct()
    )
    labels = _relabelled(None, similar(first, sets, similarity))
    labels = _relabelled(labels, similar(apart(members, labels, sets, similarity), sets, similarity))

    per_copy = texts.join(labels, "node", "left").select("copy", F.coalesce("component", "node").alias("class_id"), "size")
    with_words = signed.select("id", "copy").join(per_copy, "copy").select(
        F.col("id").alias(id_column), "class_id", F.col("size").alias("n_shingles")
    )
    without = docs.where(F.col(id_column).isNotNull()).join(
        with_words.select(id_column).distinct(), id_column, "left_anti"
    ).select(id_column, F.col(id_column).alias("class_id"), F.lit(0).cast("long").alias("n_shingles"))
    return with_words.unionByName(without)


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each class, that of the smallest id; rows without id all stay."""
    kept = near_duplicate_classes(docs, id_column, text_column).where(f"`{id_column}` = class_id").select(id_column).distinct()
    unique = docs.join(kept, id_column, "left_semi").dropDuplicates([id_column])
    return unique.unionByName(docs.where(F.col(id_column).isNull()))


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
