"""Token, chunk and vector expressions for retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions.text import fold, let


def _bigrams(run: Column) -> Column:
    """Overlapping pairs of a CJK run; a lone character gives nothing."""
    starts = F.when(F.length(run) > 1, F.sequence(F.lit(1), F.length(run) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.substr(run, i, F.lit(2)))


def token_array(text: Column) -> Column:
    """Tokens of a text in order: ASCII words, and bigrams of CJK runs.

    The CJK branch works token by token; text without CJK, tested once, skips it.
    """
    words = F.regexp_extract_all(fold(text), F.lit(fixed.TERM_PATTERN), F.lit(0))
    split = F.flatten(
        F.transform(
            words,
            lambda w: F.when(w.rlike(fixed.CJK_PATTERN), _bigrams(w)).otherwise(F.array(w)),
        )
    )
    kept = F.filter(split, lambda w: ~w.isin(*fixed.STOP_TERMS))
    return F.when(text.rlike(fixed.CJK_PATTERN.lstrip("^")), kept).otherwise(words)


def token_counts(tokens: Column) -> Column:
    """Array of ``struct(term, tf)`` from a token array, inside the row.

    Sorting puts equal tokens side by side, so run lengths are the counts and no shuffle
    is needed to build a chunk's bag of words.
    """
    empty = F.array().cast("array<struct<term:string,tf:int>>")

    def run_starts(ordered: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(ordered) - 1)
        return F.filter(
            positions, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        )

    def run_lengths(ordered: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, n: F.struct(
                F.get(ordered, at).alias("term"),
                (F.coalesce(F.get(starts, n + 1), F.size(ordered)) - at).cast("int").alias("tf"),
            ),
        )

    def count(ordered: Column) -> Column:
        runs = let(run_starts(ordered), lambda starts: run_lengths(ordered, starts))
        return F.when(F.size(ordered) > 0, runs).otherwise(empty)

    return let(F.sort_array(tokens), count)


def chunk_array(content: Column) -> Column:
    """Array of ``struct(index, start, end, text)`` with absolute character offsets."""
    length = F.length(content)
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(fixed.CHUNK_STEP))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts,
        lambda at, n: F.struct(
            n.cast("int").alias("index"),
            at.alias("start"),
            F.least(at + fixed.CHUNK_LENGTH, length).alias("end"),
            F.substr(content, at + 1, F.lit(fixed.CHUNK_LENGTH)).alias("text"),
        ),
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine in double; 0 for unequal sizes, empty or zero vectors."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    norm = F.sqrt(dot(left, left) * dot(right, right))
    usable = (F.size(left) == F.size(right)) & (F.size(left) > 0) & (norm > 0)
    return F.coalesce(F.when(usable, dot(left, right) / norm), F.lit(0.0))


def valid_vector(vector: Column) -> Column:
    """A usable embedding: bounded size, finite everywhere, not all zero."""
    return F.coalesce(
        F.size(vector).between(1, fixed.MAX_VECTOR_SIZE)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def inverse_frequency(chunks: Column, frequency: Column) -> Column:
    return F.log(1 + (chunks - frequency + 0.5) / (frequency + 0.5))


def term_weight(tf: Column, length: Column, average_length: Column) -> Column:
    """The saturation part of BM25 for one term of one chunk."""
    norm = (1 - fixed.BM25_B) + fixed.BM25_B * length / F.greatest(F.lit(1.0), average_length)
    return tf * (fixed.BM25_K1 + 1) / (tf + fixed.BM25_K1 * norm)


def evidence_id(document_id: Column, version: Column, index: Column) -> Column:
    return F.concat(
        F.lit("doc:"), document_id.cast("string"), F.lit(":v"), version.cast("string"),
        F.lit(":c"), index.cast("string"),
    )
