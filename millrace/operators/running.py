"""Running and ranked results over groups that may hold a large share of all rows.

A window over one busy group sends all its rows to one task. Each function here works on
*chunks* of a group (an hour of time, a span of ids) or on salted parts of it, and carries
small summaries between them, so that no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SALTS = 32
_CHUNK = "_chunk"


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` only if a count shows at most ``rows`` rows; else leave it alone.

    For aggregates of large tables, whose size the optimizer overestimates. Plain tables
    need no hint: their file size already decides.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def chunk_offsets(
    df: DataFrame, keys: Sequence[str], chunk: Column, amount: Column
) -> DataFrame:
    """Per group and chunk: the chunk's total, and the total of all chunks before it."""
    totals = df.groupBy(*keys, chunk.alias(_CHUNK)).agg(F.sum(amount).alias("_total"))
    before = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))


def running_total(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column],
    amount: Column, name: str,
) -> DataFrame:
    """Inclusive running sum of ``amount`` along ``order`` within each group."""
    offsets = chunk_offsets(df, keys, chunk, amount).drop("_total")
    inside = (
        W.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    )
    local = df.withColumn(_CHUNK, chunk).withColumn("_run", F.sum(amount).over(inside))
    return (
        local.join(offsets, [*keys, _CHUNK])
        .withColumn(name, F.col("_run") + F.col("_before"))
        .drop(_CHUNK, "_run", "_before")
    )


def previous_marked(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str],
    value: Column, marked: Column, name: str,
) -> DataFrame:
    """The ``value`` of the nearest earlier marked row of the group, null if there is none."""
    position = F.struct(*order)
    last = (
        df.groupBy(*keys, chunk.alias(_CHUNK))
        .agg(F.max_by(F.when(marked, value), F.when(marked, position)).alias("_last"))
    )
    before = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*keys, _CHUNK, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = W.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn(_CHUNK, chunk).withColumn(
        "_near", F.last(F.when(marked, value), ignorenulls=True).over(inside)
    )
    return (
        local.join(carried, [*keys, _CHUNK])
        .withColumn(name, F.coalesce("_near", "_carry"))
        .drop(_CHUNK, "_near", "_carry")
    )


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int,
    spread: Column, rank: str = "rank",
) -> DataFrame:
    """The first ``limit`` rows of each group with their rank, exact under skew.

    ``spread`` (a unique key) salts each group. Every salt keeps its own first rows, so
    at most ``SALTS * limit`` rows of a group meet in the last task.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    partial = W.partitionBy(*keys, "_salt").orderBy(*order)
    final = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_part", F.row_number().over(partial))
        .where(F.col("_part") <= limit)
        .drop("_part", "_salt")
        .withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= limit)
    )


def exact_rank(
    df: DataFrame, keys: Sequence[str], score: str, tie: str, name: str, buckets: float = 64.0
) -> DataFrame:
    """1-based rank by ``score`` descending, then by the text ``tie`` ascending.

    The same as ``row_number`` over each group, but a group is never in one task: equal
    scores are counted first, running sums go over buckets of scores, and rows that tie
    are numbered inside prefixes of ``tie``.
    """
    counts = df.groupBy(*keys, score).agg(F.count("*").alias("_n"))
    bucket = F.floor(-F.col(score) * buckets)
    above = running_total(counts, keys, bucket, [F.col(score).desc()], F.col("_n"), "_upto")
    base = above.select(*keys, score, (F.col("_upto") - F.col("_n")).alias("_above"))
    tied = running_total(
        df, [*keys, score], F.substring(tie, 1, 8), [F.col(tie).asc()], F.lit(1), "_tied"
    )
    return (
        tied.join(base, [*keys, score])
        .withColumn(name, F.col("_above") + F.col("_tied"))
        .drop("_above", "_tied")
    )


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, positions: dict[str, Column], buckets: int = 1024
) -> DataFrame:
    """Values at given 0-based positions of each group's sorted values.

    ``positions`` maps an output name to an expression over ``n``, the group's size.
    Equal values are counted before any shuffle, and value buckets bound each running sum.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    spans = counts.groupBy(*keys).agg(
        F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("_n").alias("n")
    )
    bucket = F.coalesce(
        F.floor(F.try_divide((F.col(value) - F.col("_low")) * buckets, F.col("_high") - F.col("_low"))),
        F.lit(0),
    )
    ranked = running_total(
        counts.join(spans, list(keys)), keys, bucket, [F.col(value)], F.col("_n"), "_upto"
    )
    picked = [
        F.min(F.when(F.col("_upto") > position, F.col(value))).alias(name)
        for name, position in positions.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picked)
