"""Line dedup: lines that many documents share stay in the last document only, told by keep bitmaps.

A line's key is the line without white space at its ends, ASCII letters lower-cased. Keys of at least
``key_length`` code points that at least ``min_documents`` documents hold are common; all lines of a
common key go, except in the document of the largest id that holds it.

Only 128-bit hashes of keys travel, with the document and the place of the line. They are dealt out by
ranges of (hash, slice of the document id), so that a line of a third of all documents fills many
ranges, and sorted within by document, latest first, and place. One stream over each range marks the
first line that each document adds to a hash; sums of these marks over the slices give the number of
documents and the latest one. What is lost returns as one bitmap for each document, compressed to
runs of dropped lines; texts are read again only to apply it.

Cases: null and empty texts are one empty line. Documents are told apart by id: rows of one id count as
one document, and rows without id as one document before all others. Rows of one id with different
texts have bitmaps of their own; equal rows share one. Empty tables give empty results. Other columns
pass through :func:`without_shared_lines` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import SPACE_CHARACTERS, column, free_name, table
from millrace.session import staged

KEY_LENGTH = 40
MIN_DOCUMENTS = 5
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_array(text: Column) -> Column:
    """The lines of a text between line feeds; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_mark(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, id_column: str, text_column: str, key_length: int) -> DataFrame:
    """(``h1``, ``h2``, ``doc``, ``row``, ``place``) of every line whose key is long enough."""
    text = column(text_column)
    lines = docs.select(column(id_column).alias("doc"), row_mark(text).alias("row"), F.posexplode(line_array(text)).alias("place", "line"))
    bare = lines.withColumn("line", F.btrim("line", F.lit(SPACE_CHARACTERS))).where(F.char_length("line") >= key_length)
    key = F.translate("line", _CAPITALS, _SMALL)
    return bare.select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "doc", "row", "place")


def streamed(hashes: DataFrame) -> DataFrame:
    """The hashes in ranges, with ``fresh`` 1 at the first line that a document adds to a hash."""
    slices = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = hashes.withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(slices))).repartitionByRange("h1", "h2", "slice")
    order = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc_nulls_last("doc"), "row", "place")
    again = (F.row_number().over(order) > 1) & F.lag("doc").over(order).eqNullSafe(F.col("doc"))
    return ranged.select("h1", "h2", "doc", "row", "place", F.when(again, 0).otherwise(1).alias("fresh"))


def runs_of(places: Column) -> Column:
    """An ascending array of places as runs (``first``, ``last``) of consecutive places."""
    firsts = F.filter(places, lambda x, i: (i == 0) | (F.get(places, i - 1) != x - 1))
    lasts = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != x + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def drop_bitmaps(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    key_length: int = KEY_LENGTH, min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """(``doc``, ``row``, ``dropped``) of documents that lose a line; all lines outside the runs stay."""
    hashes = staged(line_hashes(docs, id_column, text_column, key_length), "hashes")  # the ranges are sampled from it
    lines = staged(streamed(hashes), "lines")
    counted = lines.groupBy("h1", "h2").agg(F.sum("fresh").alias("n"), F.max("doc").alias("latest"))
    # Written first: the join can then split the lines of a common hash among tasks.
    common = staged(counted.where(F.col("n") >= min_documents).drop("n"), "common")
    lost = lines.join(common, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("latest")))
    places = lost.groupBy("doc", "row").agg(F.sort_array(F.collect_set("place")).alias("places"))
    return places.select("doc", "row", runs_of(F.col("places")).alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The text without the lines of the runs ``dropped``; null runs drop nothing."""
    lines = line_array(text)
    gone = F.flatten(F.transform(dropped, lambda run: F.sequence(run["first"], run["last"])))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    )


def _with_bitmaps(docs: DataFrame, id_column: str, text_column: str, **options: int) -> tuple[DataFrame, str]:
    """The documents with their runs, and the name of that column."""
    runs, doc, row = (free_name(name, docs.columns) for name in ("dropped", "doc", "row"))
    bitmaps = drop_bitmaps(docs, id_column, text_column, **options).toDF(doc, row, runs)
    same = column(id_column).eqNullSafe(column(doc)) & (row_mark(column(text_column)) == column(row))
    return docs.join(bitmaps, same, "left").drop(doc, row), runs


def without_shared_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: int) -> DataFrame:
    """The documents with their texts less the lost lines; same columns and rows."""
    marked, runs = _with_bitmaps(docs, id_column, text_column, **options)
    return marked.withColumn(text_column, kept_text(column(text_column), column(runs))).select(*map(column, docs.columns))


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, runs = _with_bitmaps(docs, "doc_id", "text")
    lost = F.aggregate(F.coalesce(runs, F.array()), F.lit(0), lambda n, run: n + run["last"] - run["first"] + 1)
    return marked.select(
        "doc_id",
        F.size(line_array(F.col("text"))).cast("long").alias("n_lines"),
        lost.cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col(runs)), 256).alias("kept_sha256"),
    )


SQL = {
    "op12_line_dedup": f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_CAPITALS}', '{_SMALL}') AS key
    FROM lines
), common AS (
    SELECT key, max(doc_id) AS latest FROM keyed WHERE length(key) >= {KEY_LENGTH}
    GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}
), judged AS (
    SELECT k.doc_id, k.place, k.line, coalesce(k.doc_id <> c.latest, false) AS gone
    FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
}
