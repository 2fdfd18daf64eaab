"""Line dedup against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm import line_dedup
from millrace.llm.common import prepare

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id bigint, text string, dropped string, doc int, row int, `a.b` int, place int, line string"


def key_of(line):
    bare = line.strip(SPACES)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare) if len(bare) >= 40 else None


def brute_force(rows):
    """Kept text and number of dropped lines of each row."""
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(doc)
    last = {k: max(d for d in ds if d is not None) for k, ds in holders.items() if k and len(ds) >= 5}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in last or last[key_of(x)] == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus():
    rng = random.Random(3)
    shared = ["The Same Line of Forty Code points or more " + "é" * n for n in range(6)]
    shared += ["short line in all", "ends exactly at 40 code points: 1234567é", "K" * 39 + "K", "\x1d" + "u" * 39]
    rows = []
    for n in range(80):
        lines = [f"own line of document {n} with some words {rng.random()}" for _ in range(rng.randrange(4))]
        for line in rng.sample(shared, 4):
            lines += [rng.choice(SPACES.replace("\n", "")) + (line.upper() if rng.random() < 0.3 and line.isascii() else line)] * rng.choice([1, 1, 2])
        rng.shuffle(lines)
        rows.append((n, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, shared[0]), (None, shared[0] + "\n" + shared[1]), (79, shared[0]), (79, shared[0]), (3, "x\n" + shared[2])]
    rows += [(200, "\n".join([shared[0], "between"] * 20_000)), (201, shared[3])]
    return rows


def test_equals_brute_force(spark):
    prepare(spark)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "d", 1, 2, 3, 4, "l") for r in rows], SCHEMA)
    found = line_dedup.without_shared_lines(docs)
    assert found.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(((d, t) for d, t, _, _ in brute_force(rows)), key=str)
    assert {tuple(r)[2:] for r in found.collect()} == {("d", 1, 2, 3, 4, "l")}


def test_query_gives_counts_and_digests(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(*r, "d", 1, 2, 3, 4, "l") for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = line_dedup.op12_line_dedup(spark, str(tmp_path)).collect()
    wanted = [(d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, gone in brute_force(rows)]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


def test_bitmaps_are_runs(spark):
    line = "a line that is repeated in each of these documents"
    rows = [(n, "\n".join([line] * 1000 + ["own"] + [line] * 500)) for n in range(6)]
    runs = line_dedup.drop_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc: [tuple(x) for x in r.dropped] for r in runs} == {n: [(0, 999), (1001, 1500)] for n in range(5)}


def test_a_hot_line_fills_many_ranges(spark):
    line = "a line that stands in each and every document there is"
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(line).alias("text"))
    ranged = line_dedup.streamed(line_dedup.line_hashes(docs, "doc_id", "text", 40))
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 2000


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, extra int")
    assert line_dedup.without_shared_lines(none).count() == 0 and line_dedup.drop_bitmaps(none).count() == 0
