"""Ranked search against brute force, with nulls, ties, copies, long texts and clashing columns."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import ranked_search
from millrace.llm.common import prepare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]


def brute_force(docs, items, best=10):
    counted = [(d, collections.Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, found = collections.Counter(terms_of(text)), []
        for doc, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(q * weight(t) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0 and doc is not None:
                found.append((-score, doc))
        out += [(item, n, doc, -s) for n, (s, doc) in enumerate(sorted(found)[:best], 1)]
    return out


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeÉß9", k=rng.randint(1, 5))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([10, 60, 300])]) for _ in range(n))
    items = [(n, say(rng.randint(1, 30))) for n in range(25)] + [(90, None), (91, ""), (92, " .,;\x7f\x1f"), (None, "a b"), (3, "É9 É9 É9"), (93, "nowhere known")]
    docs = [(n, say(rng.randint(1, 200))) for n in range(400)]
    docs += [(400 + n, items[4][1]) for n in range(40)] + [(500 + n, f"{items[n][1]}. {say(40)}") for n in range(25)]
    docs += [(600, None), (601, ""), (602, " \x00-\x7f."), (None, items[7][1]), (603, say(60_000)), (7, "again " + items[2][1]), (604, "A_B a-b A1b\x7fÀa à")]
    return docs, items


def test_equals_brute_force(spark):
    prepare(spark)
    docs, items = corpus()
    table = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id bigint, text string, score string, rank int, `a.b` int").repartition(5)
    asked = spark.createDataFrame([(*i, "y", 1.0) for i in items], "item_id bigint, text string, doc string, length double")
    wanted = sorted(brute_force(docs, items), key=str)
    for block_bytes in (1 << 20, 300):
        found = ranked_search.search(table, asked, block_bytes=block_bytes)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=str) == wanted


def test_text_ids_and_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BUCKET_ROWS", 16)
    docs, items = corpus()
    docs, items = [(f"d{d:05}" if d is not None else None, t) for d, t in docs], [(f"i{i}", t) for i, t in items if i is not None]
    found = ranked_search.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), best=3)
    assert sorted(map(tuple, found.collect())) == sorted(brute_force(docs, items, 3))


def test_buckets_are_left_out_without_loss():
    """Random vectors of very different lengths: the same best ones as by scoring all, with few scored."""
    rng = np.random.default_rng(1)
    items = ranked_search.Items([" ".join(f"t{k}" for k in rng.choice(60, 6, replace=False)) for _ in range(20)])
    size, heavy = len(items.vocabulary), rng.integers(1, 9, len(items.vocabulary))
    dense = np.where(rng.random((4000, size)) < 0.2, rng.integers(1, 1000, (4000, size)), 0) * rng.choice([1, 5, 25], (4000, 1)) * heavy
    length = np.sqrt((dense.astype(float) ** 2).sum(1))
    order = np.argsort(-length)
    state = ranked_search.Search(items, 10, np.zeros(20, np.int64))
    rows = [(float(length[d]), int(d), np.flatnonzero(dense[d]).tolist(), dense[d][dense[d] > 0].tolist()) for d in order if length[d] > 0]
    kinds = [pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["length", "doc", "terms", "impacts"])
    for start in range(0, batch.num_rows, 200):
        state.bucket(batch.slice(start, 200), heavy)
    for q in range(20):
        scores = dense[:, items.terms[q]] @ items.counts[q]
        best = sorted((-int(s), d) for d, s in enumerate(scores) if s > 0)[:10]
        assert [(-int(s), int(d)) for s, d in zip(state.scores[q], state.docs[q], strict=True)] == best
    assert state.left_out > 0.3 * 20 * len(rows) and state.scored < 0.3 * 20 * len(rows)


def test_wide_buckets_are_halved(monkeypatch, spark):
    monkeypatch.setattr(ranked_search, "BUCKET_CELLS", 200)
    docs, items = corpus()
    found = ranked_search.search(spark.createDataFrame(docs[:80], "doc_id bigint, text string"), spark.createDataFrame(items[:5], "item_id bigint, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(brute_force(docs[:80], items[:5]))


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, text string")
    item, nothing = some.toDF("item_id", "text"), none.toDF("item_id", "text")
    for docs, items in ((none, item), (some, nothing), (none, nothing), (some.withColumn("text", F.lit(None).cast("string")), item)):
        assert ranked_search.search(docs, items).collect() == []
