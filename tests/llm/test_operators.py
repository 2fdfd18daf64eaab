"""The operators on small tables with nulls, ties, repeats, empty and long texts, against brute force."""

import collections
import hashlib
import math
import os
import random

import compare
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, minhash, mixing, quality, registry, repair, substrings, token_counts, toxicity, url_filter, warc_zip
from millrace.llm.common import prepare

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, digest string, start int"


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = say(120), say(45)
    texts = [None, "", " \n\t ", "one", "one", " ".join(say(8000)), "x " * 200, ("y z " * 90).strip()]
    texts += [" ".join(base)] * 12
    for n in range(30):
        edited = list(base)
        for _ in range(n % 12):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        texts.append(" ".join(edited))
    texts += [" ".join(say(rng.randint(1, 60)) + passage + say(rng.randint(1, 60))) for _ in range(15)]
    texts += [" ".join(say(rng.randint(1, 90))) for _ in range(40)]
    rows = [(n, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src12", None]), 0, "x", "y", 1) for n, t in enumerate(texts)]
    return [*rows, (None, "no id here", None, None, None, None, None, None), rows[20], rows[3]], passage


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(corpus()[0], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_classes_equal_brute_force(docs):
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    parent = {i: i for i in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingle_set(t) for i, t in rows.items()}
    for a in rows:
        for b in rows:
            both = len(sets[a] & sets[b])
            if a < b and both and both / len(sets[a] | sets[b]) >= 0.8:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    found = minhash.near_duplicate_classes(docs).collect()
    assert len(found) == docs.where("doc_id is not null").count()
    assert {(r.doc_id, r.class_id) for r in found} == {(i, top(i)) for i in rows}
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, i) for i in rows if top(i) == i] + [(True, 0)])


def test_counted_weights_tell_repeats_apart(spark):
    texts = [(1, "a b c d e " * 3), (2, "a b c d e " * 30)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert len({r.class_id for r in minhash.near_duplicate_classes(df).collect()}) == 1
    assert len({r.class_id for r in minhash.near_duplicate_classes(df, weights="count").collect()}) == 2


@pytest.mark.parametrize("hot", [2000, 1])
def test_substrings_equal_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "BUCKET_STRINGS", hot)
    rows = docs.collect()
    expected, seen = [], {}
    for i, text in sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}):
        w = (text or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone |= set(range(k, k + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        times = sum(r.doc_id == i for r in rows)
        expected += [(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] * times
    expected.append((None, 3, 0, hashlib.sha256(b"no id here").hexdigest()))
    found = [tuple(r) for r in substrings.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_statistics_equal_brute_force(docs):
    extra = docs.withColumn("text", F.concat("text", F.lit("\nend | of #lines\n \nend | of #lines")))
    texts = {r.doc_id: r.text for r in extra.collect()}
    for r in quality.statistics(extra).collect():
        text = texts[r.doc_id] or ""
        w = text.encode().split()
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        expected = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected


def test_rules_are_learnt_and_applied(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for n in range(600):
        bad = n % 5 == 0
        w = ["".join(rng.choices("abcdefgh", k=6)) + ("%%%" if bad else "") for _ in range(80)]
        rows.append((n, " ".join(w)))
        labels.append((n, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = quality.judged(docs, spark.createDataFrame([*labels, (5, None)], "doc_id bigint, quality int")).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in found)
    nothing = quality.judged(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert nothing.where("kept and rule is null").count() == 600


def test_edited_passages_are_found(docs, spark):
    passage = corpus()[1]
    edited = [w for n, w in enumerate(passage) if n not in (10, 30)]
    items = [(1, " ".join(passage)), (2, "too short"), (3, None), (4, " ".join(edited)), (None, "a b c d e f g h i")]
    found = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    expected = {r.doc_id for r in docs.collect() if " ".join(passage) in (r.text or "")}
    for item in (1, 4):
        assert {r.doc_id for r in found.where(F.col("item_id") == item).collect()} == expected
    assert found.where("item_id not in (1, 4)").isEmpty()
    assert found.where("item_id = 1 and (similarity < 1 or end_word - start_word <> 45)").isEmpty()


def test_heavily_edited_copies_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(600)]
    weights = [1 / (n + 1) for n in range(600)]
    say = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [say(n) for n in (16, 24, 30, 40, 60)]
    texts = [" ".join(say(rng.randint(0, 300))) for _ in range(60)] + [" ".join(say(5000))]
    for item in items:
        for step, times in ((4, 1), (4, 30), (5, 1), (5, 30), (6, 1), (6, 30), (3, 1)):
            copy = [f"new{rng.random()}" if k % step == step - 1 else w for k, w in enumerate(item)]
            texts += [" ".join(say(40) + copy + say(40)) for _ in range(times)]
        spread = [x for k, w in enumerate(item) for x in ([w, "between"] if k % 2 else [w])]
        texts += [" ".join(spread), " ".join(say(9) + spread + say(9)), " ".join(w for k, w in enumerate(item) if k % 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id bigint, text string")
    expected = {}
    for d, text in enumerate(texts):
        for n, item in enumerate(items):
            score, _ = decontamination.align(decontamination.word_hashes(" ".join(item)), decontamination.word_hashes(text))
            if score >= len(item):
                expected[d, n] = score / (2 * len(item))
    assert len(expected) > 450
    found = decontamination.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == expected


def test_budgets_move_shortages_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 10)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    found = {r.source: r.budget for r in mixing.budgets(df, {}, 0.5, 1).collect()}
    # 1055 tokens: b holds 10 of its half, a gets the rest; s1 gives 100, its sibling s2 the difference.
    assert found == {"s4": 10, "s1": 100, "s2": 422, "s3": 522}
    assert {r.source for r in mixing.budgets(df, {("a", "de"): 0}, 0.1, 1).collect()} >= {"s1", "s2", "s4"}


def test_mixture_keeps_to_budgets(docs):
    found = mixing.mixture(docs, share=0.4, max_epochs=2).collect()
    assert len(found) == docs.count()
    total = sum(r.n_tokens for r in found)
    assert sum(r.copies * r.n_tokens for r in found) <= 0.4 * total + 1e-6
    assert mixing.mixed_documents(docs, 0.5).columns == docs.columns


def test_shards_come_back(docs):
    found = repair.round_trip(docs).collect()
    assert len(found) == docs.count()
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in found), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens


def test_prefix_counts_answer_budgets(docs):
    counted = token_counts.prefix_counts(docs)
    assert counted.count() == docs.count()
    asked = counted.select(
        token_counts.total(F.col("counts")).alias("all"), token_counts.bytes_within(F.col("ends"), F.col("counts"), F.lit(10)).alias("bytes"),
        "ends", "counts", "n_bytes",
    ).collect()
    for r in asked:
        inside = [e for e, c in zip(r["ends"], r["counts"], strict=True) if c <= 10]
        assert r["bytes"] == (max(inside) if inside else 0) and r["all"] == (r["counts"][-1] if r["counts"] else 0)


def test_prefixes_inside_words_are_counted(spark):
    tokenizer = token_counts.load_tokenizer(token_counts.VOCABULARY)
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    texts = ["漢字仮名交じり文" * 9, "xqzvkjw" * 20, "isn't  it’s 42 internationalisation"]
    counted = token_counts.prefix_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    for budget in (3, 8, 20):
        asked = token_counts.bytes_within(F.col("ends"), F.col("counts"), F.lit(budget))
        for r in counted.select("doc_id", asked.alias("bytes"), token_counts.tokens_before(F.col("ends"), F.col("counts"), asked).alias("n")).collect():
            text = texts[r.doc_id]
            longest = max(t for t in (text[:k].rstrip() for k in range(len(text) + 1)) if size(t) <= budget)
            assert (r.bytes, r.n) == (len(longest.encode()), size(longest))


def test_toxic_texts_go(spark):
    rng = random.Random(4)
    w = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(100)]
    rows = [(n, " ".join(rng.choices(w, k=40) + (["vilest"] if n % 3 == 0 else [])), "kept") for n in range(200)] + [(None, None, "x"), (200, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(n, int(n % 3 == 0)) for n in range(200)] + [(3, None)], "doc_id bigint, toxic int")
    left = toxicity.reject_toxic(docs, labels)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert {None, 200} <= ids and sum(i % 3 == 0 for i in ids if i is not None and i < 200) <= 3 and len(ids) > 130


def test_distrust_runs_against_links(spark):
    page = lambda host: f'<a href="http://{host}/x">l</a>'
    rows = [
        (1, "http://bad.net/a", page("far.org")), (2, "http://Fan.org/a?b#c", page("bad.net")), (3, "https://good.example.net/en/x", page("friend.org")),
        (4, "http://friend.org", None), (5, None, page("bad.net")), (6, "no scheme", "x"), (7, "http://far.org/fr/x", None), (2, "http://Fan.org/a?b#c", page("bad.net")),
        (8, "ftp://u.example.com/de/?q", None), (9, "http://notnet/", None), (10, "http://x.net", None),
    ]
    found = collections.defaultdict(list)
    for r in url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect():
        found[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert found[1] == [("bad.net", "/a", "net/", "block")]
    assert found[2] == [("fan.org", "/a", None, "block")] * 2
    assert found[3] == [("good.example.net", "/en/x", "example.net/en/", "allow")]
    assert found[4] == [("friend.org", "", None, "allow")]
    assert found[5] == found[6] == [("", "", None, "allow")]
    assert found[7] == [("far.org", "/fr/x", "org/fr/", "allow")] and found[8][0][2:] == ("example.com/de/", "block")
    assert found[9][0][2:] == (None, "allow") and found[10][0][2:] == (None, "allow")


def test_pages_come_back(spark):
    long = "<p>" + "é" * 700
    rows = [(1, "u", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (None, "u", long), (5, "u", None), (2, "v", long)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = warc_zip.fresh_folder(spark, "test")
    found = warc_zip.read_packages(warc_zip.write_packages(warc_zip.with_revisits(pages), folder, limit=2000)).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in found)
    n = len(long.encode())
    assert kinds == sorted([("1", "revisit", 2, n), ("2", "response", None, n), ("2", "response", None, n), ("3", "response", None, 5), ("4", "response", None, 5), ("5", "response", None, 0), ("None", "response", None, n)], key=str)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for result in (
        minhash.near_duplicate_classes(none), substrings.without_repeats(none), quality.judged(none, labels), toxicity.reject_toxic(none, labels),
        decontamination.contaminated(none, items), mixing.mixture(none), repair.round_trip(none), token_counts.prefix_counts(none), url_filter.judged(pages),
        warc_zip.read_packages(warc_zip.write_packages(warc_zip.with_revisits(pages), warc_zip.fresh_folder(spark, "test"))),
    ):
        assert result.count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, sf_dir, name):
    assert compare.difference(registry.QUERIES[name](spark, sf_dir), compare.connect(sf_dir), registry.SQL[name]) is None


def test_pipeline_keeps_what_it_should(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        left = stage(spark, docs, sf_dir)
        assert left.columns == docs.columns
        ids = {r.doc_id for r in left.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > (0.8 if number < 3 else 0.5) * docs.count()
    result = corpus_pipeline.run(spark, sf_dir)
    assert result.count() > 0 and math.isclose(result.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0], result.agg(F.sum("n_tokens")).first()[0])


def test_network_is_trained_away_from_the_driver(spark, monkeypatch):
    def where(texts, labels, base_rate):
        net = toxicity.Network()
        net.base_rate, net.shift = float(os.getpid()), [*zip(texts, labels, strict=True)]
        return net

    monkeypatch.setattr(toxicity, "train", where)
    docs = spark.createDataFrame([(2, "b"), (1, None), (3, "c"), (2, "a"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels)
    assert net.base_rate != os.getpid()
    assert net.shift == [(None, 0), ("a", 1), ("b", 1)]
