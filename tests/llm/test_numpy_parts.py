"""Parts that need no session: signatures, grammars, archives, alignment, tokens, the network."""

import io
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import decontamination, minhash, repair, substrings, toxicity, warc_zip
from millrace.llm import pieces
from millrace.llm.pieces import BytePieces, WordPieces
from millrace.llm.token_counts import PrefixPieces, WordPrefixes, _ends

ALPHABET = ["a", "B", " ", "  ", "\n", "\t", "\x0b", "\x85", "\xa0", "'s", "9", "é", "́", "Σ", "漢字", "<|endoftext|>", "!", "$%", "İ", "the", "\r"]
odd_texts = st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join)


@pytest.fixture(scope="module")
def byte_pieces():
    return BytePieces("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_pieces():
    return WordPieces("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.lists(odd_texts, min_size=1, max_size=5))
def test_byte_pieces_equal_the_library(byte_pieces, texts):
    expected = [e.ids for e in byte_pieces.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in byte_pieces.encode(texts)] == expected


@settings(max_examples=300, deadline=None)
@given(odd_texts)
def test_word_pieces_equal_the_library(word_pieces, text):
    expected = len(word_pieces.tokenizer.encode(text, add_special_tokens=False).ids)
    assert sum(word_pieces.counts([text.encode().split()])[0]) == expected


def test_counts_of_every_prefix_of_a_word(word_pieces):
    prefixes = WordPrefixes()
    for word in ("worthless", "tokenization", "xqzzz", "a", "internationalisation"):
        expected = [len(word_pieces.tokenizer.encode(word[:n], add_special_tokens=False).ids) for n in range(1, len(word) + 1)]
        assert prefixes.counts(word) == expected


@pytest.fixture(scope="module")
def prefix_pieces():
    return PrefixPieces("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(st.one_of(odd_texts, st.text(max_size=30)))
def test_counts_of_every_prefix_of_a_text(prefix_pieces, text):
    raw = text.encode("utf-8", "replace")
    expected = [len(prefix_pieces.tokenizer.encode(raw[:e].decode(), add_special_tokens=False).ids) for e in _ends(raw).tolist()]
    assert prefix_pieces.counts([raw.split()])[0].tolist() == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_grammar_expands_to_the_tokens(tmp_path_factory, tokens, a, b):
    tokens = np.array(tokens, "<u4")
    rules, lengths, symbols = repair.compress(tokens, 10, min_count=2, passes=6)
    assert repair.expand(symbols, rules, 10).tolist() == tokens.tolist()
    assert all(repair.expand(np.array([10 + n]), rules, 10).size == size for n, size in enumerate(lengths))


def test_grammar_leaves_no_pair_twice():
    rng = np.random.default_rng(5)
    phrase = rng.integers(1, 90, 64)
    for tokens in (np.tile(phrase, 3), rng.integers(0, 6, 3000), np.zeros(1000, int), np.r_[phrase, 7, phrase]):
        rules, _, symbols = repair.compress(tokens.astype("<u4"), 100)
        assert repair.expand(symbols, rules, 100).tolist() == tokens.tolist()
        last = {}
        for at, pair in enumerate(zip(symbols.tolist(), symbols.tolist()[1:], strict=False)):
            assert at - last.setdefault(pair, at) <= 1  # two of a run overlap


def test_shard_gives_any_document(tmp_path):
    rng = np.random.default_rng(3)
    docs = [np.tile(rng.integers(1, 20, 7), n).astype("<u4") for n in (0, 1, 50, 3, 200)]
    starts = np.cumsum([0] + [len(d) for d in docs]).tolist()
    path = tmp_path / "x.rpg"
    path.write_bytes(repair.shard_bytes([5, 6, 7, 8, None], starts[:-1], np.concatenate(docs), 100))
    shard = repair.Shard(str(path))
    assert shard.ids == [5, 6, 7, 8, None] and len(shard.rules) > 0
    for n, doc in enumerate(docs):
        assert shard.document(n).tolist() == doc.tolist()


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa = rng.integers(1, 6, 300).astype(float)
    wb = wa.copy()
    wb[:120] = rng.integers(1, 6, 120)
    k = 2000
    same = (minhash.dart_signature(a, wa, k) == minhash.dart_signature(a, wb, k)).mean()
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs(same - true) < 4 * (true * (1 - true) / k) ** 0.5


def test_alignment_counts_matches_mismatches_and_gaps():
    item = np.arange(10)
    assert decontamination.align(item, np.arange(10)) == (20, 10)
    edited = np.array([50, 0, 1, 2, 99, 4, 5, 6, 8, 9, 51])  # one exchanged, one left out
    score, end = decontamination.align(item, edited)
    assert (score, end) == (2 * 8 - 1 - 1, 10)


def test_super_kmers_hold_every_window_once():
    rng = random.Random(5)
    for words in ([rng.randrange(4) for _ in range(300)], [1] * 50, list(range(20))):
        hashed = minhash.mix(np.array(words, np.uint64))
        mini, first, count, held = substrings.super_kmers(hashed, 20, 7)
        assert first[0] == 0 and (np.diff(first) == count[:-1]).all() and first[-1] + count[-1] == len(words) - 19
        assert (held >= 1).all()


def package(names: dict[str, bytes], **how) -> warc_zip.Package:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in names.items():
            with z.open(name, "w", force_zip64=how.get("zip64", False)) as f:
                f.write(content)
        z.comment = how.get("comment", b"")
    raw = out.getvalue()

    class Source:
        def size(self):
            return len(raw)

        def read_at(self, length, offset):
            return raw[offset : offset + length]

    return warc_zip.Package(Source())


@pytest.mark.parametrize("zip64", [False, True])
def test_members_are_ranges(zip64):
    p = package({"a": b"x" * 10, "dir/b": b"0123456789"}, zip64=zip64, comment=b"note PK\x05\x06 inside")
    assert p.read("dir/b", 3, 4) == b"3456" and p.read("a") == b"x" * 10
    with pytest.raises(ValueError):
        p.read("a", 5, 6)


def test_zip64_directory_with_very_many_members():
    names = {f"m{n}": b"" for n in range(66_000)} | {"last": b"end"}
    p = package(names)
    assert len(p.members) == 66_001 and p.read("last") == b"end"


def test_records_come_back():
    payload = "Grüße\r\n\r\n<p>".encode()
    digest = __import__("hashlib").sha1(payload).hexdigest()
    r = warc_zip.parse(warc_zip.record(7, "http://a.b/c d\r\nX: y", payload, digest))
    assert (r.page_id, r.type, r.payload, r.digest, r.refers_to) == ("7", "response", payload, digest, None)
    v = warc_zip.parse(warc_zip.record(6, None, payload, digest, 7))
    assert (v.type, v.payload, v.payload_bytes, v.refers_to, v.url) == ("revisit", None, len(payload), "7", None)
    with pytest.raises(ValueError):
        warc_zip.parse(warc_zip.record(7, None, payload + b"x", digest))


def test_network_learns_a_word_and_scores_long_texts():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]

    def text(n, bad):
        w = [rng.choice(vocabulary) for _ in range(n)]
        if bad:
            w[rng.randrange(n)] = "vilest,"
        return " ".join(w)

    texts = [text(rng.randint(5, 150), n % 4 == 0) for n in range(240)]
    net = toxicity.train(texts, [int(n % 4 == 0) for n in range(240)], 0.25, epochs=4)
    scorer = toxicity.Scorer(net)
    test = [text(5000, True), text(5000, False), "", None, "!!!", text(30, True), text(30, False)]
    scores = scorer.score(test)
    assert scores[0] > 0.5 > scores[1] and scores[5] > 0.5 > scores[6]
    assert scores[2] == scores[3] == scores[4] == 0.25
    assert toxicity.Scorer(toxicity.train([], [], 0.0)).score(["a"])[0] == 0


def test_gradients_match_differences():
    net = toxicity.Network(1)
    g = toxicity.hashed([b"aa", b"bcd", b"efgh", b"z"])
    ids, lengths = np.array([[0, 1, 2, 4], [3, 2, 1, 0]]), np.array([3, 4])

    def loss():
        pf, pb = net.projected(net.inputs(g))
        return float((net.forward(pf, pb, ids, lengths)[0] * np.array([1.0, -0.5])).sum())

    pf, pb = net.projected(net.inputs(g))
    _, saved = net.forward(pf, pb, ids, lengths, keep=True)
    grad, _ = net.backward(saved, np.array([1.0, -0.5], np.float32), 4)
    for name in ("uf", "ub", "wa", "va", "wo"):
        at = tuple(0 for _ in net.p[name].shape)
        before, step = net.p[name][at], 1e-2
        net.p[name][at] = before + step
        high = loss()
        net.p[name][at] = before - step
        low = loss()
        net.p[name][at] = before
        assert abs((high - low) / (2 * step) - grad[name][at]) < 5e-3


@pytest.mark.parametrize("counted", [False, True])
def test_signatures_do_not_depend_on_the_texts_beside(counted):
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 900, 5, 40, 1)]
    weights = [rng.integers(1, 9, len(s)).astype(float) if counted else np.ones(len(s)) for s in sets]
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    together = minhash.dart_signatures(np.concatenate(sets), np.concatenate(weights), owners, len(sets), 112)
    keys = minhash.band_keys(together, 4, 28)
    for n, (s, w) in enumerate(zip(sets, weights, strict=True)):
        alone = minhash.dart_signature(s, w, 112)
        assert (together[n] == alone).all()
        assert (keys[n] == minhash.band_keys(alone, 4, 28)).all()


def test_a_shard_is_compressed_within_a_bound_of_memory():
    import tracemalloc

    tokens = (np.random.default_rng(3).zipf(1.3, 1 << 18) % 5000).astype("<u4")
    tracemalloc.start()
    rules, _, symbols = repair.compress(tokens, 5000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 85 * len(tokens)
    assert repair.expand(symbols, rules, 5000).tolist() == tokens.tolist()


@pytest.mark.parametrize("bits", [34, 62])
def test_keys_are_ordered_by_value_then_place(bits):
    keys = np.random.default_rng(1).integers(0, 1 << bits, 500).repeat(3).astype(np.uint64)
    np.random.default_rng(2).shuffle(keys)
    order, ordered = repair._in_order(keys, bits)
    assert order.tolist() == sorted(range(len(keys)), key=lambda n: (int(keys[n]), n))
    assert ordered.tolist() == sorted(keys.tolist())


def test_pieces_of_two_workers_leave_room_on_an_executor():
    assert 2 * 2 * 200 * pieces.KEPT_PIECES <= 500e6


lines = st.lists(
    st.sampled_from(["the", "The", "É", "éa", "x.", "a,", "'s", "9", "$%", "\n", "\nB", ".\nB", "a\nThe,", "\n\n", "\r\n", " ", " ", " ", "  ", "\xa0", "<|endoftext|>"]),
    max_size=30,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), lines), min_size=1, max_size=6), st.sampled_from([pa.string(), pa.large_string()]))
def test_a_column_of_texts_has_the_ids_of_the_library(byte_pieces, texts, kind):
    expected = [e.ids for e in byte_pieces.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    column = pa.array(["a  b c", *texts, "d"], kind).slice(1, len(texts))
    for size in (1, 20, pieces.GROUP_BYTES):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(pieces, "GROUP_BYTES", size)
            assert [np.frombuffer(b, "<u4").tolist() for b in byte_pieces.encode(column)] == expected


def test_letters_are_learnt_once_whatever_stands_around_them():
    own = BytePieces("byte_bpe_50k.json")
    words = ["stone", "rivér", "Cloud"]
    text = "x " + " ".join(w + after for w in words for after in ("", ",", ".", "?!", ".\nCloud", ",\nCloud", "\nCloud"))
    assert list(own.encode([text])) == [np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert set(own.kept) == {*words, "\nCloud"}


def test_pieces_in_use_survive_a_new_generation(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PIECES", 20)
    own = BytePieces("byte_bpe_50k.json")
    texts = [f"x the {'a' * n} {'b' * n}, {'c' * (n % 7)}." for n in range(1, 60)]
    encoded = [list(own.encode([text]))[0] for text in texts]
    assert encoded == [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert "the" in own.kept and len(own.kept) <= 20


def test_batches_come_together_with_the_same_rows(monkeypatch):
    monkeypatch.setattr(repair, "GROUP_BYTES", 100)
    batches = [pa.RecordBatch.from_pydict({"id": [n, None], "text": ["x" * n, None]}) for n in range(40)]
    together = list(repair._together(iter(batches)))
    assert len(together) < 40 and all(b.nbytes >= 100 for b in together[:-1])
    assert pa.Table.from_batches(together).equals(pa.Table.from_batches(batches).combine_chunks())
    assert list(repair._together(iter([]))) == []


def test_passes_leave_pairs_alone_that_are_too_rare(monkeypatch):
    looked, about = [], repair._about
    monkeypatch.setattr(repair, "_about", lambda first, *rest: looked.append(len(first)) or about(first, *rest))
    tokens = np.random.default_rng(6).integers(0, 300, 200_000).astype("<u4")
    rules, lengths, symbols = repair.compress(tokens, 300)
    assert sum(looked) < 2.6 * len(tokens)
    assert np.array_equal(repair.expand(symbols, rules, 300, lengths), tokens)


@pytest.mark.parametrize("times", [1, 40])
def test_rules_opened_once_give_the_same_tokens(times):
    rules = np.array([[1, 2], [10, 10], [11, 3], [12, 11]])
    lengths = np.array([2, 4, 5, 9], "<u4")
    symbols = np.array([13, 0, 12, 9, 10] * times)
    level_by_level = repair.expand(symbols, rules, 10)
    assert repair.expand(symbols, rules, 10, lengths).tolist() == level_by_level.tolist()
    assert len(level_by_level) == 18 * times
