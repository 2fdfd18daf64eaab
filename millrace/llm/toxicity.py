"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a word embedding (hashed) joined with the mean embedding of its character
n-grams, plus log-odds of both in the training texts. A network of ``HIDDEN`` units in each
direction reads windows of ``WINDOW`` words that overlap by a quarter; attention pools the states
of a window to one logit. A text scores as its highest window, so that length does not dilute a
short insult. The network is trained in one task over a bounded sample of labelled texts
(``max_per_class`` of each label, a documented parameter); everything else runs on the executors.

Cases: null, empty and punctuation-only texts have no words and get the base rate of the labels.
Very long texts are scored window by window with fixed memory. Rows are never dropped or merged;
extra columns pass through, and ``score_column`` must be a name that the table does not have.
Labels that are null, or that repeat for a document in contradiction, are left out of training.
Without labels of both kinds, every text gets the base rate (0 without any labels).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import plain_words, table

WINDOW = 64
STRIDE = 48
HIDDEN = 8
EMBED = 8
BUCKETS = 8192
GRAMS = (3, 4, 5, 6)
KEPT_WORDS = 150_000
BATCH_WINDOWS = 4096
VOCABULARY_BLOCK = 20_000
BATCH = 64
MIN_STEPS = 240

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


@dataclass
class Grams:
    """Hash buckets of words and of their character n-grams; ``starts`` marks each word's first gram."""

    word: np.ndarray
    gram: np.ndarray
    starts: np.ndarray
    counts: np.ndarray


def hashed(vocabulary: list[bytes]) -> Grams:
    """Buckets of all words, a block of the vocabulary at a time to bound memory."""
    blocks = [_hashed(vocabulary[k : k + VOCABULARY_BLOCK]) for k in range(0, len(vocabulary), VOCABULARY_BLOCK)]
    counts = np.concatenate([b.counts for b in blocks])
    return Grams(
        np.concatenate([b.word for b in blocks]), np.concatenate([b.gram for b in blocks]), np.cumsum(counts) - counts, counts
    )


def _hashed(vocabulary: list[bytes]) -> Grams:
    """Buckets for every word at once: rolling hashes over the joined bytes ``^word$``."""
    joined = np.frombuffer(b"".join(b"^" + w + b"$" for w in vocabulary), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter((len(w) + 2 for w in vocabulary), np.int64, len(vocabulary))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(vocabulary)), sizes)
    rolled, grams, owners = np.zeros(len(joined), np.uint64), [], []
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            room = len(joined) - n + 1
            if room <= 0:
                break
            rolled = rolled[:room] * _ODD + joined[n - 1 :]
            if n in GRAMS:
                inside = owner[:room] == owner[n - 1 :]
                grams.append(_scramble(rolled[inside]))
                owners.append(owner[:room][inside])
        # A word's own hash: position-weighted sum of its bytes.
        place = (np.arange(len(joined)) - np.repeat(begins, sizes)).astype(np.uint64)
        weighted = _scramble((joined + (place << np.uint64(9))) * _ODD)
        word = _scramble(np.add.reduceat(weighted, begins))
    owner_of = np.concatenate(owners)
    order = np.argsort(owner_of, kind="stable")
    counts = np.bincount(owner_of, minlength=len(vocabulary))
    buckets = np.uint64(BUCKETS)
    return Grams(
        (word % buckets).astype(np.uint16),
        (np.concatenate(grams)[order] % buckets).astype(np.uint16),
        np.cumsum(counts) - counts,
        counts,
    )


def spans(n_words: int) -> list[tuple[int, int]]:
    """Windows that cover every word and overlap by ``WINDOW - STRIDE``."""
    if n_words <= WINDOW:
        return [(0, n_words)]
    return [(s, min(n_words, s + WINDOW)) for s in range(0, n_words - WINDOW + STRIDE, STRIDE)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Parameters and passes of the network; rows of ``x`` are words, the last row is padding."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        inputs = 2 * EMBED + 4

        def small(*shape):
            return rng.normal(0, 0.25, shape).astype(np.float32)

        self.p = {
            "words": small(BUCKETS, EMBED) * np.float32(0.2),
            "grams": small(BUCKETS, EMBED) * np.float32(0.2),
            "wf": small(inputs, 3 * HIDDEN), "uf": small(HIDDEN, 3 * HIDDEN),
            "wb": small(inputs, 3 * HIDDEN), "ub": small(HIDDEN, 3 * HIDDEN),
            "wa": small(2 * HIDDEN, HIDDEN), "va": small(HIDDEN),
            "wo": small(2 * HIDDEN), "bo": np.zeros(1, np.float32),
        }
        self.odds_word = np.zeros(BUCKETS, np.float32)
        self.odds_gram = np.zeros(BUCKETS, np.float32)
        self.shift = 0.0
        self.base_rate = 0.0
        self.trained = False

    def inputs(self, g: Grams) -> np.ndarray:
        """One row for each word of a vocabulary, a block of words at a time."""
        if len(g.word) <= VOCABULARY_BLOCK:
            return self._inputs(g)
        rows = []
        for k in range(0, len(g.word), VOCABULARY_BLOCK):
            part = slice(k, k + VOCABULARY_BLOCK)
            first, counts = g.starts[part], g.counts[part]
            rows.append(self._inputs(Grams(g.word[part], g.gram[first[0] : first[-1] + counts[-1]], first - first[0], counts)))
        return np.vstack(rows)

    def _inputs(self, g: Grams) -> np.ndarray:
        n = np.maximum(g.counts, 1)[:, None].astype(np.float32)
        gram_rows = np.add.reduceat(self.p["grams"][g.gram], g.starts, axis=0) / n
        odds = self.odds_gram[g.gram]
        return np.hstack(
            [
                self.p["words"][g.word], gram_rows,
                self.odds_word[g.word][:, None],
                np.add.reduceat(odds, g.starts)[:, None] / n,
                np.maximum.reduceat(odds, g.starts)[:, None],
                np.ones((len(g.word), 1), np.float32),
            ]
        ).astype(np.float32)

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs times the input weights of both directions, with a padding row at the end
        whose update gate keeps the state as it is."""
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[0, :HIDDEN] = 40
        return np.vstack([x @ self.p["wf"], pad]), np.vstack([x @ self.p["wb"], pad])

    @staticmethod
    def _run(proj: np.ndarray, u: np.ndarray, ids: np.ndarray, order, keep: bool):
        h = np.zeros((len(ids), HIDDEN), np.float32)
        states, cache = np.empty((ids.shape[1], len(ids), HIDDEN), np.float32), []
        for t in order:
            xs, hu = proj[ids[:, t]], h @ u
            zr = _sigmoid(xs[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r, hn = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
            n = np.tanh(xs[:, 2 * HIDDEN :] + r * hn)
            if keep:
                cache.append((t, h, z, r, n, hn))
            h = n + z * (h - n)
            states[t] = h
        return states, cache

    def forward(self, pf, pb, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows; ``ids`` index the rows of the projections."""
        steps = range(ids.shape[1])
        hf, cf = self._run(pf, self.p["uf"], ids, steps, keep)
        hb, cb = self._run(pb, self.p["ub"], ids, reversed(steps), keep)
        h = np.concatenate([hf, hb], axis=2)
        a = np.tanh(h @ self.p["wa"])
        e = a @ self.p["va"]
        e = np.where(np.arange(ids.shape[1])[:, None] < lengths[None, :], e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[:, :, None] * h).sum(axis=0)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return logit, (h, a, weight, pooled, cf, cb)

    def backward(self, saved, d_logit: np.ndarray, pads: int):
        """Gradients of the weights and of the projections of every step."""
        h, a, weight, pooled, cf, cb = saved
        g = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * self.p["wo"]
        dh = weight[:, :, None] * d_pool
        d_weight = (h * d_pool).sum(axis=2)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = np.tensordot(d_e, a, ((0, 1), (0, 1)))
        d_a = d_e[:, :, None] * self.p["va"] * (1 - a * a)
        g["wa"] = np.tensordot(h, d_a, ((0, 1), (0, 1)))
        dh = dh + d_a @ self.p["wa"].T
        out = []
        for u, cache, part in (("uf", cf, dh[:, :, :HIDDEN]), ("ub", cb, dh[:, :, HIDDEN:])):
            du, carry = np.zeros_like(self.p[u]), np.zeros_like(part[0])
            dx = np.zeros((*part.shape[:2], 3 * HIDDEN), np.float32)
            for t, before, z, r, n, hn in reversed(cache):
                d = part[t] + carry
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (before - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dx[t] = np.hstack([dz, dr, dn])
                d_hu = np.hstack([dz, dr, dn * r])
                du += before.T @ d_hu
                carry = d * z + d_hu @ self.p[u].T
            g[u] = du
            out.append(dx)
        return g, out


def log_odds(buckets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Shrunk log-odds that a text with a bucket is toxic, from text frequencies."""
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    c1, c0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, y in zip(buckets, labels, strict=True):
        (c1 if y else c0)[np.unique(b)] += 1
    raw = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    seen = c1 + c0
    return (raw * seen / (seen + 5)).astype(np.float32)


def train(texts: list[str], labels: list[int], base_rate: float, epochs: int = 10, seed: int = 7) -> Network:
    """Fit the network to labelled texts.

    Every few epochs pick the highest window of each text under the current weights (any window of a
    text can be the toxic one); each epoch fits these windows in small batches with Adam.
    """
    net = Network(seed)
    net.base_rate = float(base_rate)
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return net
    rng = np.random.default_rng(seed)
    rows: dict[bytes, int] = {}
    encoded = [np.array([rows.setdefault(w, len(rows)) for w in plain_words(t)], np.int64) for t in texts]
    used = [n for n, e in enumerate(encoded) if len(e)]
    encoded, y = [encoded[n] for n in used], y[used]
    if len(y) == 0 or y.min() == y.max():
        return net
    g = hashed(list(rows))
    gram_of = [g.gram[s : s + c] for s, c in zip(g.starts, g.counts, strict=True)]
    distinct = [np.unique(e) for e in encoded]
    net.odds_word = log_odds([g.word[d] for d in distinct], y)
    net.odds_gram = log_odds([np.concatenate([gram_of[w] for w in d]) for d in distinct], y)
    pad = len(rows)
    windows, lengths, owner = [], [], []
    for n, e in enumerate(encoded):
        for s, t in spans(len(e)):
            row = np.full(WINDOW, pad, np.int64)
            row[: t - s] = e[s:t]
            windows.append(row)
            lengths.append(t - s)
            owner.append(n)
    ids, lengths, owner = np.array(windows), np.array(lengths), np.array(owner)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    share = y.mean()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    sizes = np.diff(np.r_[first, len(ids)])
    step, epochs = 0, max(epochs, -(-MIN_STEPS * BATCH // len(y)))
    refresh = max(2, epochs // 6)
    for epoch in range(epochs):
        if epoch % refresh == 0:
            x = net.inputs(g)
            if epoch == 0:  # untrained logits say little: start from the window with the most telling words
                logits = np.r_[np.maximum(net.odds_word[g.word], x[:, -2]), -9][ids].max(axis=1)
            else:
                pf, pb = net.projected(x)
                logits = np.concatenate(
                    [net.forward(pf, pb, ids[k : k + 2048], lengths[k : k + 2048])[0] for k in range(0, len(ids), 2048)]
                )
            best = np.array([f + int(np.argmax(logits[f : f + c])) for f, c in zip(first, sizes, strict=True)])
        for chosen in np.array_split(rng.permutation(best), max(1, len(best) // BATCH)):
            step += 1
            words_in, back = np.unique(ids[chosen], return_inverse=True)
            back = back.reshape(ids[chosen].shape)
            real = words_in[words_in < pad]
            sub = Grams(
                g.word[real], np.concatenate([gram_of[w] for w in real]),
                np.cumsum(g.counts[real]) - g.counts[real], g.counts[real],
            )
            xb = net.inputs(sub)
            pf, pb = net.projected(xb)
            logit, saved = net.forward(pf, pb, back, lengths[chosen], keep=True)
            d = ((_sigmoid(logit) - y[owner[chosen]]) / len(chosen)).astype(np.float32)
            grad, (dxf, dxb) = net.backward(saved, d, pad)
            flat = back.T.reshape(-1)
            sums = []
            for dx in (dxf, dxb):
                s = np.zeros((len(real) + 1, 3 * HIDDEN), np.float32)
                np.add.at(s, np.minimum(flat, len(real)), dx.reshape(-1, 3 * HIDDEN))
                sums.append(s[: len(real)])
            grad["wf"], grad["wb"] = xb.T @ sums[0], xb.T @ sums[1]
            d_in = sums[0] @ net.p["wf"].T + sums[1] @ net.p["wb"].T
            grad["words"] = np.zeros_like(net.p["words"])
            np.add.at(grad["words"], sub.word, d_in[:, :EMBED])
            grad["grams"] = np.zeros_like(net.p["grams"])
            spread = np.repeat(d_in[:, EMBED : 2 * EMBED] / np.maximum(sub.counts, 1)[:, None], sub.counts, axis=0)
            np.add.at(grad["grams"], sub.gram, spread.astype(np.float32))
            for k, v in grad.items():
                v = v + np.float32(1e-4) * net.p[k]
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                size = (0.01 if epoch < 0.7 * epochs else 0.003) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                net.p[k] -= (size * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    rate = min(max(base_rate, 1e-3), 1 - 1e-3)
    # The sample may hold more toxic texts than the labels: move the logit to their rate, half way,
    # since window maxima of clean and toxic texts lie far apart.
    net.shift = 0.5 * (float(np.log(rate / (1 - rate))) - float(np.log(share / (1 - share))))
    net.trained = True
    return net


class Scorer:
    """Scores batches of texts; keeps projections of words seen, up to ``KEPT_WORDS``."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.pf = np.zeros((0, 3 * HIDDEN), np.float32)
        self.pb = np.zeros((0, 3 * HIDDEN), np.float32)
        pad_f, pad_b = self.net.projected(np.zeros((0, 2 * EMBED + 4), np.float32))
        self.pad = (pad_f, pad_b)

    def _learn(self, fresh: list[bytes]) -> None:
        f, b = self.net.projected(self.net.inputs(hashed(fresh)))
        self.pf, self.pb = np.vstack([self.pf, f[:-1]]), np.vstack([self.pb, b[:-1]])

    def score(self, texts: list[str | None]) -> np.ndarray:
        net = self.net
        out = np.full(len(texts), net.base_rate)
        if not net.trained:
            return out
        best = np.full(len(texts), -np.inf)
        ids, lengths, owner = [], [], []
        if len(self.rows) > KEPT_WORDS:
            self._forget()
        for n, text in enumerate(texts):
            split = plain_words(text)
            # Very long texts go in stretches of whole strides, so that memory stays bounded.
            room = STRIDE * BATCH_WINDOWS
            for begin in range(0, len(split), room) if split else ():
                part = split[begin : begin + room + WINDOW - STRIDE]
                before, rows = len(self.rows), self.rows
                e = np.fromiter((rows.setdefault(w, len(rows)) for w in part), np.int64, len(part))
                if len(rows) > before:
                    self.pending = getattr(self, "pending", [])
                    self.pending += list(rows)[before:] if before == 0 else _newest(rows, len(rows) - before)
                cut = spans(len(part))
                block = np.full((len(cut), WINDOW), -1, np.int64)
                for k, (s, t) in enumerate(cut):
                    block[k, : t - s] = e[s:t]
                ids.append(block)
                lengths.append(np.array([t - s for s, t in cut]))
                owner.append(np.full(len(cut), n))
                if sum(map(len, ids)) >= BATCH_WINDOWS:
                    self._flush(ids, lengths, owner, best)
        self._flush(ids, lengths, owner, best)
        known = np.isfinite(best)
        out[known] = 1 / (1 + np.exp(-(np.clip(best[known], -30, 30) + net.shift)))
        return out

    def _flush(self, ids, lengths, owner, best) -> None:
        if getattr(self, "pending", []):
            self._learn(self.pending)
            self.pending = []
        if not ids:
            return
        pf, pb = np.vstack([self.pf, self.pad[0]]), np.vstack([self.pb, self.pad[1]])
        all_ids, all_lengths, all_owner = np.vstack(ids), np.concatenate(lengths), np.concatenate(owner)
        all_ids[all_ids < 0] = len(pf) - 1
        for k in range(0, len(all_ids), BATCH_WINDOWS):
            part = slice(k, k + BATCH_WINDOWS)
            longest = int(all_lengths[part].max())
            logit, _ = self.net.forward(pf, pb, all_ids[part, :longest], all_lengths[part])
            np.maximum.at(best, all_owner[part], logit)
        ids.clear(), lengths.clear(), owner.clear()
        if len(self.rows) > KEPT_WORDS:
            self._forget()


def _newest(rows: dict[bytes, int], count: int) -> list[bytes]:
    newest = []
    for word in reversed(rows):
        newest.append(word)
        if len(newest) == count:
            break
    return newest[::-1]


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", max_per_class: int = 2000,
) -> Network:
    """Train on at most ``max_per_class`` labelled texts of each class, chosen by a hash of the id."""
    clean = (
        labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.min(label_column).alias("_low"), F.max(label_column).alias("_y"))
        .where("_low = _y").drop("_low")
    )
    counts = {r["_y"]: r["count"] for r in clean.groupBy("_y").count().collect()}
    total = sum(counts.values())
    base_rate = counts.get(1, 0) / total if total else 0.0
    if not counts.get(0) or not counts.get(1):
        return train([], [], base_rate)
    order = F.xxhash64(F.col("_id").cast("string"))
    chosen = clean.where("_y = 1").orderBy(order, "_id").limit(max_per_class).unionByName(
        clean.where("_y = 0").orderBy(order, "_id").limit(max_per_class)
    )
    # At most 2 * max_per_class ids, hence the hint.
    sample = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(F.broadcast(chosen), "_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1] or ""))
        net = train([r[1] for r in rows], [int(r[2]) for r in rows], base_rate)
        yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps(net)], pa.binary())})

    # One task for the bounded sample: the driver holds neither texts nor their words, only the network.
    found = sample.select("_id", "_text", "_y").coalesce(1).mapInArrow(learn, "net binary").collect()
    return pickle.loads(found[0]["net"]) if found else train([], [], base_rate)


def scored(docs: DataFrame, net: Network, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series(scorer.score([t if isinstance(t, str) else None for t in batch]))

    return docs.withColumn(score_column, score(F.col(text_column)))


def held_out(id_column: str = "doc_id") -> Column:
    """A fifth of the ids, never used to train: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit(docs, labels.where(~held_out()))
    return scored(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that score below ``threshold``; trained as in :func:`op5_toxicity`."""
    score = "_toxicity"
    kept = scored(docs, fit(docs, labels.where(~held_out())), score_column=score)
    return kept.where(F.col(score) < threshold).drop(score)
