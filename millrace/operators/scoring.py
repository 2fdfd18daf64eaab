"""Best chunks of many questions without building all pairs: max-score pruning, and exact ranks by counting.

The chunk index streams past blocks of questions. Within a batch of chunks the largest contribution of
every term bounds what a question can reach. Its terms are put in order of that bound; those that
together stay below the question's threshold (the score of its ``depth``-th best chunk so far) cannot
lift a chunk on their own, so only chunks with one of the others are scored. Each task returns the best
``depth`` chunks of a question by words and by meaning, whatever the number of chunks.

Cosine is a matrix product over the vectors of a batch, as exact search by meaning asks for; pairs stay
in the task unless they are among the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed

# Chunks whose cosines with the questions of a plant are laid out as one table of numbers, of so many cells.
CELLS = 1 << 22
WORDS, MEANING = "words", "meaning"
POOL_COLUMNS = "query_no int, list string, evidence_id string, document_id {document}, lexical double, bm25 double, semantic double"


@dataclass
class Question:
    number: int
    plant: object
    length: int
    terms: list[tuple[str, int]]
    vector: list[float] | None


@dataclass
class PlantStatistics:
    chunks: int
    tokens: int
    frequency: dict[str, int]


@dataclass
class _Asked:
    """A question against the terms of its plant."""

    number: int
    columns: np.ndarray
    counts: np.ndarray
    length: int
    vector: np.ndarray | None


@dataclass
class PlantQuestions:
    average_length: float
    places: np.ndarray  # numbers of the plant's terms in the block's vocabulary, ascending
    weights: np.ndarray
    place: np.ndarray  # of each term of the block's vocabulary, -1 without one
    asked: list[_Asked] = field(default_factory=list)


class QuestionBlock:
    """Questions that go to the tasks together, by plant, with one vocabulary."""

    def __init__(self, questions: list[Question], statistics: dict[object, PlantStatistics]):
        words = sorted({t for q in questions for t, _ in q.terms})
        number = {t: n for n, t in enumerate(words)}
        self.vocabulary = pa.array(words, pa.string())
        self.plants: dict[object, PlantQuestions] = {}
        for q in questions:
            if q.plant not in statistics:  # no chunks
                continue
            known = statistics[q.plant]
            if q.plant not in self.plants:
                held = sorted(t for t in known.frequency if t in number)
                frequency = np.array([known.frequency[t] for t in held], float)
                weights = np.log(1 + (known.chunks - frequency + 0.5) / (frequency + 0.5))
                places = np.array([number[t] for t in held], np.int64)
                place = np.full(len(words), -1, np.int32)
                place[places] = np.arange(len(places))
                self.plants[q.plant] = PlantQuestions(known.tokens / known.chunks, places, weights, place)
            plant = self.plants[q.plant]
            found = [(t, c) for t, c in q.terms if t in known.frequency]
            columns = np.searchsorted(plant.places, [number[t] for t, _ in found]).astype(np.int64)
            unit = None
            if q.vector is not None:
                unit = np.asarray(q.vector, float)
                unit = unit / np.linalg.norm(unit)
            plant.asked.append(_Asked(q.number, columns, np.array([c for _, c in found], np.int64), q.length, unit))


def plant_statistics(bagged: DataFrame, questions: list[Question]) -> dict[object, PlantStatistics]:
    """Chunks, tokens and term frequencies of the questions' plants, in one pass; a task sends sums only."""
    words = sorted({t for q in questions for t, _ in q.terms})
    plants = list({q.plant for q in questions})
    shared = bagged.sparkSession.sparkContext.broadcast((words, plants))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, plants = shared.value
        vocabulary = pa.array(words, pa.string())
        found = np.zeros((len(plants), len(words)), np.int64)
        chunks, tokens = np.zeros(len(plants), np.int64), np.zeros(len(plants), np.int64)
        for batch in batches:
            whole = _Batch(batch, vocabulary)
            of = np.full(whole.size, -1)
            for n, plant in enumerate(plants):
                rows = whole.of_plant(plant)
                of[rows] = n
                chunks[n] += len(rows)
                tokens[n] += int(whole.length[rows].sum())
            of = of[whole.owner]
            np.add.at(found, (of[of >= 0], whole.terms[of >= 0]), 1)
        for n in np.flatnonzero(chunks):
            held = np.flatnonzero(found[n])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(held) + 2, n, np.int32)), pa.array(np.r_[-2, -1, held].astype(np.int32)),
                    pa.array(np.r_[chunks[n], tokens[n], found[n][held]]),
                ],
                ["plant", "term", "n"],
            )

    sums = bagged.select("plant_id", "length", "bag").mapInArrow(count, "plant int, term int, n bigint").groupBy("plant", "term").agg(F.sum("n").alias("n"))
    found: dict[object, PlantStatistics] = {}
    for r in sums.collect():  # at most the block's terms for each of its plants
        held = found.setdefault(plants[r.plant], PlantStatistics(0, 0, {}))
        if r.term == -2:
            held.chunks = r.n
        elif r.term == -1:
            held.tokens = r.n
        else:
            held.frequency[words[r.term]] = r.n
    return found


class Chunks:
    """The chunks of one plant in a batch: the places of every term, with counts and contributions."""

    def __init__(self, plant: PlantQuestions, rows: np.ndarray, batch: _Batch):
        self.rows, self.plant = rows, plant
        self.evidence, self.document = batch.evidence[rows], batch.document[rows]
        at = np.full(batch.size, -1)
        at[rows] = np.arange(len(rows))
        owner = at[batch.owner]
        inside = np.flatnonzero(owner >= 0)
        place = plant.place[batch.terms[inside]]
        inside, place = inside[place >= 0], place[place >= 0]
        order = np.argsort(place, kind="stable")
        inside, place = inside[order], place[order]
        self.owner, self.counts = owner[inside], batch.counts[inside]
        self.starts = np.searchsorted(place, np.arange(len(plant.places) + 1))
        norm = 1 - fixed.BM25_B + fixed.BM25_B * batch.length[rows] / max(1.0, plant.average_length)
        self.gains = plant.weights[place] * (self.counts * (fixed.BM25_K1 + 1) / (self.counts + fixed.BM25_K1 * norm[self.owner]))
        self.most = np.zeros(len(plant.places))
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.gains, self.starts[held])
        self._scored: tuple[_Asked | None, tuple | None] = (None, None)

    def reaching(self, columns: np.ndarray, threshold: float) -> np.ndarray:
        """Rows that may reach the threshold: those with a term outside the cheapest that cannot."""
        if threshold <= 0:
            return np.arange(len(self.rows))
        most = self.most[columns]
        order = np.argsort(most, kind="stable")
        upto = np.cumsum(most[order])
        hit = np.zeros(len(self.rows), bool)
        for n in columns[order[upto >= threshold - 1e-9]].tolist():
            hit[self.owner[self.starts[n] : self.starts[n + 1]]] = True
        return np.flatnonzero(hit)

    def scores(self, asked: _Asked, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lexical share and BM25 at ten digits (the order of addition must not decide a ranking)."""
        if not len(rows):
            return np.zeros(0), np.zeros(0)
        if self._scored[0] is not asked:
            size = np.diff(self.starts)[asked.columns]
            ends = np.cumsum(size)
            total = int(size.sum())
            at = np.arange(total) + np.repeat(self.starts[asked.columns] - (ends - size), size)
            owner, wanted = self.owner[at], np.repeat(asked.counts, size)
            shared = np.bincount(owner, np.minimum(self.counts[at], wanted), len(self.rows))
            bm25 = np.bincount(owner, self.gains[at], len(self.rows))
            self._scored = asked, (shared / asked.length, np.round(bm25, 10))
        lexical, bm25 = self._scored[1]
        return lexical[rows], bm25[rows]


class _Batch:
    """Arrays of one Arrow batch of the index."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: pa.Array):
        column = {name: batch.column(n) for n, name in enumerate(batch.schema.names)}
        self.size = batch.num_rows
        self.plant = column["plant_id"]
        if "evidence_id" in column:
            self.evidence = np.array(column["evidence_id"].to_pylist(), object)
            self.document = np.array(column["document_id"].to_pylist(), object)
        self.length = column["length"].to_numpy(zero_copy_only=False).astype(float)
        bags = column["bag"]
        sizes = np.diff(bags.offsets.to_numpy())
        flat = bags.flatten()
        number = pc.index_in(flat.field(0), value_set=vocabulary)
        inside = pc.is_valid(number).to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(self.size), sizes)[inside]
        self.terms = number.drop_null().to_numpy().astype(np.int64)
        self.counts = flat.field(1).to_numpy(zero_copy_only=False)[inside].astype(np.int64)
        self.numbers = None
        if "vector" in column:
            widths = pc.fill_null(pc.list_value_length(column["vector"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            self.numbers = column["vector"].flatten().to_numpy(zero_copy_only=False).astype(float)
            self.first = np.cumsum(widths) - widths
            # As terms.valid_vector: of bounded size, finite everywhere, not all zero. Others have width 0.
            whose = np.repeat(np.arange(self.size), widths)
            bad = np.bincount(whose[~np.isfinite(self.numbers)], minlength=self.size) > 0
            some = np.bincount(whose[self.numbers != 0], minlength=self.size) > 0
            self.width = np.where((widths <= fixed.MAX_VECTOR_SIZE) & some & ~bad, widths, 0)

    def of_plant(self, plant) -> np.ndarray:
        if plant is None:
            return np.flatnonzero(pc.is_null(self.plant).to_numpy(zero_copy_only=False))
        same = pc.fill_null(pc.equal(self.plant, pa.scalar(plant, self.plant.type)), False)
        return np.flatnonzero(same.to_numpy(zero_copy_only=False))


def _parts(block: QuestionBlock, batch: pa.RecordBatch) -> Iterator[tuple[PlantQuestions, Chunks, np.ndarray | None]]:
    """Per plant of a batch: its chunks, and the cosines of all its questions (rows) with them."""
    whole = _Batch(batch, block.vocabulary)
    for name, plant in block.plants.items():
        rows = whole.of_plant(name)
        step = max(1, CELLS // (len(plant.asked) + 1))
        for begin in range(0, len(rows), step):
            part = rows[begin : begin + step]
            yield plant, Chunks(plant, part, whole), _cosines(plant, part, whole)


def _cosines(plant: PlantQuestions, rows: np.ndarray, batch: _Batch) -> np.ndarray | None:
    if batch.numbers is None or all(a.vector is None for a in plant.asked):
        return None
    out = np.full((len(plant.asked), len(rows)), np.nan)
    sizes = batch.width[rows]
    for size in {len(a.vector) for a in plant.asked if a.vector is not None}:
        mine = [n for n, a in enumerate(plant.asked) if a.vector is not None and len(a.vector) == size]
        fits = np.flatnonzero(sizes == size)
        if len(fits):
            right = batch.numbers[batch.first[rows[fits], None] + np.arange(size)]
            right /= np.linalg.norm(right, axis=1, keepdims=True)
            out[np.ix_(mine, fits)] = np.stack([plant.asked[n].vector for n in mine]) @ right.T
    return out


def _admitted(lexical: np.ndarray, cosine: np.ndarray | None) -> np.ndarray:
    passes = lexical >= fixed.LEXICAL_GATE
    return passes if cosine is None else passes | (np.nan_to_num(cosine, nan=-1.0) >= fixed.SEMANTIC_GATE)


class Best:
    """The best chunks of one question in one list so far."""

    def __init__(self, depth: int):
        self.depth, self.floor = depth, 0.0
        self.rows: list[tuple] = []  # (-score, evidence, document, lexical, bm25, semantic)

    def add(self, score, chunks: Chunks, rows, lexical, bm25, semantic) -> None:
        keep = np.arange(len(rows)) if len(self.rows) < self.depth else np.flatnonzero(score >= self.floor)
        if not len(keep):
            return
        if len(keep) > self.depth:  # the first of this batch are enough
            keep = keep[np.lexsort((chunks.evidence[rows[keep]], -score[keep]))[: self.depth]]
        self.rows += zip(
            (-score[keep]).tolist(), chunks.evidence[rows[keep]], chunks.document[rows[keep]],
            lexical[keep].tolist(), bm25[keep].tolist(), semantic[keep].tolist(), strict=True,
        )
        self.rows = sorted(self.rows)[: self.depth]
        if len(self.rows) == self.depth:
            self.floor = -self.rows[-1][0]


def _index_columns(bagged: DataFrame, semantic: bool) -> DataFrame:
    return bagged.select("plant_id", "evidence_id", "document_id", "length", "bag", *(["vector"] if semantic else []))


def best_lists(bagged: DataFrame, block: Broadcast, depth: int, semantic: bool, by_words: bool) -> DataFrame:
    """The best ``depth`` admitted chunks that each task sees, by words and by meaning; and, as list
    ``scored``, how many pairs the task scored (``bm25``) of those it met (``semantic``)."""
    schema = POOL_COLUMNS.format(document=dict(bagged.dtypes)["document_id"])
    kind = [("query_no", pa.int32()), ("list", pa.string()), ("evidence_id", pa.string())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[int, str], Best] = {}
        met = scored = 0
        documents = None
        for batch in batches:
            documents = batch.schema.field("document_id").type
            for plant, chunks, cosines in _parts(block.value, batch):
                for n, asked in enumerate(plant.asked):
                    cosine = None if cosines is None or asked.vector is None else cosines[n]
                    words = lists.setdefault((asked.number, WORDS), Best(depth)) if by_words else None
                    met += len(chunks.rows)
                    rows = chunks.reaching(asked.columns, words.floor) if by_words else np.zeros(0, np.int64)
                    if cosine is not None:
                        meaning = lists.setdefault((asked.number, MEANING), Best(depth))
                        near = np.flatnonzero(np.round(np.nan_to_num(cosine, nan=-1.0), 4) >= max(fixed.SEMANTIC_GATE, meaning.floor))
                        near_lexical, near_bm25 = chunks.scores(asked, near)
                        good = cosine[near] >= fixed.SEMANTIC_GATE if not by_words else _admitted(near_lexical, cosine[near])
                        near = near[good]
                        meaning.add(np.round(cosine[near], 4), chunks, near, near_lexical[good], near_bm25[good], cosine[near])
                    scored += len(rows)
                    if not len(rows):
                        continue
                    lexical, bm25 = chunks.scores(asked, rows)
                    own = None if cosine is None else cosine[rows]
                    good = _admitted(lexical, own)
                    reported = np.zeros(int(good.sum())) if own is None else np.nan_to_num(own[good], nan=0.0)
                    words.add(bm25[good], chunks, rows[good], lexical[good], bm25[good], reported)
        if documents is None:
            return
        out = [(q, name, e, d, x, b, s) for (q, name), best in lists.items() for _, e, d, x, b, s in best.rows]
        out.append((-1, "scored", None, None, 0.0, float(scored), float(met)))
        types = pa.schema([*kind, ("document_id", documents), *((c, pa.float64()) for c in ("lexical", "bm25", "semantic"))])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    # By meaning alone, chunks without a vector are in no list.
    compared = bagged if by_words else bagged.where(F.col("vector").isNotNull())
    return _index_columns(compared, semantic).mapInArrow(search, schema)


def better_counts(bagged: DataFrame, block: Broadcast, pool: Broadcast) -> DataFrame:
    """(``query_no``, ``list``, ``evidence_id``, ``above``): how many admitted chunks stand before the pool's rows.

    ``pool`` maps (question, list) to scores and evidence ids. Chunks below the lowest of the pool are not scored.
    """
    schema = "query_no int, list string, evidence_id string, above bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = {key: np.zeros(len(scores), np.int64) for key, (scores, _) in pool.value.items()}

        def tally(key, score, evidence) -> None:
            wanted, names = pool.value[key]
            ordered = np.sort(score)
            more = len(ordered) - np.searchsorted(ordered, wanted, "right")
            ties = len(ordered) - np.searchsorted(ordered, wanted, "left") - more
            for n in np.flatnonzero(ties):
                more[n] += int((evidence[score == wanted[n]] < names[n]).sum())
            above[key] += more

        for batch in batches:
            for plant, chunks, cosines in _parts(block.value, batch):
                for n, asked in enumerate(plant.asked):
                    cosine = None if cosines is None or asked.vector is None else cosines[n]
                    if (key := (asked.number, WORDS)) in above:
                        rows = chunks.reaching(asked.columns, float(pool.value[key][0].min()))
                        lexical, bm25 = chunks.scores(asked, rows)
                        good = _admitted(lexical, None if cosine is None else cosine[rows])
                        tally(key, bm25[good], chunks.evidence[rows[good]])
                    if (key := (asked.number, MEANING)) in above and cosine is not None:
                        rounded = np.round(np.nan_to_num(cosine, nan=-1.0), 4)
                        rows = np.flatnonzero(rounded >= max(fixed.SEMANTIC_GATE, float(pool.value[key][0].min())))
                        good = _admitted(chunks.scores(asked, rows)[0], cosine[rows])
                        tally(key, rounded[rows[good]], chunks.evidence[rows[good]])
        out = [(q, name, e, int(a)) for (q, name), counts in above.items() for e, a in zip(pool.value[q, name][1], counts, strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)],
                ["query_no", "list", "evidence_id", "above"],
            )

    counted = _index_columns(bagged, "vector" in bagged.columns).mapInArrow(count, schema)
    return counted.groupBy("query_no", "list", "evidence_id").agg(F.sum("above").alias("above"))
