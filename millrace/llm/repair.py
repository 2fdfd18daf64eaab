"""Token-id files compressed by Re-Pair grammars, with random access.

Texts are encoded, each followed by the end id 0, sorted by id and cut into shards. In each shard
Re-Pair replaces frequent pairs of neighbouring symbols by new symbols (nonterminals), again and
again, until no pair is found twice. Each pass takes, from the most frequent on, the pairs at least 1/32 as
frequent as the first that cannot get in each other's way (no symbol ends one pair and begins another), so that
they are replaced together.

File format, little-endian: magic ``RPG1``; six unsigned 64-bit counts (terminal bound, rules,
symbols, documents, tokens, bytes of ids); rules as pairs of 32-bit symbols; expansion length of
each rule (32-bit); the symbols (32-bit); the token at which each document starts, and the end
(64-bit); the documents' ids (64-bit, or text as JSON). A document is decoded alone: expansion lengths, summed
over the symbols, show where its tokens begin, and only the symbols there are expanded.

Files go to a folder that all executors share, named after partition and number; a task that runs
again replaces its files by equal ones. Cases: null and empty texts are documents of the end id
alone; rows with the same id are documents of their own, ordered by their text; rows without id
come first. An empty table has no files and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import files_at, publish, table
from millrace.llm.pieces import GROUP_BYTES, byte_pieces
from millrace.session import fresh_folder, staged

MAGIC = b"RPG1"
VOCABULARY = "byte_bpe_50k.json"
END = 0
SHARD_TOKENS = 1 << 20
MIN_COUNT = 2
# A pass takes pairs down to this part of the most frequent one's count.
SHARE = 32
_SLOT_BITS = 20
_ODD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def _runs_cut(at: np.ndarray) -> np.ndarray:
    """Whether each place where a pair of two equal symbols stands is kept: every other one of each run."""
    starts = np.r_[True, np.diff(at) != 1]
    begin = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
    return (np.arange(len(at)) - begin) % 2 == 0


def _in_order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that sort keys of so many bits, and the sorted keys; key and place share a number where both fit."""
    places = len(keys).bit_length()
    if bits + places > 64:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    packed = keys << np.uint64(places)
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << places) - 1)).astype(np.int64)
    packed >>= np.uint64(places)
    return order, packed


def _about(left: np.ndarray, right: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pairs by hash, never too small, without the places in ``cut``; zero there in the first array."""
    bits = min(_SLOT_BITS, max(10, len(left).bit_length() + 1))
    mixed = left * _ODD[0]
    mixed += right * _ODD[1]
    mixed >>= np.uint32(32 - bits)
    slot = mixed.astype(np.int64)
    tally = np.bincount(slot, minlength=1 << bits).astype(np.int32)
    np.subtract.at(tally, slot[cut], 1)
    every = tally[slot]
    about = every.copy() if len(cut) else every
    about[cut] = 0
    return about, every


def compress(tokens: np.ndarray, terminals: int, min_count: int = MIN_COUNT, passes: int | None = None):
    """(rules, expansion lengths, symbols) of a grammar that expands to ``tokens``.

    Without ``passes`` it ends as Re-Pair does, when no pair is found ``min_count`` times. A pair that is
    not so frequent stays so until one of its symbols is replaced, so that a pass looks at the places
    only (``live``) whose pair was frequent or is new. Places of pairs found less than ``low`` times wait
    until a pass takes pairs that are as rare.
    """
    seq = tokens.astype(np.uint32)
    # Of each place: 0 for a rare pair, 1 while it waits, 2 if it is looked at.
    state, low = np.full(len(seq), 2, np.uint8), min_count
    width, rules, done = np.ones(terminals, np.int64), [np.zeros((0, 2), np.int64)], 0
    while done != passes:
        live = np.flatnonzero(state[:-1] == 2)
        bits = len(width).bit_length()
        left, right = seq.take(live), seq[1:].take(live)
        twin = np.flatnonzero(left == right)
        # A pair that is rare by its hash is rare.
        about, every = _about(left, right, twin[~_runs_cut(live[twin])])
        floor = max(min_count, int(about.max(initial=0)) // SHARE)
        often = ()
        while floor >= low:
            near = np.flatnonzero(about >= floor)
            keys = left[near].astype(np.uint64)
            keys <<= np.uint64(bits)
            keys |= right[near]
            order, ordered = _in_order(keys, 2 * bits)
            edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
            count = np.diff(np.r_[edge, len(ordered)])
            often = np.flatnonzero(count >= floor)
            if len(often) or floor <= min_count:
                break
            floor = max(min_count, floor // 2)
        if floor < low:
            state, low = 2 * (state > 0).view(np.uint8), min_count
            continue
        if not len(often):
            break
        done += 1
        low = max(low, floor // 2)
        state[live] = (every >= min_count).view(np.uint8) + (every >= low).view(np.uint8)
        if floor == min_count:  # counted exactly
            state[live[near[order[np.repeat(count < min_count, count)]]]] = 0
        del keys, about, every, left, right
        # From the most frequent on; a symbol begins or ends pairs as the first of its pairs says.
        often = often[_in_order((count.max() - count[often]).astype(np.uint64), 32)[0]]
        pairs = ordered[edge[often]]
        a, b = (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)
        place = np.arange(len(pairs))
        begins, ends = np.full(len(width), len(pairs)), np.full(len(width), len(pairs))
        begins[a[::-1]], ends[b[::-1]] = place[::-1], place[::-1]
        taken = np.where(a == b, (begins[a] == place) & (ends[a] == place), (begins[a] < ends[a]) & (ends[b] < begins[b]))
        a, b, first, size = a[taken], b[taken], edge[often[taken]], count[often[taken]]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at = live[near[order[np.repeat(first, size) + inside]]]
        seq[at] = np.repeat(np.arange(len(width), len(width) + len(a), dtype=np.uint32), size)
        rules.append(np.stack([a, b], 1))
        width = np.r_[width, width[a] + width[b]]
        # Look again at the new symbols and at those before them.
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        state[at] = 2
        before = at[at > 0] - 1
        before -= ~kept[before]
        state[before] = 2
        kept = np.flatnonzero(kept)
        seq, state = seq.take(kept), state.take(kept)
    return np.concatenate(rules).astype("<u4"), width[terminals:].astype("<u4"), seq.astype("<u4")


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """Tokens of a sequence of symbols: nonterminals open all at once, level by level, each at its place.

    In a long sequence each rule opens once, and its tokens are copied to where it is used.
    """
    if lengths is not None and len(symbols) > 2 * len(rules):
        opened = expand(np.arange(terminals, terminals + len(rules)), rules, terminals, lengths)
        cuts = 4 * np.r_[np.arange(terminals), terminals + np.r_[0, np.cumsum(lengths, dtype=np.int64)]]
        tokens = np.r_[np.arange(terminals, dtype="<u4"), opened]
        each = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(tokens)])
        return np.frombuffer(each.take(pa.array(symbols)).buffers()[2], "<u4")
    rules = rules.astype(np.int64)
    width = np.ones(terminals + len(rules), np.int64)
    if lengths is None:
        for n, (a, b) in enumerate(rules.tolist()):
            width[terminals + n] = width[a] + width[b]
    else:
        width[terminals:] = lengths
    seq = symbols.astype(np.int64)
    size = width[seq]
    out = np.empty(int(size.sum()), "<u4")
    at = np.cumsum(size) - size
    while len(seq):
        inner = seq >= terminals
        out[at[~inner]] = seq[~inner]
        at, opened = at[inner], rules[seq[inner] - terminals]
        seq, at = opened.T.ravel(), np.r_[at, at + width[opened[:, 0]]]
    return out


def shard_bytes(ids: list, starts: list[int], tokens: np.ndarray, terminals: int) -> bytes:
    rules, lengths, symbols = compress(tokens, terminals)
    names = json.dumps(ids).encode()
    head = np.array([terminals, len(rules), len(symbols), len(ids), len(tokens), len(names)], "<u8")
    out = io.BytesIO()
    for part in (MAGIC, head, rules, lengths, symbols, np.array([*starts, len(tokens)], "<u8"), names):
        out.write(part if isinstance(part, bytes) else part.tobytes())
    return out.getvalue()


class Shard:
    """Reads a shard; documents are decoded one at a time or all together."""

    def __init__(self, path: str):
        fs, inner = files_at(path)
        self.file = fs.open_input_file(inner)
        if self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        head = np.frombuffer(self.file.read_at(48, 4), "<u8").astype(np.int64)
        self.terminals, n_rules, n_symbols, n_docs, self.n_tokens, n_names = head.tolist()
        at = 52
        self.rules = np.frombuffer(self.file.read_at(8 * n_rules, at), "<u4").reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.frombuffer(self.file.read_at(4 * n_rules, at), "<u4").astype(np.int64)
        at += 4 * n_rules
        self.symbols_at, self.n_symbols = at, n_symbols
        at += 4 * n_symbols
        self.starts = np.frombuffer(self.file.read_at(8 * (n_docs + 1), at), "<u8").astype(np.int64)
        at += 8 * (n_docs + 1)
        self.ids = json.loads(self.file.read_at(n_names, at))
        self._symbols = self._offsets = None

    def _index(self) -> None:
        if self._symbols is None:
            self._symbols = np.frombuffer(self.file.read_at(4 * self.n_symbols, self.symbols_at), "<u4")
            width = np.ones(self.n_symbols, np.int64)
            inner = self._symbols >= self.terminals
            width[inner] = self.lengths[self._symbols[inner].astype(np.int64) - self.terminals]
            self._offsets = np.r_[0, np.cumsum(width)]

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Tokens ``begin`` to ``end`` of the shard, from the symbols that cover them only."""
        self._index()
        first = int(np.searchsorted(self._offsets, begin, "right")) - 1
        last = int(np.searchsorted(self._offsets, end, "left"))
        part = expand(self._symbols[first:last], self.rules, self.terminals, self.lengths)
        return part[begin - self._offsets[first] : end - self._offsets[first]]

    def document(self, number: int) -> np.ndarray:
        return self.tokens(int(self.starts[number]), int(self.starts[number + 1]))

    def close(self) -> None:
        self.file.close()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least the bytes whose pieces are looked up together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write_shards(
    docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY,
    tasks: int | None = None,
) -> DataFrame:
    """Write all shards; returns one row each (``part``, ``number``, ``path``, ``n_docs``, ``n_tokens``).

    The result is already written, so that reading it does not encode anything again.
    """
    source = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # By ranges of ids: shards are in ascending order, and no range is the place of one key only.
    tasks = tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = source.repartitionByRange(tasks, F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ranged.sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), str(context.taskAttemptId())
        pieces = None
        ids, starts, held, size, number = [], [], [], 0, 0
        end = np.array([END], "<u4").tobytes()

        def flush():
            nonlocal ids, starts, held, size, number
            tokens = np.frombuffer(b"".join(held), "<u4")
            data = shard_bytes(ids, starts, tokens, pieces.tokenizer.get_vocab_size())
            path = publish(folder, f"{part:06d}-{number:06d}.rpg", attempt, lambda out: out.write(data))
            row = {"part": [part], "number": [number], "path": [path], "n_docs": [len(ids)], "n_tokens": [len(tokens)]}
            ids, starts, held, size, number = [], [], [], 0, number + 1
            del tokens, data
            pa.default_memory_pool().release_unused()  # what Arrow holds of earlier groups
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in _together(batches):
            pieces = pieces or byte_pieces(vocabulary)
            for name, encoded in zip(batch.column(0).to_pylist(), pieces.encode(batch.column(1)), strict=True):
                ids.append(name)
                starts.append(size)
                held.append(encoded + end)
                size += len(encoded) // 4 + 1
                if size >= SHARD_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    schema = "part int, number int, path string, n_docs bigint, n_tokens bigint"
    return staged(ordered.mapInArrow(write, schema), "shards")


def read_shards(shards: DataFrame, id_type: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ``start``, ``n_tokens``, ``ids_crc32``) of every document, decoded from the files.

    Starts count the tokens of all documents before: sums per part first (one row per part), then
    shards within their part, so that no list of all shards meets in one task.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    placed = shards.withColumn("inside", within).join(before, "part").select("path", (F.col("before") + F.col("inside")).alias("base"))
    schema = f"`{id_column}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                whole = shard.tokens(0, shard.n_tokens).tobytes()  # every document is asked for
                cuts = (4 * shard.starts).tolist()
                sums = [zlib.crc32(whole[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.ids, kind), pa.array(base + shard.starts[:-1]),
                        pa.array(np.diff(shard.starts)), pa.array(sums, pa.int64()),
                    ],
                    [id_column, "start", "n_tokens", "ids_crc32"],
                )
                shard.close()

    # A row is a shard of about SHARD_TOKENS tokens: deal them out, whatever the size of the list.
    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "path").mapInArrow(read, schema)


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    folder = folder or fresh_folder(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, folder, id_column, text_column), dict(docs.dtypes)[id_column], id_column)


def op6_repair(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
