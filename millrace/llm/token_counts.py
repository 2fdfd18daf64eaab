"""Token counts by dynamic programming over prefixes.

``prefix_counts`` stores, for every text, the number of tokens of each prefix that ends with a
character other than white space: the count of such a prefix is that of the words before plus that
of the beginning of its last word. Within a word dynamic programming goes by character: the last
token of a prefix is the one vocabulary entry that ends there and whose neighbour, the last token
of the prefix before it, would not have been merged with it; the count is that of the earlier
prefix plus one. Each distinct word is counted once per worker while memory allows. So every prefix
has an exact count, that of the prefix encoded as a text of its own, and questions about truncation
and budgets are answered from the stored counts without encoding a text again. A longer prefix of
a word can have fewer tokens.

Cases: null and empty texts have no bytes, no tokens and empty lists. Special strings inside texts
are tokens of their own, as the library does by default. Very long texts have long lists; nothing
is cut. Rows are never dropped; extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.pieces import WordPieces, load_tokenizer

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
GROUP = 256
WORD_END = "</w>"
KEPT_PAIRS = 1 << 20


def prefix_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ``n_bytes``, ``ends``, ``counts``): ``counts[k]`` tokens up to byte ``ends[k]`` of the text."""
    id_type = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {id_type}, n_bytes bigint, ends array<int>, counts array<int>"
    ints = pa.list_(pa.int32())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for batch in batches:
            pieces = pieces or prefix_pieces(vocabulary)
            for begin in range(0, batch.num_rows, GROUP):
                part = batch.slice(begin, GROUP)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                split = [r.split() for r in raw]
                counts = pieces.counts(split)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(r) for r in raw], pa.int64()),
                        pa.array([_ends(r) for r in raw], ints), pa.array(counts, ints),
                    ],
                    [id_column, "n_bytes", "ends", "counts"],
                )

    return docs.select(id_column, text_column).mapInArrow(count, schema)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _ends(raw: bytes) -> np.ndarray:
    """The byte after each character that is no white space."""
    held = np.frombuffer(raw, np.uint8)
    last = np.ones(len(held), bool)
    last[:-1] = (held[1:] & 0xC0) != 0x80
    return np.flatnonzero(last & ~_SPACE[held]).astype(np.int32) + 1


def total(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0)).cast("long")


def tokens_before(ends: Column, counts: Column, byte: Column) -> Column:
    """Tokens of the prefix of all characters that end by a byte of the text."""
    inside = F.array_size(F.filter(ends, lambda e: e <= byte))
    return F.when(inside > 0, F.get(counts, inside - 1)).otherwise(0).cast("long")


def bytes_within(ends: Column, counts: Column, budget: Column) -> Column:
    """The longest prefix with at most ``budget`` tokens, in bytes."""
    return F.coalesce(F.array_max(F.zip_with(ends, counts, lambda e, c: F.when(c <= budget, e))), F.lit(0)).cast("long")


class State:
    """A place in a word as far as tokens can tell: an ending, the tokens that end with it, and what may follow."""

    __slots__ = ("after", "ending", "tokens")

    def __init__(self, ending: str, tokens: list[tuple]):
        self.ending, self.tokens, self.after = ending, tokens, {}


class WordPrefixes:
    """Token counts of all prefixes of one word, by dynamic programming over its characters."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import json

        self.tokenizer = load_tokenizer(vocabulary)
        model = json.loads(self.tokenizer.to_str())["model"]
        # Numbers in the order of merging: first the symbols that nothing is merged into.
        merged = {left + right for left, right in model["merges"]}
        number = {t: n for n, t in enumerate(t for t in model["vocab"] if t not in merged)}
        self.parts = [(n, n) for n in range(len(number))]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in model["merges"]:
            self.merged[number[left], number[right]] = number[left + right] = len(self.parts)
            self.parts.append((number[left], number[right]))
        # By spelling: the token inside a word, and the one that closes it.
        self.entries = {t.removesuffix(WORD_END): (number.get(t.removesuffix(WORD_END)), number.get(t.removesuffix(WORD_END) + WORD_END)) for t in number}
        self.beginnings = {spelling[:k] for spelling in self.entries for k in range(len(spelling) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        # The word before, with the state, last token and count of each of its prefixes.
        self.before, self.states, self.last, self.count, self.out = "", [State("", [])], [None], [0], []
        self.known = {"": self.states[0]}

    def _next(self, state: State, character: str) -> State:
        """The state after one more character: the longest ending that some token begins with."""
        ending = state.ending + character
        while ending not in self.beginnings:
            ending = ending[1:]
        found = self.known.get(ending)
        if found is None:
            tokens = [(n, *self.entries[e]) for n in range(len(ending), 0, -1) if (e := ending[len(ending) - n :]) in self.entries]
            found = self.known[ending] = State(ending, tokens)
        state.after[character] = found
        return found

    def _fit(self, left: int, right: int) -> bool:
        """:meth:`_apart`, kept for pairs seen before."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            known = self.fits[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when the symbols of both are merged in order of rank: no
        two parts that meet at their border may be merged before one of them is complete."""
        limit = len(self.parts)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.parts[left][1]
                if left == limit:
                    limit, right = right + 1, self.parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.parts[right][0]
                if right + 1 == limit:
                    limit, left = left, self.parts[left][1]
                    if left == limit:
                        return True

    def counts(self, word: str) -> list[int]:
        """Tokens of ``word[:1]``, ``word[:2]``... each as a word of its own; ``word`` in the
        vocabulary's byte alphabet, as the pre-tokenizer gives it. What the word shares with the
        one before is not reckoned again, so that words in order cost little more than a trie of them."""
        shared = 0
        for a, b in zip(word, self.before, strict=False):
            if a != b:
                break
            shared += 1
        states, last, count, out = self.states, self.last, self.count, self.out
        del states[shared + 1 :], last[shared + 1 :], count[shared + 1 :], out[shared:]
        self.before = word
        state, fit, end = states[shared], self._fit, shared
        for character in word[shared:]:
            end += 1
            state = state.after.get(character) or self._next(state, character)
            token = closing = None
            tokens = 0
            for length, inside, at_end in state.tokens:  # all tokens that end here, the longest first
                begin = end - length
                before = last[begin]
                if begin and before is None:
                    continue
                if closing is None and at_end is not None and (not begin or fit(before, at_end)):
                    closing = count[begin] + 1
                if token is None and inside is not None and (not begin or fit(before, inside)):
                    token, tokens = inside, count[begin] + 1
                if token is not None and closing is not None:
                    break
            states.append(state)
            last.append(token)
            count.append(tokens)
            out.append(closing)
        return out.copy()

    def text_counts(self, text: str) -> list[tuple[str, list[int]]]:
        """Each word of a text as the pre-tokenizer sees it, with the counts of all prefixes up to
        there: those of the words before, plus the word's own."""
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        before, out = 0, []
        for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            own = [before + c for c in self.counts(word)]
            before = own[-1]
            out.append((word, own))
        return out


class PrefixPieces(WordPieces):
    """Token counts of all prefixes of words: what each character adds, as little-endian 16-bit
    numbers, so that those of a text follow one another."""

    def __init__(self, vocabulary: str):
        super().__init__(vocabulary)
        self.program = WordPrefixes(vocabulary)

    def alone(self, tail: bytes) -> bytes:
        counts = self.prefixes(tail)
        return struct.pack(f"<{len(counts)}h", *map(sub, counts, [0, *counts]))

    def learn(self, pieces: list[bytes]) -> None:
        self.kept.update((p, self.alone(p)) for p in pieces)

    def size(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def prefixes(self, piece: bytes) -> list[int]:
        if piece.isalpha():  # ASCII letters only
            return self.program.counts(piece.lower().decode())
        text = piece.decode("utf-8", "replace")
        normal = self.tokenizer.normalizer.normalize_str(text)
        # Where the normal form joins or adds characters, or special strings may be, prefixes differ in more than their end.
        odd = "<|" in text or "İ" in text or any(map(str.isspace, text)) or not unicodedata.is_normalized("NFC", text)
        if odd or len(text) != len(normal) or "\ufffd" in text:
            return [self.size(piece[:e].decode("utf-8", "replace")) for e in _ends(piece).tolist()]
        before, out = 0, []
        for word, (begin, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            out += [before] * (begin - len(out))
            part = normal[begin:end]
            if part[0] == "'" and part[1:].isalpha():  # a contraction: without its end, a sign and letters
                own = [self.size(part[: k + 1]) for k in range(len(part))]
            else:
                own = self.program.counts(word)
                if not part.isascii():
                    own = [own[e - 1] for e in accumulate(len(c.encode()) for c in part)]
            out += [before + c for c in own]
            before = out[-1]
        return out + [before] * (len(text) - len(out))

    def counts(self, group: list[list[bytes]]) -> list[np.ndarray]:
        get = self.known(group).__getitem__
        return [np.cumsum(np.frombuffer(b"".join(map(get, parts)), "<i2"), dtype=np.int32) for parts in group]


@cache
def prefix_pieces(vocabulary: str) -> PrefixPieces:
    """One for each Python worker: a worker keeps its words from task to task."""
    return PrefixPieces(vocabulary)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = prefix_counts(table(spark, sf_dir, "documents"))
    n_tokens = total(F.col("counts"))
    return counted.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > LIMIT).alias("over_limit"))
