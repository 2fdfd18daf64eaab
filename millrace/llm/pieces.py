"""Exact tokenization through the pieces between spaces.

Neither public vocabulary forms a token across a single space that has other characters on both
sides (a byte-level token can only begin with it), so that the tokens of a text are those of its
pieces in turn. Each distinct piece is encoded once by the library and kept while memory allows.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Up to twice as many are held, at about 200 bytes each: 200 MB for a worker.
KEPT_PIECES = 500_000
# Texts of so many bytes, or one, have their pieces looked up and learnt together.
GROUP_BYTES = 6 << 20
# Pieces that the library reads as one text.
LEARNT = 200
SIGNS = ".,;:!?#*$%&"
# The character that a byte-level vocabulary writes for each byte: itself, or one from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARACTERS = np.arange(256, dtype="<u4")
_BYTE_CHARACTERS[np.setdiff1d(_BYTE_CHARACTERS, _SHOWN)] = np.arange(0x100, 0x200 - len(_SHOWN))
_NOTHING = pa.scalar(b"", pa.large_binary())


def load_tokenizer(vocabulary: str):
    """A tokenizer of the public files by name, or of any other file by path; one thread each."""
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if os.path.sep not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Tokenizer.from_file(vocabulary)


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value begins, and the last one ends, and the bytes of all."""
    kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    _, offsets, raw = strings.buffers()
    offsets = np.frombuffer(offsets, kind)[strings.offset : strings.offset + len(strings) + 1]
    return offsets, np.frombuffer(raw or b"", np.uint8)


def _pieces_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the pieces of each text begin, and the last ones end, and the pieces."""
    split = pc.split_pattern(texts, " ")
    starts = split.offsets.to_numpy().astype(np.int64)
    return starts - starts[0], split.flatten()


def _last_bytes(strings: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The last bytes of each value, as many as ``sizes`` says."""
    offsets, raw = _bytes_of(strings)
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    taken = raw[np.arange(sizes.sum()) + np.repeat(offsets[1:] - ends, sizes)]
    return pa.Array.from_buffers(pa.large_binary(), len(strings), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(taken)])


def _at(places: pa.Array, values: pa.Array, size: int) -> pa.Array:
    """So many values: those given at their places, and empty ones."""
    which = np.full(size, len(values))
    which[places.to_numpy()] = np.arange(len(values))
    return pa.concat_arrays([values, pa.array([b""], values.type)]).take(pa.array(which))


class _Pieces:
    """Values of pieces by their text. Pieces are learnt many at a time: joined by spaces, the
    library reads them as one text, and its tokens fall apart at the spaces again. A run of ASCII
    signs after letters is a word of its own to both vocabularies: such pieces are put together
    from the letters and the signs. Two generations are kept, so that pieces in use survive."""

    def __init__(self, vocabulary: str):
        self.tokenizer = load_tokenizer(vocabulary)
        self.kept: dict = {}
        self.older: dict = {}
        self.tails: dict = {}


class BytePieces(_Pieces):
    """Ids, as little-endian 32-bit numbers, for a byte-level vocabulary.

    A piece after the first carries the space before it, and only its first token begins with one.
    """

    def __init__(self, vocabulary: str):
        super().__init__(vocabulary)
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(entries.values()) + 1, bool)
        self.begins[[n for token, n in entries.items() if token.startswith("\u0120")]] = True
        from tokenizers import pre_tokenizers

        # A word of letters is a word of the vocabulary, so that the library need not look for words in them.
        tokenizer = self.tokenizer
        plain = tokenizer.normalizer is None and type(tokenizer.pre_tokenizer) is pre_tokenizers.ByteLevel
        self.words = type(tokenizer)(tokenizer.model) if plain else None
        if plain:
            self.words.pre_tokenizer = pre_tokenizers.Split("\u0120", "merged_with_next")

    def ids(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces of which each has a space before it."""
        found = dict.fromkeys(pieces)
        words = [p for p in pieces if p.isalpha()] if self.words else []
        found.update(self.apart(words, self.words))
        found.update(self.apart([p for p, ids in found.items() if ids is None and p], self.tokenizer))
        if "" in found:
            found[""] = self.ids(" ").tobytes()
        return [found[p] for p in pieces]

    def apart(self, pieces: list[str], tokenizer) -> Iterator[tuple[str, bytes]]:
        for k in range(0, len(pieces), LEARNT):
            part = pieces[k : k + LEARNT]
            text = " " + " ".join(part)
            if tokenizer is self.words:
                text = _BYTE_CHARACTERS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = self.ids(text, tokenizer)
            cuts = (4 * np.flatnonzero(self.begins[ids])).tolist() + [4 * len(ids)]
            raw = ids.tobytes()
            if len(cuts) != len(part) + 1:
                raise ValueError("a piece holds a space")
            yield from zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True)

    def held(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, which are kept from now on."""
        ids = list(map(self.kept.get, pieces))
        missing = [n for n, known in enumerate(ids) if known is None]
        if not missing:
            return ids
        if len(self.kept) + len(missing) > KEPT_PIECES:
            self.older = self.kept
            self.kept = {piece: known for piece, known in zip(pieces, ids, strict=True) if known is not None}
        fresh = []
        for n in missing:
            ids[n] = self.older.get(pieces[n])
            if ids[n] is None:
                fresh.append(n)
        for n, learnt in zip(fresh, self.learn([pieces[n] for n in fresh]), strict=True):
            ids[n] = learnt
        self.kept.update((pieces[n], ids[n]) for n in missing)
        return ids

    def values(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces. A line break between a sign or letter and a letter is a word of its own: what
        is before it has the ids of a piece, and it and what follows those of a piece less the space."""
        broken = pc.match_substring(pieces, "\n")
        at = pc.indices_nonzero(broken)
        at = at.filter(pc.match_substring_regex(pieces.take(at), r"[!-~]\n\pL[^\n]*$"))
        if not len(at):
            return self.signed(pieces)
        sides = pc.split_pattern(pieces.take(at), "\n", max_splits=1, reverse=True).flatten()
        left, right = (sides.take(pa.array(np.arange(side, len(sides), 2))) for side in (0, 1))
        right = pc.binary_join_element_wise(pa.scalar("\n", pieces.type), right, pa.scalar("", pieces.type))
        mask = np.zeros(len(pieces), bool)
        mask[at.to_numpy()] = True
        ids = self.signed(pa.concat_arrays([pc.replace_with_mask(pieces, pa.array(mask), left), right]))
        offsets, raw = _bytes_of(ids)
        after = _last_bytes(ids.slice(len(pieces)), np.diff(offsets[len(pieces) :]) - 4)
        return pc.binary_join_element_wise(ids.slice(0, len(pieces)), _at(at, after, len(pieces)), _NOTHING)

    def signed(self, pieces: pa.Array) -> pa.Array:
        """The ids of pieces: those of the letters, and those of the signs after them."""
        core = pc.utf8_rtrim(pieces, SIGNS)
        long, short = pc.binary_length(pieces), pc.binary_length(core)
        parted = pc.and_(pc.utf8_is_alpha(core), pc.less(short, long))
        cores = pc.if_else(parted, core, pieces).dictionary_encode()
        names = cores.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self.held(names), pa.large_binary()).take(cores.indices)
        # Signs are single bytes.
        at = pc.indices_nonzero(parted)
        signs = _last_bytes(pieces.take(at), pc.subtract(long, short).take(at).to_numpy()).dictionary_encode()
        tails = []
        for tail in signs.dictionary.to_pylist():
            if tail not in self.tails:
                if len(self.tails) >= KEPT_PIECES:
                    self.tails.clear()
                self.tails[tail] = self.ids(tail.decode()).tobytes()
            tails.append(self.tails[tail])
        tails = pa.array(tails, pa.large_binary()).take(signs.indices)
        return pc.binary_join_element_wise(ids, _at(at, tails, len(pieces)), _NOTHING)

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text; null is empty. Texts that are next to each other are cut into pieces together."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        all_bytes = max(1, int(size.sum()))
        group = (np.cumsum(size) - size) * max(1, round(all_bytes / GROUP_BYTES)) // all_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from self._encoded(texts.slice(a, b - a))

    def _encoded(self, texts: pa.Array) -> list[bytes]:
        # A text with spaces in a row goes to the library as it is, like the first piece of any other.
        starts, pieces = _pieces_of(texts)
        empty = np.flatnonzero(np.diff(_bytes_of(pieces)[0]) == 0)
        text = np.searchsorted(starts, empty, "right") - 1
        odd = np.zeros(len(texts), bool)
        odd[text[(empty > starts[text]) & (empty < starts[text + 1] - 1)]] = True
        if odd.any():
            starts, pieces = _pieces_of(pc.if_else(pa.array(odd), "", texts))
        heads = pc.if_else(pa.array(odd), texts, pieces.take(pa.array(starts[:-1]))).to_pylist()
        first = self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)
        rest = np.ones(len(pieces), bool)
        rest[starts[:-1]] = False
        coded = pieces.filter(pa.array(rest)).dictionary_encode()
        ids = self.values(coded.dictionary)
        place = np.empty(len(pieces), np.int32)
        place[rest] = coded.indices.to_numpy()
        place[~rest] = np.arange(len(ids), len(ids) + len(first))
        heads = pa.array([np.array(head.ids, "<u4").tobytes() for head in first], pa.large_binary())
        offsets, raw = _bytes_of(pa.concat_arrays([ids, heads]).take(pa.array(place)))
        ends = offsets[starts].tolist()
        return [raw[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


class WordPieces(_Pieces):
    """Token counts of words, for a vocabulary that drops white space."""

    @staticmethod
    def parted(piece: bytes) -> tuple[bytes, bytes]:
        core = piece.rstrip(SIGNS.encode())
        # The library's normal form must be letters too: some letters get a mark in lower case.
        letters = core.isalpha() or unicodedata.normalize("NFC", core.decode("utf-8", "replace")).lower().isalpha()
        return (core, piece[len(core) :]) if letters else (piece, b"")

    def alone(self, tail: bytes) -> int:
        return len(self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids)

    def learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        spans = self.tokenizer.encode(" ".join(texts), add_special_tokens=False).offsets
        first = np.fromiter((s for s, _ in spans), np.int64, len(spans))
        counts = np.diff(np.searchsorted(first, starts)).tolist()
        self.kept.update(zip(pieces, counts, strict=True))

    def known(self, group: list[list]) -> dict:
        """The kept pieces, among them all of the group."""
        wanted = set().union(*group)
        missing = wanted.difference(self.kept)
        if missing:
            if len(self.kept) + len(missing) > KEPT_PIECES:  # two generations: pieces in use survive
                self.kept, self.older = {}, self.kept
                missing = wanted
            again = {p: self.older[p] for p in missing if p in self.older}
            self.kept.update(again)
            missing.difference_update(again)
            joined, plain = {}, set()
            signs = SIGNS.encode()
            for piece in missing:
                if piece.rstrip(signs) == piece:  # most pieces
                    plain.add(piece)
                    continue
                core, tail = self.parted(piece)
                if tail:
                    joined[piece] = core, tail
                    plain.add(core)
                else:
                    plain.add(piece)
            pieces = sorted(plain.difference(self.kept))
            for k in range(0, len(pieces), 2000):
                self.learn(pieces[k : k + 2000])
            kept = self.kept
            for piece, (core, tail) in joined.items():
                if tail not in self.tails:
                    if len(self.tails) >= KEPT_PIECES:
                        self.tails.clear()
                    self.tails[tail] = self.alone(tail)
                kept[piece] = kept[core] + self.tails[tail]
        return self.kept

    def counts(self, group: list[list[bytes]]) -> list[np.ndarray]:
        get = self.known(group).__getitem__
        return [np.fromiter(map(get, parts), np.int32, len(parts)) for parts in group]


@cache
def byte_pieces(vocabulary: str) -> BytePieces:
    """One for each Python worker: a worker keeps its pieces from task to task."""
    return BytePieces(vocabulary)


@cache
def word_pieces(vocabulary: str) -> WordPieces:
    """As :func:`byte_pieces`."""
    return WordPieces(vocabulary)
