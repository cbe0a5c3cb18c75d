"""Chunk-cached subword encoding for tokenizers whose pre-tokens never span white space.

A text is cut at ASCII white space; each distinct chunk is encoded once per Python worker, and a
text's ids are gathered from that cache with numpy.  Who encodes a missing chunk is a parameter:
the ``tokenizers`` library (``LibraryEncoder``) or the trie of ``bpe_trie``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed values of word_bpe_49k.json: its pre-token pattern over Latin-1 lower-case text, with a line feed between chunks.
LATIN_PRETOKENS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\s\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_LATIN = re.compile(r"[\x00-\x1b\x20-\xff]*")

#: What encodes a list of strings: their ids one after the other, and how many each has.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of byte-level vocabularies, built from their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Rows(defaultdict):
    """Key -> row; a missing key gets the next row.  Keys keep their order, so the new ones are the last."""

    def __init__(self, fixed: dict | None = None, first: int = 0) -> None:
        self.numbers = count(first)
        super().__init__(self.numbers.__next__, fixed or {})
        self.known = len(self)

    def taken(self) -> list:
        """The keys that came since the last call, in order."""
        out = list(islice(reversed(self), len(self) - self.known))[::-1]
        self.known = len(self)
        return out

    def skip(self, n: int) -> int:
        """The first of ``n`` rows, one at least, that no key gets."""
        first = next(self.numbers)
        next(islice(self.numbers, n - 1, n - 1), None)
        return first


class _Store:
    """Growable rows of integers, gathered with numpy."""

    def __init__(self, dtype: type) -> None:
        self.values, self.offsets, self.lengths = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.n = self.used = 0

    def append(self, values: np.ndarray, lengths: np.ndarray) -> None:
        while self.n + len(lengths) > len(self.lengths):
            self.offsets, self.lengths = np.resize(self.offsets, 2 * len(self.offsets)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(values) > len(self.values):
            self.values = np.resize(self.values, 2 * len(self.values))
        self.values[self.used : self.used + len(values)] = values
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.offsets[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.n += len(lengths)
        self.used += len(values)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the rows one after the other, and how many each has."""
        lengths = self.lengths[rows].astype(np.int64)
        ends = np.cumsum(lengths)
        return self.values[np.repeat(self.offsets[rows] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


def lengths_to_bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


class ChunkCache:
    """Encodes texts by their white-space chunks, and those by their pre-tokens.

    ``pretokens`` encodes pre-tokens, ``general`` whole chunks that are not plain Latin-1.  The cache
    is dropped when what it holds comes to ``most_bytes``, whatever the corpus' vocabulary; one batch
    of texts more than that is the most it ever takes.
    """

    #: About what a key takes beside its own bytes: its objects, and its entries in dictionary and stores.
    PER_KEY = 160

    def __init__(self, pretokens: Encoder, general: Encoder, most_bytes: int = 64 << 20) -> None:
        self.pretokens, self.general, self.most_bytes = pretokens, general, most_bytes
        self.clear()

    def held(self) -> int:
        return self.PER_KEY * (len(self.rows) + len(self.parts)) + self.key_bytes + 4 * (self.chunk_store.used + self.id_store.used)

    def clear(self) -> None:
        self.rows, self.parts = _Rows(), _Rows({"\n": -1})
        self.chunk_store, self.id_store = _Store(np.int32), _Store(np.uint32)
        self.key_bytes = 0

    def _resolve(self, pending: list[bytes]) -> None:
        if not pending:
            return
        self.key_bytes += 2 * sum(map(len, pending))  # its pre-tokens are about as long again
        joined = b"\n".join(pending).decode("utf-8", "replace")
        if _LATIN.fullmatch(joined) and "<|" not in joined:
            tokens = LATIN_PRETOKENS.findall(joined.lower())
            parts = np.fromiter(map(self.parts.__getitem__, tokens), np.int32, len(tokens))
            self._encode_parts()
            cuts = np.flatnonzero(parts == -1)
            bounds = np.concatenate([[-1], cuts, [len(parts)]])
            self.chunk_store.append(parts[parts >= 0], np.diff(bounds) - 1)
            return
        for run in _runs(pending):
            if isinstance(run, list):
                ids, lengths = self.general(run)
                first = self.parts.skip(len(run))  # chunks of their own, never looked up by pre-token
                self.id_store.append(ids, lengths)
                self.chunk_store.append(np.arange(first, first + len(run), dtype=np.int32), np.ones(len(run), np.int64))
            else:
                self._resolve(list(run))

    def _encode_parts(self) -> None:
        missing = self.parts.taken()
        if missing:
            self.id_store.append(*self.pretokens(missing))

    def rows_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The cache rows of all chunks of the texts, and how many each text has.

        Arrow cuts the texts and numbers the distinct chunks of the batch, so Python sees each once.
        A text that is empty or begins or ends with white space also has empty chunks, which have no ids.
        """
        if self.held() > self.most_bytes:
            self.clear()
        words = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        distinct = pc.dictionary_encode(words.flatten())
        keys = distinct.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        rows = np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))
        self._resolve(self.rows.taken())
        return rows[distinct.indices.to_numpy()], pc.list_value_length(words).to_numpy().astype(np.int64)

    def encode_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks one after the other, and how many each chunk has."""
        parts, per_chunk = self.chunk_store.gather(rows)
        ids, per_part = self.id_store.gather(parts)
        sums = lengths_to_bounds(per_part)[lengths_to_bounds(per_chunk)]
        return ids, np.diff(sums)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        rows, counts = self.rows_of(texts)
        ids, per_chunk = self.encode_rows(rows)
        bounds = lengths_to_bounds(per_chunk)[lengths_to_bounds(counts)].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def _runs(chunks: list[bytes]) -> Iterator[tuple | list]:
    """Neighbouring chunks that are plain Latin-1 as tuples of bytes, others as lists of strings."""
    kind: bool | None = None
    run: list = []
    for c in chunks:
        text = c.decode("utf-8", "replace")
        plain = bool(_LATIN.fullmatch(text)) and "<|" not in text
        if kind is not None and plain != kind:
            yield tuple(run) if kind else run
            run = []
        kind = plain
        run.append(c if plain else text)
    if run:
        yield tuple(run) if kind else run


def flat(encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    return np.fromiter((i for x in encoded for i in x), np.uint32, int(lengths.sum())), lengths


class LibraryEncoder:
    """Pre-tokens and chunks encoded by the ``tokenizers`` library from a file of it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.spelling = {b: c for b, c in byte_alphabet().items() if b != 10}

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def pretokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens by the library's model alone: they are normalized and cut already, and spelled here in its bytes' alphabet."""
        spelled = "\n".join(words).encode().decode("latin-1").translate(self.spelling).split("\n")
        return flat([[t.id for t in self.model.tokenize(w)] for w in spelled])


_caches: dict = {}


def library_cache(path: str) -> ChunkCache:
    """This worker's cache over the library's encoder for the tokenizer file ``path``."""
    if path not in _caches:
        encoder = LibraryEncoder(path)
        _caches[path] = ChunkCache(encoder.pretokens, encoder.chunks)
    return _caches[path]
