"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct pre-tokens are put into a trie of bytes in sorted order.  Each node stores the last token
of the BPE encoding of its prefix and the node where that token begins.  The last token of a longer
prefix is the only vocabulary entry ending there that BPE leaves standing beside the last token of
the prefix before it, so every shared prefix is encoded once and an encoding is read off backwards.

Contract: null texts are empty; empty texts give no ids and the empty decoded string; texts of any
length are read whole; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_values, slices, text_batches
from .subword import ChunkCache, byte_alphabet, flat

_FOREVER = 1 << 40


class TrieBpe:
    """A word-end BPE vocabulary (model part of a ``tokenizers`` file) encoded through a trie."""

    def __init__(self, path: str, most_nodes: int = 120_000) -> None:
        import regex

        self.most_nodes = most_nodes
        self._plant()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        back = {c: b for b, c in byte_alphabet().items()}
        self.strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.rank = {i: -1 for i in vocab.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.texts = [self.strings.get(i, "").encode() for i in range(max(self.strings) + 1)]
        for r, (a, b) in enumerate(merges):
            t = vocab[a + b]
            self.pair_rank[vocab[a], vocab[b]] = r
            if t not in self.parts:
                self.rank[t], self.parts[t] = r, (vocab[a], vocab[b])
        #: bytes -> id of tokens inside a word, and of tokens that end one
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for s, i in vocab.items():
            ends = s.endswith(self.suffix) and self.suffix != ""
            core = s[: -len(self.suffix)] if ends else s
            if core and all(c in back for c in core):
                (self.final if ends else self.inner)[bytes(back[c] for c in core)] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pretoken = regex.compile(pattern)
        self.space = regex.compile(r"\p{White_Space}+")
        self._beside: dict[int, bool] = {}
        self._spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._whole: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge of a token while BPE builds it, each with the rank at which it is consumed."""
        out, gone, first = [], _FOREVER, token
        while True:
            out.append((token, gone))
            if token not in self.parts:
                self._spines[side][first] = out
                return out
            gone = self.rank[token]
            token = self.parts[token][side]

    def beside(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` standing next to each other.

        Merges run in rank order and each consumes symbols of lower rank, so a pair across the border
        is merged exactly if its rank comes before both of its symbols are consumed on their own side
        (at equal rank the leftmost goes first).
        """
        key = left << 20 | right
        known = self._beside.get(key)
        if known is None:
            rank, edge = self.pair_rank.get, self._spines[0].get(right) or self._spine(right, 0)
            known = True
            for a, a_gone in self._spines[1].get(left) or self._spine(left, 1):
                for b, b_gone in edge:
                    r = rank((a, b))
                    if r is not None and r < a_gone and r <= b_gone:
                        known = False
            self._beside[key] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether BPE makes exactly this token of its own characters."""
        if token not in self._whole:
            parts = self.parts.get(token)
            self._whole[token] = parts is None or (self.whole(parts[0]) and self.whole(parts[1]) and self._made(token, *parts))
        return self._whole[token]

    def _made(self, token: int, left: int, right: int) -> bool:
        mine = self.rank[token]
        return not any(
            (r := self.pair_rank.get((a, b))) is not None and r != mine and r < min(a_gone, mine) and r <= b_gone for a, a_gone in self._spine(left, 1) for b, b_gone in self._spine(right, 0)
        )

    def _plant(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.last, self.begin, self.depth = [-1], [0], [0]  # per node: last token of its prefix, node where that begins, length

    def _settle(self, text: bytes, end: int, path: list[int], table: dict[bytes, int]) -> tuple[int, int]:
        """The last token of ``text[:end]`` and the node where it begins.

        Exactly one token fits, so the likeliest lengths go first: the last token of the prefix before
        it grown by one byte, shorter ones, then longer ones.
        """
        before = path[end - 1]
        size = end - self.depth[self.begin[before]]
        for n in (*range(size, 0, -1), *range(size + 1, min(end, self.longest) + 1)):
            token = table.get(text[end - n : end])
            if token is not None and ((start := path[end - n]) == 0 or self.beside(self.last[start], token)) and self.whole(token):
                return token, start
        raise ValueError(f"no token ends at {end} of {text!r}")

    def encode_pretokens(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token.  The trie is kept for later calls until it has ``most_nodes`` nodes."""
        if len(self.last) > self.most_nodes:
            self._plant()
        if len(self._beside) > self.most_nodes:
            self._beside.clear()
        encoded = [w.encode() for w in words]
        child, last, begin, depths, settle, inner = self.child, self.last, self.begin, self.depth, self._settle, self.inner
        final = self.final if self.suffix else inner
        out: list[list[int]] = [[]] * len(encoded)
        for i in sorted(range(len(encoded)), key=encoded.__getitem__):
            text = encoded[i]
            if not text:
                continue
            node, path = 0, [0]
            for depth in range(1, len(text)):
                key = node * 256 + text[depth - 1]
                to = child.get(key)
                if to is None:
                    token, start = settle(text, depth, path, inner)
                    to = child[key] = len(last)
                    last.append(token)
                    begin.append(start)
                    depths.append(depth)
                path.append(to)
                node = to
            token, start = settle(text, len(text), path, final)
            ids = [token]
            while start:
                ids.append(last[start])
                start = begin[start]
            ids.reverse()
            out[i] = ids
        return out

    def encode_general(self, chunks: list[str]) -> list[list[int]]:
        """Chunks of any characters, special tokens among them."""
        pieces: list[list[int | str]] = []
        for chunk in chunks:
            row: list[int | str] = []
            for part in self.special_split.split(chunk) if self.special_split else [chunk]:
                if part in self.specials:
                    row.append(self.specials[part])
                elif part:
                    text = self.space.sub(" ", unicodedata.normalize("NFC", part))
                    row += self.pretoken.findall("".join(c.lower() for c in text))
            pieces.append(row)
        words = list({p for row in pieces for p in row if isinstance(p, str)})
        known = dict(zip(words, self.encode_pretokens(words)))
        return [[i for p in row for i in ([p] if isinstance(p, int) else known[p])] for row in pieces]


_models: dict[str, tuple[TrieBpe, ChunkCache]] = {}


def trie_cache(path: str) -> tuple[TrieBpe, ChunkCache]:
    """This worker's vocabulary and chunk cache."""
    if path not in _models:
        model = TrieBpe(path)
        _models[path] = model, ChunkCache(lambda words: flat(model.encode_pretokens(words)), lambda chunks: flat(model.encode_general(chunks)))
    return _models[path]


def packed(arrays: list[np.ndarray]) -> pa.Array:
    """Id arrays as little-endian unsigned 32-bit integers, one binary value each."""
    return pa.array([a.astype("<u4", copy=False).tobytes() for a in arrays], pa.binary())


def decoded(ids: pa.Array, strings: list[bytes]) -> pa.Array:
    """The texts of packed ids: their tokens with a space between them, special tokens kept."""
    get = strings.__getitem__
    return pa.array([b" ".join(map(get, np.frombuffer(x, "<u4").tolist())) for x in binary_values(ids)], pa.binary()).cast(pa.string())


def _mapped(df: DataFrame, column: str, added: list[T.StructField], make: Callable[[pa.Array], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns in ``keep`` (all, if not given) and ``added``, which win over clashing names."""
    text_batches(df.sparkSession)
    names = {f.name for f in added}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, 2 << 20, column):
            of = dict(zip(batch.schema.names, batch.columns))
            yield pa.RecordBatch.from_arrays([of[c] for c in keep] + make(of[column]), names=schema.names)

    return df.select(*{*keep, column}).mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``: the ids of ``text`` packed as little-endian unsigned 32-bit integers."""
    return _mapped(df, text, [T.StructField(out, T.BinaryType())], lambda texts: [packed(trie_cache(tokenizer_path)[1].encode(texts))])


def decode(df: DataFrame, tokenizer_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of packed ids, special tokens kept."""
    return _mapped(df, ids, [T.StructField(out, T.StringType())], lambda x: [decoded(x, trie_cache(tokenizer_path)[0].texts)])


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Add ``token_ids`` and ``decoded``, as ``encode`` and then ``decode`` do, in one pass through Python."""

    def both(texts: pa.Array) -> list[pa.Array]:
        model, cache = trie_cache(tokenizer_path)
        ids = packed(cache.encode(texts))
        return [ids, decoded(ids, model.texts)]

    return _mapped(df, text, [T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())], both)


def coded(df: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256, and with ``ids`` the packed token_ids.

    Texts are decoded from their ids and hashed where they are encoded, so decoded texts are never sent.
    """

    def digest(texts: pa.Array) -> list[pa.Array]:
        model, cache = trie_cache(tokenizer_path)
        get, n, of_ids, of_text, packed_ids = model.texts.__getitem__, [], [], [], []
        for a in cache.encode(texts):
            raw = a.astype("<u4", copy=False).tobytes()
            n.append(len(a))
            of_ids.append(hashlib.sha256(raw).hexdigest())
            of_text.append(hashlib.sha256(b" ".join(map(get, a.tolist()))).hexdigest())
            if ids:
                packed_ids.append(raw)
        out = [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        return [*out, pa.array(packed_ids, pa.binary())] if ids else out

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(df, text, [*added, T.StructField("token_ids", T.BinaryType())] if ids else added, digest, keep)


def digests(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    return coded(documents, tokenizer_path, keep=["doc_id"], ids=False)
