"""Token counts by a unigram model with prefix-sharing forward scores.

Distinct pre-tokens (white-space words behind the word mark) go into a trie of characters.  Each node has the
best log probability of segmenting its prefix and the number of pieces in that segmentation, computed once
from its ancestors; a word's count and score are those of the node where it ends.

Pieces come from a public vocabulary; a piece's probability follows its rank there by Zipf's law, and bytes
stand in, at the probability of the last rank, for characters without a piece.  Of equal scores the fewer
pieces win, then the longer last piece.

Contract: words are ``[^\\x20\\x09-\\x0D]+``; null and empty texts have no words and no tokens; texts of any
length are read whole; other columns are left out; repeated rows are counted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_batches

MARK = "▁"


def zipf_pieces(path: str) -> tuple[dict[str, float], float]:
    """Log probability of each piece of a sentencepiece model by its rank, and that of a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    own.sort(key=lambda i: (-model.get_score(i), i))
    constant = math.log(sum(1 / (r + 1) for r in range(len(own))))
    return {model.id_to_piece(i): -math.log(r + 1) - constant for r, i in enumerate(own)}, -math.log(len(own) + 1) - constant


class TrieCounter:
    """Word -> (score, count), with a cache of words and a trie that are dropped when they have grown too large."""

    def __init__(self, pieces: dict[str, float], byte_score: float, most_nodes: int = 300_000, most_words: int = 500_000) -> None:
        self.pieces, self.byte_score, self.most_nodes, self.most_words = pieces, byte_score, most_nodes, most_words
        self.longest: dict[str, int] = {}  # by last character
        for p in pieces:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        self.plant()
        self.clear()

    def plant(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.best, self.count = [0.0], [0]

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.scores, self.counts = np.zeros(1 << 14), np.zeros(1 << 14, np.int32)

    def _settle(self, text: str, end: int, path: list[int]) -> tuple[float, int]:
        last = text[end - 1]
        score, count = -math.inf, 0
        pieces, best, counts = self.pieces, self.best, self.count
        for size in range(min(end, self.longest.get(last, 0)), 0, -1):
            p = pieces.get(text[end - size : end])
            if p is not None:
                node = path[end - size]
                s, n = best[node] + p, counts[node] + 1
                if s > score or (s == score and n < count):
                    score, count = s, n
        if last not in pieces:
            node, size = path[end - 1], len(last.encode("utf-8", "replace"))
            s, n = best[node] + size * self.byte_score, counts[node] + size
            if s > score:
                score, count = s, n
        return score, count

    def segment(self, words: list[str]) -> list[tuple[float, int]]:
        """Score and count of each word, the mark put before it."""
        if len(self.best) > self.most_nodes:
            self.plant()
        child, best, count = self.child, self.best, self.count
        out: list[tuple[float, int]] = [(0.0, 0)] * len(words)
        for i in sorted(range(len(words)), key=words.__getitem__):
            text = MARK + words[i]
            node, path = 0, [0]
            for depth, c in enumerate(text, 1):
                to = child[node].get(c)
                if to is None:
                    score, n = self._settle(text, depth, path)
                    to = child[node][c] = len(best)
                    child.append({})
                    best.append(score)
                    count.append(n)
                path.append(to)
                node = to
            out[i] = best[node], count[node]
        return out

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """Rows in ``scores`` and ``counts`` of distinct words; the empty one has none of either."""
        if len(self.words) > self.most_words:
            self.clear()
        words, fresh = self.words, []
        rows = np.empty(len(keys), np.int64)
        for i, k in enumerate(keys):
            row = words.get(k)
            if row is None:
                row = words[k] = len(words)
                fresh.append(k)
            rows[i] = row
        if fresh:
            first = len(words) - len(fresh)
            while len(words) > len(self.scores):
                self.scores, self.counts = np.resize(self.scores, 2 * len(self.scores)), np.resize(self.counts, 2 * len(self.counts))
            made = self.segment([k.decode("utf-8", "replace") for k in fresh])
            for j, (k, (s, n)) in enumerate(zip(fresh, made), first):
                self.scores[j], self.counts[j] = (s, n) if k else (0.0, 0)
        return rows


_counters: dict[str, TrieCounter] = {}


def counts(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens and the log probability of the best segmentation of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _counters:
            _counters[model_path] = TrieCounter(*zipf_pieces(model_path))
        counter = _counters[model_path]
        for batch in slices(batches):
            words = pc.ascii_split_whitespace(batch.column(1).cast(pa.string()).fill_null(""))
            coded = pc.dictionary_encode(words.flatten())
            keys = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
            of_key, codes = counter.rows_of(keys), coded.indices.to_numpy()
            rows = of_key[codes]
            real = np.array([bool(k) for k in keys], bool)[codes] if len(keys) else np.zeros(0, bool)
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy().astype(np.int64))])
            sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[bounds])
            scores = [math.fsum(part) for part in np.split(counter.scores[rows], bounds[1:-1])] if len(bounds) > 1 else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums(real), pa.int64()), pa.array(sums(counter.counts[rows].astype(np.int64)), pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "log_prob"]
            )

    text_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_prob double")
