"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into quantile bins.  Boosting goes round the features: each step fits
a shallow tree to one feature's gradient histogram and adds it to that feature's lookup table; pairs of
features chosen by the gain that a coarse grid leaves are then boosted the same way on two-way tables.
A text's score is the logistic of the sum of its bins' entries.

Contract: the score depends on the text alone.  Null texts score as empty ones; texts are read whole;
repeated rows are scored each; without labelled rows the score is one half.  Only the fit sees labels,
at most ``MOST_ROWS`` of them, those of least hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, slices, text_batches

#: Bound of the labelled sample that a model is fitted on.
MOST_ROWS = 20_000

_ASCII = np.arange(256)


def _class(*chars: str) -> np.ndarray:
    return np.isin(_ASCII, [ord(c) for s in chars for c in s])


_LOWER, _UPPER, _DIGIT = _class("abcdefghijklmnopqrstuvwxyz"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SPACE, _STOPS, _COMMAS, _LINE = _class(" \t\r\n\v\f"), _class(".?!"), _class(",;:"), _class("\n")
_HIGH = _ASCII >= 128
_SYMBOL = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _STOPS | _COMMAS | _HIGH)
_CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _SPACE, _STOPS, _COMMAS, _LINE, _HIGH, _SYMBOL, _class("|"), _class("!"), _class("$%#&*@^~"), _class("{}[]()<>=/\\_"), _class("-'\"")]).T.astype(np.float64)
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "distinct_words", "commonest_word", "longest_word", "short_words", "log_lines", "line_bytes", "distinct_lines", "entropy", "tripled", "capitalised", "stopped",
    "lower", "upper", "digit", "space", "stops", "commas", "line_feeds", "high", "symbol", "pipes", "shouts", "signs", "brackets", "dashes",
]


def _per_text(values: np.ndarray, bounds: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Means of runs of values; ``fill`` for empty runs."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    n = np.diff(bounds)
    return np.where(n > 0, (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1), fill)


def _distinct(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of codes the share of distinct ones and the share of the commonest."""
    share, top = np.ones(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        if b > a:
            run = np.sort(codes[a:b])
            steps = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
            share[i], top[i] = (len(steps) - 1) / (b - a), np.diff(steps).max() / (b - a)
    return share, top


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    texts = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])
    if not len(texts):
        return np.zeros((0, len(FEATURES)))
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    joined = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    histogram = np.stack([np.bincount(joined[a:b], minlength=256) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]).astype(np.float64)
    total = np.maximum(sizes, 1)[:, None]
    p = histogram / total
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    odd = ~(_LOWER | _UPPER | _DIGIT | _SPACE)[joined]
    tripled = np.zeros(len(joined))
    if len(joined) > 2:
        tripled[2:] = (joined[2:] == joined[1:-1]) & (joined[1:-1] == joined[:-2]) & odd[2:]
    words = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(words.flatten())
    codes, keys = coded.indices.to_numpy(), coded.dictionary
    per_key = pc.binary_length(keys).to_numpy().astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    capital = pc.match_substring_regex(keys, "^[A-Z]").to_numpy(zero_copy_only=False) if len(keys) else np.zeros(0, bool)
    stopped = pc.match_substring_regex(keys, "[a-z\\x{80}-\\x{10FFFF}][.?!]$").to_numpy(zero_copy_only=False) if len(keys) else np.zeros(0, bool)
    word_bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy().astype(np.int64))])
    lengths = per_key[codes]
    share, top = _distinct(codes, word_bounds)
    lines = pc.split_pattern(texts, "\n")
    line_codes = pc.dictionary_encode(lines.flatten()).indices.to_numpy()
    line_bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lines).to_numpy().astype(np.int64))])
    line_share, _ = _distinct(line_codes, line_bounds)
    n_words, n_lines = np.diff(word_bounds), np.diff(line_bounds)
    longest = np.array([lengths[a:b].max() if b > a else 0 for a, b in zip(word_bounds.tolist(), word_bounds[1:].tolist())])
    shape = [np.log1p(sizes), np.log1p(n_words), _per_text(lengths, word_bounds), share, top, np.log1p(longest), _per_text(lengths <= 3, word_bounds), np.log1p(n_lines), np.log1p(sizes / np.maximum(n_lines, 1)), line_share, entropy]
    shape += [_per_text(tripled, bounds), _per_text(capital[codes], word_bounds), _per_text(stopped[codes], word_bounds)]
    return np.column_stack([*shape, histogram @ _CLASSES / total])


def _leaves(gradient: np.ndarray, hessian: np.ndarray, ridge: float, least: float, splits: int) -> np.ndarray:
    """Values of a tree over ordered bins: up to ``splits`` cuts, each where the gain is greatest."""
    cuts = [0, len(gradient)]
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    for _ in range(splits):
        best, where = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            i = np.arange(a + 1, b)
            if len(i):
                gl, hl, gr, hr = g[i] - g[a], h[i] - h[a], g[b] - g[i], h[b] - h[i]
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
                gain[(hl < least) | (hr < least)] = 0
                if gain.max() > best:
                    best, where = gain.max(), int(i[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.empty(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


@dataclass
class Gam:
    """Lookup tables: one for each feature, and two-way ones for pairs of features."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features: additions of looked-up bins."""
        total = np.full(len(x), self.base)
        if self.tables and len(x):
            bins = self.bins(x)
            for j, t in enumerate(self.tables):
                total += t[bins[:, j]]
            for (i, j), t in zip(self.pairs, self.pair_tables):
                total += t[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return 1 / (1 + np.exp(-total))


def fit_gam(x: np.ndarray, y: np.ndarray, n_bins: int = 48, rounds: int = 120, rate: float = 0.15, ridge: float = 2.0, least: float = 1.0, n_pairs: int = 10, grid: int = 8, pair_rounds: int = 40) -> Gam:
    """Fit by cyclic boosting on the logistic loss."""
    model = Gam()
    if not len(y):
        return model
    prior = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(prior / (1 - prior)))
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    bins = model.bins(x)
    widths = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(w) for w in widths]
    model.coarse = [np.arange(w) * grid // w for w in widths]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _leaves(np.bincount(bins[:, j], g, widths[j]), np.bincount(bins[:, j], h, widths[j]), ridge, least, 2)
            table += step
            total += step[bins[:, j]]
    g, h = slopes()
    small = np.column_stack([model.coarse[j][bins[:, j]] for j in range(x.shape[1])])
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            cell = small[:, i] * grid + small[:, j]
            gc, hc = np.bincount(cell, g, grid * grid), np.bincount(cell, h, grid * grid)
            gains.append(((gc**2 / (hc + ridge)).sum(), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((grid, grid)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            cell = small[:, i] * grid + small[:, j]
            gc, hc = (np.bincount(cell, v, grid * grid).reshape(grid, grid) for v in (g, h))
            # a tree of two levels: the first feature's best cut, then the second's in either half
            first = _leaves(gc.sum(axis=1), hc.sum(axis=1), ridge, least, 1)
            cut = int(np.flatnonzero(np.diff(first))[0]) + 1 if (np.diff(first) != 0).any() else grid
            step = np.zeros((grid, grid))
            for part in (slice(0, cut), slice(cut, grid)):
                if part.start < part.stop:
                    step[part] = rate * _leaves(gc[part].sum(axis=0), hc[part].sum(axis=0), ridge, least, 1)
            table += step
            total += step[small[:, i], small[:, j]]
    return model


def with_features(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and an array of features of ``text``."""
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 1 << 20):
            of = dict(zip(batch.schema.names, batch.columns))
            x = features(of["text"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([of[c] for c in keep] + [lists], names=schema.names)

    return documents.select(*keep, "text").mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Gam:
    """Fit on labelled documents whose crc32(doc_id as text) mod 5 is not 0, at most ``most_rows`` of them."""
    learn = labels.where(crc32_mod("doc_id", 5) != 0).where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("__y"))
    learn = learn.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id", "__y").limit(most_rows)
    rows = with_features(documents.select("doc_id", "text").join(F.broadcast(learn), "doc_id").withColumnRenamed("__y", "y"), ["y"]).collect()
    x = np.array([r["features"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    y = np.array([r["y"] for r in rows], np.float64)
    order = np.lexsort([*x.T, y])  # rows arrive in any order
    return fit_gam(x[order], y[order])


def score(documents: DataFrame, model: Gam, out: str = "score") -> DataFrame:
    """Add ``out``, the probability that a document is good; all other columns are kept."""
    keep = [c for c in documents.columns if c != out]
    text_batches(documents.sparkSession)
    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256, 1 << 20):
            of = dict(zip(batch.schema.names, batch.columns))
            yield pa.RecordBatch.from_arrays([of[c] for c in keep] + [pa.array(model.score(features(of["text"])))], names=schema.names)

    return documents.select(*keep).mapInArrow(run, schema)


def predictions(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
