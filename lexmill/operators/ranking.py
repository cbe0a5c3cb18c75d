"""BM25 for a bounded set of queries in two passes over a corpus, without a row for each pair.

The queries' terms go to all tasks.  The first pass counts in how many documents each of them stands; the second scores
a batch of documents against all queries at once and keeps, for every query, what can still be among its best.  So a
task passes on a few rows a query, however common a term is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T

K1, B = 1.5, 0.75
#: Most distinct terms, and pairs of a query and a term, that are sent to all executors (about 100 bytes each).
MOST_TERMS, MOST_PAIRS = 200_000, 1_000_000
#: Scores that a task holds at once.
CELLS = 2_000_000
#: Scores are rounded to six places by the caller, so what lies so near to the k-th may still come before it.
NEAR = 2e-6
_CJK, _WORD, _RUN = re.compile("[一-鿿]"), re.compile("[a-z0-9]{2,}"), re.compile("[一-鿿]+|[a-z0-9]{2,}")


def tokens(text: str) -> list[str]:
    """What ``functions.text.tokens`` gives, in some order."""
    low = text.lower()
    if not _CJK.search(text):
        return _WORD.findall(low)
    out: list[str] = []
    for run in _RUN.findall(low):
        if run[0] < "一":
            out.append(run)
        else:
            out += [run[i : i + n] for n in (1, 2, 3) for i in range(len(run) - n + 1)]
    return out


def counted(corpus: DataFrame, text: str = "text", most: int = 400_000) -> DataFrame:
    """(term, df, cf) of a corpus: a task adds up what it reads and passes on one row a term, now and then where there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        cf: Counter[str] = Counter()

        def sums() -> Iterator[pa.RecordBatch]:
            names = list(cf)
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([df[t] for t in some], pa.int64()), pa.array([cf[t] for t in some], pa.int64())], names=["term", "df", "cf"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    found = tokens(t)
                    cf.update(found)
                    df.update(set(found))
            if len(cf) > most:
                yield from sums()
                df.clear()
                cf.clear()
        yield from sums()

    rows = corpus.select(F.col(text).alias("text")).mapInArrow(run, "term string, df long, cf long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def asked(queries: DataFrame, query_key: str) -> tuple[list, dict[str, list[tuple[int, int]]]] | None:
    """The queries' keys, and for each term the places of the queries that have it and how often; None if that is not bounded."""
    rows = queries.select(query_key, F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qf"))
    if rows.limit(MOST_PAIRS + 1).count() > MOST_PAIRS:
        return None
    keys: dict = {}
    terms: dict[str, list[tuple[int, int]]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r[query_key] is None, r[query_key], r["term"])):
        terms.setdefault(r["term"], []).append((keys.setdefault(r[query_key], len(keys)), r["qf"]))
    return (list(keys), terms) if len(terms) <= MOST_TERMS else None


class Best:
    """For every query what can be among its ``k`` best so far: values, and keys of documents."""

    def __init__(self, queries: int, k: int, exact: bool) -> None:
        self.k, self.exact = k, exact
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]
        self.floor = np.full(queries, -np.inf)

    def add(self, values: np.ndarray, keys: list) -> None:
        """Values (documents, queries); those of 0 are no hits."""
        docs, queries = np.nonzero((values > 0) & (values >= self.floor))
        for d, q, v in zip(docs.tolist(), queries.tolist(), values[docs, queries].tolist()):
            self.rows[q].append((-v, keys[d] is None, keys[d]))
        for q in np.unique(queries).tolist():
            if len(self.rows[q]) > 4 * self.k:
                self.cut(q)

    def cut(self, q: int) -> None:
        some = sorted(self.rows[q])
        if len(some) > self.k:
            kth = -some[self.k - 1][0]
            # of equal exact values the least keys count, and others may be equal once they are rounded
            some = some[: self.k] if self.exact else [r for r in some if -r[0] >= kth - NEAR]
            self.floor[q] = kth if self.exact else kth - NEAR
        self.rows[q] = some

    def left(self, kind: int) -> Iterator[tuple]:
        for q in range(len(self.rows)):
            self.cut(q)
            yield from ((kind, q, key, -v) for v, _, key in self.rows[q])


def candidates(queries: DataFrame, corpus: DataFrame, k: int, query_key: str = "item_id", key: str = "doc_id", overlap: bool = False) -> DataFrame | None:
    """(kind, query_key, key, value): by BM25 (kind 0) and, if asked for, by the number of shared terms (kind 1), at least the ``k`` best of each query.

    None where the queries' terms are not bounded.  Query terms count as often as they occur; a null text counts as a
    document without length.
    """
    spark = corpus.sparkSession
    found = asked(queries, query_key)
    if found is None:
        return None
    keys, terms = found
    kind = {c: d.schema[c].dataType.simpleString() for c, d in ((query_key, queries), (key, corpus))}
    names = spark.createDataFrame([(i, x) for i, x in enumerate(keys)], f"q int, {query_key} {kind[query_key]}")
    number = {t: i for i, t in enumerate(terms)}
    known = spark.sparkContext.broadcast(number)

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[int] = Counter()
        rows = texts = length = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                rows += 1
                if t is not None:
                    toks = tokens(t)
                    texts, length = texts + 1, length + len(toks)
                    df.update({known.value[x] for x in toks if x in known.value})
        out = [*df.items(), (-1, rows), (-2, texts), (-3, length)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64())], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in corpus.select("text").mapInArrow(statistics, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, average = sums.get(-1, 0), max(sums.get(-3, 0) / max(sums.get(-2, 0), 1), 1.0)
    df = np.array([sums.get(i, 0) for i in range(len(terms))], float)
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
    sizes = np.array([len(p) for p in terms.values()], np.int64)
    owners, times = np.array([q for p in terms.values() for q, _ in p], np.int64), np.array([f for p in terms.values() for _, f in p], float)
    sent = spark.sparkContext.broadcast((idf, sizes, np.cumsum(sizes) - sizes, owners, times))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sizes, starts, owners, times = sent.value
        queries_n = len(keys)
        best = [Best(queries_n, k, False)] + [Best(queries_n, k, True)] * overlap
        step = max(1, CELLS // max(queries_n, 1))
        arrow = None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                own = some.column(0).to_pylist()
                doc, term, tf, dl = [], [], [], []
                for i, t in enumerate(some.column(1).to_pylist()):
                    toks = tokens(t or "")
                    held = Counter(known.value[x] for x in toks if x in known.value)
                    doc += [i] * len(held)
                    term += held.keys()
                    tf += held.values()
                    dl += [len(toks)] * len(held)
                if not doc:
                    continue
                term_, tf_ = np.array(term, np.int64), np.array(tf, float)
                gain = idf[term_] * (tf_ * (K1 + 1) / (tf_ + K1 * (1 - B + B * np.array(dl, float) / average)))
                n_ = sizes[term_]
                place = np.arange(n_.sum()) - np.repeat(np.cumsum(n_) - n_, n_) + np.repeat(starts[term_], n_)
                cell = np.repeat(np.array(doc, np.int64), n_) * queries_n + owners[place]
                shape = (some.num_rows, queries_n)
                best[0].add(np.bincount(cell, np.repeat(gain, n_) * times[place], some.num_rows * queries_n).reshape(shape), own)
                if overlap:
                    best[1].add(np.bincount(cell, minlength=some.num_rows * queries_n).reshape(shape).astype(float), own)
        if arrow is not None:
            rows = [r for i, b in enumerate(best) for r in b.left(i)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], arrow), pa.array([r[3] for r in rows], pa.float64())], names=["kind", "q", key, "value"])

    rows = corpus.select(key, "text").mapInArrow(score, f"kind int, q int, {key} {kind[key]}, value double")
    return rows.join(F.broadcast(names), "q").select("kind", query_key, key, "value")
