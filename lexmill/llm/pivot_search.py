"""Exact top-k by inner product with a pivot table.

Vectors get one more component so that all of a block have the same norm; then a larger inner product is a smaller
distance.  Each block of candidates is packed into one row once, with pivots far from each other and the distances from
all its vectors to these; the greatest difference between a query's and a candidate's pivot distances bounds their
distance from below.  A query takes a block's candidates of the best bounds first, and then those that its k-th result does
not exclude, so nothing that could enter is left out.

A query does not begin a block with nothing: its scores with a bounded sample of all candidates give it a k-th score
that is already reached, and what cannot come to that is left out of every block.  Blocks of candidates and blocks of
queries meet in pairs of fixed size, on any number of machines.

Contract: components become floor(256 * x).  Vectors null or holding null or non-finite components take
no part; vectors of unequal length are not compared; a query's own row is every row of its id; equal
scores rank by the smaller vec_id; rows with a null vec_id take no part; repeated candidate rows are each
ranked; repeated query rows are one query; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_batches

#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 2048, 512
PIVOTS = 32
#: Candidates that a query meets before the others are left out by its k-th score.
LEAD = 64
#: Candidates of the sample that gives queries a first k-th score.
SEEDS = 4096
#: Most queries whose blocks are sent to all executors; more meet the candidates in a shuffle.
MOST_SENT = 20_000
#: Most tasks that blocks are dealt to.
MOST_TASKS = 8192
BLOCK = "dim int, n int, ids binary, vectors binary, pivots binary, distances binary"
ASKED = "dim int, asked int, query_ids binary, queries binary, reached binary"


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim and vector array<double> of whole numbers, for the rows that take part."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("double"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), x.alias("vector"))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; by Python integers where doubles could round."""
    if not a.shape[1] or a.shape[1] * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object)
    return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))])


def pivot_table(x: np.ndarray, pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Pivots, lifted, and the distances of all rows to them.  Each is the row furthest from those before it."""
    lifted = _lifted(x, (x * x).sum(axis=1).max(initial=0.0))
    if not len(x):
        return lifted, np.zeros((0, 0))
    chosen, columns = [], []
    near = _distances(lifted, lifted.mean(axis=0, keepdims=True))[:, 0]
    for _ in range(min(pivots, len(x))):
        chosen.append(int(near.argmax()))
        columns.append(_distances(lifted, lifted[chosen[-1:]])[:, 0])
        near = columns[0].copy() if len(columns) == 1 else np.minimum(near, columns[-1])
    return lifted[chosen], np.column_stack(columns)


def reached_scores(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among some candidates other than itself, -inf if there are fewer."""
    out = np.full(len(q), -np.inf)
    if len(x) and len(q):
        scores = np.where(ids[None, :] == query_ids[:, None], -np.inf, _exact(q, x).astype(float))
        if scores.shape[1] >= k:
            out = np.partition(scores, -k, axis=1)[:, -k]
    return out


def _leading(q: np.ndarray, x: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Inner products of each query with its own candidates."""
    if q.shape[1] * max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) < 2.0**53:
        return (x[lead] @ q[:, :, None])[:, :, 0].astype(np.int64)
    return np.stack([_exact(q[i : i + 1], x[row])[0] for i, row in enumerate(lead)])


def pivot_search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, table: tuple[np.ndarray, np.ndarray] | None = None, reached: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(query, candidate, score) of each query's k best among one block's candidates; and how many scores were computed.

    All queries of a block go together: each first meets the LEAD candidates of its best bounds, then, as one product of
    matrices, those whose bound does not lie under its k-th score by then.  Where ``reached`` says that a query has k
    scores of at least so much elsewhere, candidates whose bound lies below are left out from the start.
    """
    if not len(q) or not len(x) or k <= 0:
        return [], 0
    top = (x * x).sum(axis=1).max(initial=0.0)
    pivots, distances = pivot_table(x) if table is None else table
    q_norms = (q * q).sum(axis=1)[:, None]
    q_table = _distances(np.column_stack([q, np.zeros(len(q))]), pivots)
    bound, apart = np.zeros((len(q), len(x))), np.empty((len(q), len(x)))
    for p in range(len(pivots)):
        np.subtract(distances[:, p], q_table[:, p][:, None], out=apart)
        np.maximum(bound, np.abs(apart, out=apart), out=bound)
    # the inner product that a distance of the bound would give, with room for rounding
    most = (q_norms + top - bound * bound) / 2
    most += 1e-9 * (q_norms + top) + 1e-6
    most[ids[None, :] == query_ids[:, None]] = -np.inf
    if reached is not None:
        most[most < np.asarray(reached, float)[:, None]] = -np.inf
    scores, done = np.zeros(most.shape, np.int64), np.zeros(most.shape, bool)
    rows = np.arange(len(q))[:, None]
    lead = np.argpartition(-most, min(LEAD, len(x)) - 1, axis=1)[:, :LEAD]
    scores[rows, lead] = _leading(q, x, lead)
    done[rows, lead] = most[rows, lead] > -np.inf
    first = np.where(done, scores.astype(float), -np.inf)
    kth = np.partition(first, -k, axis=1)[:, -k] if len(x) >= k else np.full(len(q), -np.inf)
    rest = ~done & (most > -np.inf) & (most >= kth[:, None])
    if rest.any():
        some, columns = np.flatnonzero(rest.any(axis=1)), np.flatnonzero(rest.any(axis=0))
        part = np.ix_(some, columns)
        scores[part] = np.where(rest[part], _exact(q[some], x[columns]), scores[part])
        done |= rest
    out: list[tuple[int, int, int]] = []
    for i, query in enumerate(query_ids.tolist()):
        own = np.flatnonzero(done[i])
        if len(own) > k:
            own = own[scores[i, own] >= np.partition(scores[i, own], -k)[-k]]
        own = own[np.lexsort((ids[own], ~scores[i, own]))][:k]
        out += [(query, v, s) for v, s in zip(ids[own].tolist(), scores[i, own].tolist())]
    return out, int(done.sum())


def _matrix(t: pa.Table) -> np.ndarray:
    return np.array(t.column("vector").combine_chunks().flatten().to_numpy(), np.float64).reshape(t.num_rows, -1)


def _unpacked(value: bytes, rows: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(value, kind).reshape(rows, -1) if rows else np.zeros((0, 0), kind)


def candidate_blocks(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row a block and length of vectors: its ids and vectors, its pivots, and the distances to them."""

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x, ids = _matrix(t), t.column("vec_id").to_numpy()
        pivots, distances = pivot_table(x)
        row = [key[1].as_py(), len(x), ids.tobytes(), x.tobytes(), pivots.tobytes(), distances.tobytes()]
        return pa.table({n.split()[0]: [v] for n, v in zip(BLOCK.split(", "), row)}, schema=pa.schema([("dim", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "vectors", "pivots", "distances")]]))

    dealt = vectors.withColumn("c", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id(), F.lit(1)), F.lit(blocks)).cast("int"))
    return dealt.groupBy("c", "dim").applyInArrow(pack, BLOCK)


def query_blocks(queries: DataFrame, blocks: int, seeds: DataFrame, k: int) -> DataFrame:
    """One row a block and length of queries: ids, vectors, and the k-th scores that they reach among the seeds."""
    known: dict[int, tuple[list, list]] = {}
    for r in seeds.collect():
        ids, x = known.setdefault(r["dim"], ([], []))
        ids.append(r["vec_id"])
        x.append(r["vector"])
    sent = queries.sparkSession.sparkContext.broadcast({d: (np.array(i, np.int64), np.array(x, np.float64).reshape(len(i), -1)) for d, (i, x) in known.items()})

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        q, ids, dim = _matrix(t), t.column("vec_id").to_numpy(), key[1].as_py()
        seed_ids, x = sent.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, q.shape[1]))))
        row = [dim, len(q), ids.tobytes(), q.tobytes(), reached_scores(seed_ids, x, ids, q, k).tobytes()]
        return pa.table({n.split()[0]: [v] for n, v in zip(ASKED.split(", "), row)}, schema=pa.schema([("dim", pa.int32()), ("asked", pa.int32()), *[(c, pa.binary()) for c in ("query_ids", "queries", "reached")]]))

    dealt = queries.withColumn("q", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id(), F.lit(2)), F.lit(blocks)).cast("int"))
    return dealt.groupBy("q", "dim").applyInArrow(pack, ASKED)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best; both tables as ``quantised`` gives them."""
    text_batches(vectors.sparkSession)
    vectors, queries = cut(vectors, "vectors"), cut(queries.dropDuplicates(["vec_id", "vector"]), "queries")
    n, m = vectors.count(), queries.count()
    rows, columns = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    # rows of one id count once, so that a seed is not a query's own row and its double
    seeds = vectors.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SEEDS)
    blocks, asked = cut(candidate_blocks(vectors, rows), "blocks"), cut(query_blocks(queries, columns, seeds, k), "asked")
    if m <= MOST_SENT:
        pairs = blocks.repartition(min(rows, MOST_TASKS)).join(F.broadcast(asked), "dim")
    else:
        # every candidate block goes once to each of a number of tasks, which hold a part of the query blocks
        parts = columns
        dealt = asked.withColumn("part", F.pmod(F.xxhash64("query_ids"), F.lit(parts)))
        pairs = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt, ["part", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for r in range(batch.num_rows):
                at = {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}
                ids, x = np.frombuffer(at["ids"], np.int64), _unpacked(at["vectors"], at["n"])
                pivots = np.frombuffer(at["pivots"]).reshape(-1, x.shape[1] + 1)
                table = pivots, _unpacked(at["distances"], at["n"])
                found += pivot_search(ids, x, np.frombuffer(at["query_ids"], np.int64), _unpacked(at["queries"], at["asked"]), k, table, np.frombuffer(at["reached"]))[0]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
