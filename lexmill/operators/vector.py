"""Vector search: exact nearest neighbours in blocks, thresholds, inverted lists by k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.lexical import top_k
from lexmill.operators.rows import per_row
from lexmill.stage import cut

#: Vectors of a block, queries of a block, and query blocks that a task holds (10 MB at 64 components).
ROWS, BLOCK, HELD = 4096, 1024, 20
PACKED = "dim int, n int, ids binary, matrix binary"
#: Components that a task holds while it packs blocks list by list, and rows of queries by list up to which their blocks are broadcast.
PACKING, SENT = 4_000_000, 4 * BLOCK * HELD


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is there and holds numbers alone."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(fine, F.lit(False)))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors (vec_id, embedding) of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dim))
                for at in range(0, own.num_rows, size):
                    part = own.slice(at, size)
                    matrix = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64)
                    values = [dim, part.num_rows, np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64).tobytes(), matrix.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["dim", "n", "ids", "matrix"])

    return rows.mapInArrow(run, PACKED)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", least: float | None = None, places: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank): ``cosine`` and ``ip`` rank by the larger product, ``l2`` by the smaller distance.

    Blocks of queries meet blocks of vectors, each pair one product of matrices.  A task holds a bounded number of query
    blocks and passes on the ``k`` best that it has seen for each of their queries; where there are more, the vectors
    go to several groups of tasks.  Vectors of unequal length are not compared; those that hold nulls or no numbers take
    no part.
    """
    asked = usable(queries).select("vec_id", "embedding")
    n = asked.count()
    parts = max(1, -(-n // (BLOCK * HELD)))
    blocks = _packed(asked.repartition(max(1, -(-n // BLOCK))), BLOCK).select("dim", F.col("n").alias("asked"), F.col("ids").alias("query_ids"), F.col("matrix").alias("queries"))
    rows = _packed(usable(vectors).select("vec_id", "embedding"), ROWS)
    if parts == 1:
        pairs = rows.join(F.broadcast(blocks), "dim")
    else:
        dealt = blocks.withColumn("part", F.pmod(F.xxhash64("query_ids"), F.lit(parts)))
        pairs = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt, ["part", "dim"])
    found = pairs.mapInArrow(_scan(k, metric, least, places), "query_id long, vec_id long, score double")
    order = [F.col("score").asc() if metric == "l2" else F.col("score").desc(), "vec_id"]
    return top_k(found, k, ["query_id"], order)


def _scan(k: int, metric: str, least: float | None, places: int):
    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: of each query the scores and vectors that are its best so far; rows that repeat an id are one query
        best: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                at = {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}
                x, q = (np.frombuffer(at[c]).reshape(at[m], -1) for c, m in (("matrix", "n"), ("queries", "asked")))
                v, ids = np.frombuffer(at["ids"], np.int64), np.frombuffer(at["query_ids"], np.int64)
                if metric == "cosine":
                    x, q = unit(x), unit(q)
                s = q @ x.T
                if metric == "l2":
                    s = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * s
                s = np.round(s, places) + 0.0
                for i, query in enumerate(ids.tolist()):
                    name = query, q[i].tobytes()
                    key = s[i] if metric == "l2" else -s[i]
                    own = np.arange(len(v)) if len(v) <= k else np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])
                    own = own if least is None else own[s[i][own] >= least]
                    keys, found = key[own], v[own]
                    if name in best:
                        keys, found = np.concatenate([best[name][0], keys]), np.concatenate([best[name][1], found])
                    order = np.lexsort((found, keys))[:k]
                    best[name] = keys[order], found[order]
        sizes = [len(v) for _, v in best.values()]
        keys = np.concatenate([a for a, _ in best.values()]) if best else np.zeros(0)
        found = np.concatenate([v for _, v in best.values()]) if best else np.zeros(0, np.int64)
        asked = np.repeat(np.array([q for q, _ in best], np.int64), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(found), pa.array((keys if metric == "l2" else -keys) + 0.0)], names=["query_id", "vec_id", "score"])

    return run


def _packed_by_list(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors (vec_id, embedding, list) of one length and list, whatever the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        n: dict[tuple[int, int], int] = {}

        def blocks(key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            ids, matrix = (np.concatenate(x) for x in zip(*held.pop(key)))
            n.pop(key)
            for at in range(0, len(ids), size):
                values = [*key, len(ids[at : at + size]), ids[at : at + size].tobytes(), matrix[at : at + size].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["dim", "list", "n", "ids", "matrix"])

        for batch in batches:
            lengths, lists = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for key in sorted(set(zip(lengths.tolist(), lists.tolist()))):
                own = batch.filter(pa.array((lengths == key[0]) & (lists == key[1])))
                matrix = np.asarray(own.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(own.num_rows, key[0])
                held.setdefault(key, []).append((np.asarray(own.column(0).to_numpy(zero_copy_only=False), np.int64), matrix))
                n[key] = n.get(key, 0) + own.num_rows
                if n[key] >= size:
                    yield from blocks(key)
            if sum(rows * dim for (dim, _), rows in n.items()) > PACKING:
                for key in sorted(held):
                    yield from blocks(key)
        for key in sorted(held):
            yield from blocks(key)

    return rows.mapInArrow(run, "dim int, list int, n int, ids binary, matrix binary")


def knn_by_list(vectors: DataFrame, asked: DataFrame, k: int = 10, places: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank): the nearest by cosine of (vec_id, embedding, list) to (vec_id, embedding, list), a row for each list that a query looks into.

    Blocks of a list's queries meet blocks of its vectors, as in ``knn``.  Up to a bound the queries' blocks are broadcast;
    beyond it a task works on a list, or on a part of a list's queries.
    """
    asked = usable(asked).select("vec_id", "embedding", "list")
    sizes = [r["count"] for r in asked.groupBy("list").count().collect()]
    blocks = _packed_by_list(asked.repartition("list"), BLOCK).select("dim", "list", F.col("n").alias("asked"), F.col("ids").alias("query_ids"), F.col("matrix").alias("queries"))
    rows = _packed_by_list(usable(vectors).select("vec_id", "embedding", "list"), ROWS)
    if sum(sizes) <= SENT:
        pairs = rows.join(F.broadcast(blocks), ["dim", "list"])
    else:
        parts = -(-max(sizes) // (BLOCK * HELD))
        dealt = blocks.withColumn("part", F.pmod(F.xxhash64("query_ids"), F.lit(parts)))
        pairs = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt, ["part", "dim", "list"])
    found = pairs.mapInArrow(_scan(k, "cosine", None, places), "query_id long, vec_id long, score double")
    return top_k(found, k, ["query_id"], [F.col("score").desc(), "vec_id"])


def nearest_lists(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(vec_id, embedding, list): a row for each of the ``probes`` lists nearest to a query, the first of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False) == centres.shape[1]
            own = batch.filter(pa.array(fits))
            x = np.asarray(own.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(own.num_rows, centres.shape[1])
            far = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
            lists = far.argsort(axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(own.num_rows), lists.shape[1]))
            yield pa.RecordBatch.from_arrays([own.column(0).take(at), own.column(1).take(at), pa.array(lists.ravel().astype(np.int32))], names=["vec_id", "embedding", "list"])

    rows = usable(queries).select("vec_id", "embedding")
    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, embedding {rows.schema['embedding'].dataType.simpleString()}, list int")


def ivf_assign(vectors: DataFrame, lists: int = 16, seed: int = 1, sample: int = 20_000) -> tuple[DataFrame, np.ndarray]:
    """Vectors with the number of their inverted list; centres are learnt on a bounded sample, every row is listed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where("embedding is not null").withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    fit_on = rows.orderBy(F.xxhash64("vec_id")).limit(sample)
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(fit_on)
    return model.transform(rows).select("vec_id", "embedding", F.col("prediction").alias("list")), np.array(model.clusterCenters())


def probes_needed(vectors: DataFrame, listed: DataFrame, centres: np.ndarray, k: int, least: float, sample: int = 256) -> int:
    """Lists to probe so that a bounded sample of the vectors finds at least this share of its exact neighbours by cosine."""
    some = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id", F.lit(7))).limit(sample).select("vec_id", "embedding").cache()
    asked = some.toPandas()
    exact = knn(vectors, some, k).join(listed.select("vec_id", "list"), "vec_id").groupBy("query_id", "list").agg(F.count("*").alias("n")).toPandas()
    some.unpersist()
    if not len(exact):
        return len(centres)
    x = np.array(asked["embedding"].tolist(), np.float64)
    order = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argsort(axis=1, kind="stable")
    place = {v: np.argsort(o) for v, o in zip(asked["vec_id"], order)}
    at = [place[q][i] for q, i in zip(exact["query_id"], exact["list"])]
    found = np.bincount(at, exact["n"], len(centres)).cumsum() / exact["n"].sum()
    return int(np.searchsorted(found, min(least, 1.0) - 1e-9)) + 1


def ivf_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 16, probes: int | None = None, least: float = 0.94) -> DataFrame:
    """Approximate neighbours by cosine: only the vectors in the ``probes`` lists nearest to a query.

    Without ``probes`` as many lists are taken as a sample of the vectors needs for a recall of ``least``, which
    stands above the 0.9 wanted because the queries are others than the sample.
    """
    listed, centres = ivf_assign(vectors, lists)
    if probes is None:
        probes = probes_needed(vectors, listed, centres, k, least)
    return knn_by_list(listed, cut(nearest_lists(queries, centres, probes), "probes"), k)


def pca_projection(vectors: DataFrame, components: int = 2) -> DataFrame:
    """(vec_id, projection array): coordinates along the first principal components (signs are arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where("embedding is not null").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return PCA(k=components, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("projection"))


def embedding_batches(texts: DataFrame, budget: int, by: str, order: str) -> DataFrame:
    """(by, order, text, tokens, batch): texts packed in order into batches of up to ``budget`` estimated tokens; longer ones are cut to it.

    A group's texts are folded by their sizes alone; the estimate of a cut text is the most that fits.
    """
    cut = per_row(texts, [by, order], ["text"], "text string, tokens long", lambda t: [fitted(t, budget)])
    rows = cut.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "tokens"))).alias("t"))
    kind = texts.schema[order].dataType.simpleString()
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<{order}:{kind},batch:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + t["tokens"] > budget)
        batch = acc["batch"] + full.cast("int")
        return F.struct(batch.alias("batch"), (F.when(full, 0).otherwise(acc["used"]) + t["tokens"]).cast("long").alias("used"), F.array_append(acc["out"], F.struct(t[order].alias(order), batch.alias("batch"))).alias("out"))

    placed = rows.select(by, F.explode(F.aggregate("t", start, step, lambda a: a["out"])).alias("p")).select(by, f"p.{order}", "p.batch")
    return cut.join(placed, [by, order])


def fitted(text: str, budget: int) -> tuple[str, int]:
    """A text's beginning whose estimated tokens come to the budget, found by halving, and the estimate."""

    def tokens(t: str) -> int:
        t = t.strip()
        plain = sum(map(str.isascii, t))
        return max(1, int(plain / 3.5 + (len(t) - plain) * 1.1))

    low, high = 1, len(text)
    if tokens(text) > budget:
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if tokens(text[:middle]) <= budget else (low, middle - 1)
        text = text[:low]
    return text, tokens(text)
