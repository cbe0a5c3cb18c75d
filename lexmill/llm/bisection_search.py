"""Ranked lexical search over documents reordered by recursive graph bisection, in blocks visited by their bounds.

A bounded sample of the documents is split in two again and again: pairs of documents change sides as long as that
shortens the gaps that both sides' postings would have.  What tells the sides apart is a weight of every hashed term;
by these weights every document of the corpus finds its place, a cluster and within it the side it leans to.  In that
order documents are packed into blocks of postings with the greatest impact of every term.

A query's weights times a block's greatest impacts bound what any of its documents can score.  Blocks are visited in
rounds, in descending order of that bound; after each round a query leaves out all blocks whose bound lies under its
k-th score so far.  Blocks of an equal bound are visited, as a smaller doc_id might win a tie; ties go by the doc_id
that is packed with every document, not by the place.

Contract: a text has the maximal runs of letters, digits and characters beyond ASCII as terms, A-Z in lower case; null
texts have none.  Documents without terms are never found.  Rows that repeat are each ranked; rows with a null doc_id
count and rank after others of their score; texts of one item are put together, and a null item is an item; items
without known terms give no rows; an empty table gives none.  Further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_values, cut, slices, text_batches

#: Documents that the order is fitted on, features that terms are hashed to, and levels of bisection.
SAMPLE, FEATURES, LEVELS = 4096, 8192, 6
SWAPS = 12
#: Most documents and postings of a block; one document may have more postings.
BLOCK_DOCS, BLOCK_POSTINGS = 1024, 300_000
#: Most (item, term) pairs that are sent to all executors at once; more items are searched in turns.
MOST_PAIRS = 500_000
#: Blocks of the first round, and how many times more each later round takes.
FIRST, TIMES = 2, 4
NO_ID = (1 << 63) - 1
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
PLACED = "doc_id long, n long, cluster int, lean float, terms binary, tf binary"
BLOCKS = "block long, docs int, ids binary, terms binary, df binary, top binary, places binary, impacts binary"


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text in UTF-8, with repeats."""
    return text.translate(_TERMS).split()


def feature(term: bytes) -> int:
    return zlib.crc32(term) % FEATURES


class _Features(dict):
    """Features by term, a bounded number of them."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[term] = f = feature(term)
        return f


def _moves(have: np.ndarray, size: int, to: np.ndarray, to_size: int) -> np.ndarray:
    """Bits that each feature's gaps lose where a document that holds it goes over, with ``have`` on its side and ``to`` on the other."""
    cost = lambda a, n, b, m: a * np.log2(n / (a + 1)) + b * np.log2(m / (b + 1))
    return np.where(have > 0, cost(have, size, to, to_size) - cost(np.maximum(have - 1, 0), size, to + 1, to_size), 0.0)


def bisect(docs: list[np.ndarray], sweeps: int = SWAPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Side (0 or 1) of each document, a weight of every feature for side 1, and the middle of the documents' sums of weights.

    The sides begin as halves of the order given and stay of equal size: documents change in pairs, those that gain most first.
    """
    flat, start = np.concatenate(docs), np.cumsum([0, *map(len, docs)])[:-1]
    side = np.zeros(len(docs), bool)
    side[len(docs) // 2 :] = True
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    for _ in range(sweeps):
        right = np.bincount(flat[side[row]], minlength=FEATURES).astype(float)
        left = np.bincount(flat[~side[row]], minlength=FEATURES).astype(float)
        m, n = int(side.sum()), int((~side).sum())
        gain = np.add.reduceat(np.where(side[row], _moves(right, m, left, n)[flat], _moves(left, n, right, m)[flat]), start)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        pairs = min(len(a), len(b))
        better = int(np.searchsorted(-(gain[a[:pairs]] + gain[b[:pairs]]), 0.0))
        if not better:
            break
        side[a[:better]], side[b[:better]] = True, False
    right, left = np.bincount(flat[side[row]], minlength=FEATURES), np.bincount(flat[~side[row]], minlength=FEATURES)
    weight = np.log2((right + 0.5) / (side.sum() + 1)) - np.log2((left + 0.5) / ((~side).sum() + 1))
    return side, weight.astype(np.float32), float(np.median(np.add.reduceat(weight[flat], start) / np.sqrt([len(d) for d in docs])))


def order_tree(docs: list[np.ndarray], levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and middles of the splits, that of node i going on to nodes 2 i + 1 and 2 i + 2; few documents are not split."""
    weights, middles = np.zeros(((1 << levels) - 1, FEATURES), np.float32), np.zeros((1 << levels) - 1, np.float32)
    nodes = {0: [d for d in docs if len(d)]}
    for node in range((1 << levels) - 1):
        held = nodes.pop(node, [])
        if len(held) < 16:
            continue
        side, weights[node], middles[node] = bisect(held)
        nodes[2 * node + 1] = [d for d, s in zip(held, side) if not s]
        nodes[2 * node + 2] = [d for d, s in zip(held, side) if s]
    return weights, middles


def placed(features: np.ndarray, weights: np.ndarray, middles: np.ndarray) -> tuple[int, float]:
    """Cluster of a document and how far it leans over at the last split."""
    node, lean = 0, 0.0
    while node < len(weights):
        lean = float(weights[node][features].sum() / math.sqrt(max(len(features), 1)) - middles[node])
        node = 2 * node + (2 if lean > 0 else 1)
    return node - len(weights), lean


def _packed(terms: list[bytes]) -> bytes:
    return b" ".join(terms)


def _unpacked(terms: bytes) -> list[bytes]:
    return terms.split(b" ") if terms else []


def fitted_order(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The splits, from about SAMPLE documents that a hash of the id draws, whole texts."""
    n = documents.count()
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = documents.where(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "text").limit(2 * SAMPLE)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = binary_values(batch.column(1))
            found = [np.unique(np.array([feature(t) for t in set(terms_of(x))], np.int16)).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "f"])

    rows = drawn.mapInArrow(features, "doc_id long, f binary").collect()
    return order_tree([np.frombuffer(r["f"], np.int16) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["f"]))])


def placed_terms(documents: DataFrame, tree: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id (NO_ID for null), n, cluster, lean and the distinct terms with their numbers, of each row that has terms."""
    sent = documents.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, middles = sent.value
        hashed = _Features()
        for batch in slices(batches):
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1))):
                tf = Counter(terms_of(text))
                if tf:
                    f = np.unique(np.fromiter(map(hashed.__getitem__, tf), np.int64, len(tf)))
                    out.append((NO_ID if key is None else key, sum(tf.values()), *placed(f, weights, middles), _packed(list(tf)), np.fromiter(tf.values(), np.uint32, len(tf)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.float32(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in PLACED.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PLACED)


def block_of(ids: list[int], lengths: list[int], terms: list[bytes], tfs: list[bytes], total: int, length: int) -> dict:
    """Postings of a block: for every term, in order, its places in the block and their impacts.

    Terms stay packed until here, and are numbered document by document, as single objects they take ten times the room.
    """
    numbers: dict[bytes, int] = {}
    sizes = [len(x) // 4 for x in tfs]
    flat = np.fromiter((numbers.setdefault(t, len(numbers)) for doc in terms for t in _unpacked(doc)), np.int32, sum(sizes))
    tf = np.frombuffer(b"".join(tfs), np.uint32).astype(np.int64)
    m = 50 + (50 * np.array(lengths, np.int64) * total) // length
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes))
    names = sorted(numbers)
    rank = np.empty(len(names), np.int64)
    rank[np.fromiter((numbers[t] for t in names), np.int64, len(names))] = np.arange(len(names))
    order = np.argsort(rank[flat], kind="stable")
    df = np.bincount(rank[flat], minlength=len(names))
    impact = impact[order].astype(np.int32)
    top = np.maximum.reduceat(impact, np.cumsum(df) - df)
    place = np.repeat(np.arange(len(ids)), sizes)[order].astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
    return {"docs": len(ids), "ids": np.array(ids, np.int64).tobytes(), "terms": _packed(names), "df": df.astype(np.int32).tobytes(), "top": top.tobytes(), "places": place.tobytes(), "impacts": impact.tobytes()}


def index(documents: DataFrame) -> tuple[DataFrame, int, int]:
    """The blocks of all documents in order, written; how many documents have terms; and how many terms these have."""
    text_batches(documents.sparkSession)
    rows = cut(placed_terms(documents, fitted_order(documents)), "placed")
    total, length = (x or 0 for x in rows.agg(F.count("*"), F.sum("n")).first())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        postings, cluster = 0, None

        def done() -> pa.RecordBatch:
            made = block_of(*[[x[i] for x in held] for i in range(4)], total, length)
            values = {"block": block} | made
            return pa.RecordBatch.from_arrays([pa.array([values["block"]], pa.int64()), pa.array([values["docs"]], pa.int32()), *[pa.array([values[c]], pa.binary()) for c in ("ids", "terms", "df", "top", "places", "impacts")]], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in slices(batches, 256, 2 << 20, "terms"):
            for key, n, c, _, terms, tf in zip(*[x.to_pylist() for x in batch.columns]):
                size = len(tf) // 4
                if held and (c != cluster or len(held) >= BLOCK_DOCS or postings + size > BLOCK_POSTINGS):
                    yield done()
                    block, held, postings = block + 1, [], 0
                held.append((key, n, terms, tf))
                postings, cluster = postings + size, c
        if held:
            yield done()

    keys = ["cluster", "lean", "doc_id"]
    return cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pack, BLOCKS), "blocks"), int(total), int(length)


def asked_terms(items: DataFrame) -> Iterator[dict[int | None, set[bytes]]]:
    """Terms by item, in turns of at most MOST_PAIRS pairs or one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_packed(sorted(set(terms_of(x)))) for x in binary_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, terms binary").orderBy("item_id")
    turn: dict[int | None, set[bytes]] = {}
    pairs = 0
    for r in rows.toLocalIterator():
        if r["item_id"] not in turn and pairs >= MOST_PAIRS:
            yield turn
            turn, pairs = {}, 0
        terms = turn.setdefault(r["item_id"], set())
        pairs -= len(terms)
        terms.update(_unpacked(bytes(r["terms"])))
        pairs += len(terms)
    if turn:
        yield turn


class Block:
    """A block as it is read."""

    def __init__(self, values: dict) -> None:
        terms = _unpacked(values["terms"])
        self.number = dict(zip(terms, range(len(terms))))
        self.docs, self.top = values["docs"], np.frombuffer(values["top"], np.int32) if "top" in values else None
        if "ids" in values:
            self.ids = np.frombuffer(values["ids"], np.int64)
            self.places = np.frombuffer(values["places"], np.uint16 if self.docs <= 1 << 16 else np.uint32)
            self.impacts = np.frombuffer(values["impacts"], np.int32)
            self.end = np.cumsum(np.frombuffer(values["df"], np.int32))
            self.start = self.end - np.frombuffer(values["df"], np.int32)

    def bound(self, weights: dict[bytes, int]) -> int:
        return sum(w * int(self.top[self.number[t]]) for t, w in weights.items() if t in self.number)

    def best(self, weights: dict[bytes, int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the k best of at least ``least``, which is 1 or more."""
        scores = np.zeros(self.docs, np.int64)
        for t, w in weights.items():
            i = self.number.get(t)
            if i is not None:
                some = slice(self.start[i], self.end[i])
                scores[self.places[some]] += w * self.impacts[some].astype(np.int64)
        some = np.flatnonzero(scores >= least)
        if len(some) > k:
            kth = np.partition(scores[some], -k)[-k]
            some = some[scores[some] >= kth]
        some = some[np.lexsort((self.ids[some], -scores[some]))[:k]]
        return self.ids[some], scores[some]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield {c: batch.column(i)[r].as_py() for i, c in enumerate(batch.schema.names)}


def _found(rows: list[tuple[int, int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=names)


def visit(spark: SparkSession, blocks: DataFrame, total: int, turn: dict[int | None, set[bytes]], k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of a turn's items."""
    send = spark.sparkContext.broadcast
    every = send(frozenset().union(*turn.values()))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()
        for values in _blocks(batches):
            df = np.frombuffer(values["df"], np.int32)
            sums.update({t: int(df[i]) for i, t in enumerate(_unpacked(values["terms"])) if t in every.value})
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["term", "df"])

    df = {bytes(r["term"]): r["df"] for r in blocks.select("terms", "df").mapInArrow(held, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator()}
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    names = list(turn)
    weights = send([{t: weight[t] for t in sorted(turn[x]) if t in weight} for x in names])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _blocks(batches):
            block = Block(values)
            found = [(i, values["block"], b) for i, w in enumerate(weights.value) if (b := block.bound(w)) > 0]
            yield _found(found, ["item", "block", "bound"])

    left = cut(blocks.select("block", "docs", "terms", "top").mapInArrow(bounds, "item long, block long, bound long"), "bounds")
    best = spark.createDataFrame([], "item long, doc_id long, score long")
    first = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    take, least = FIRST, np.ones(len(names), np.int64)
    while True:
        # exact stopping: a block under an item's k-th score so far cannot change its list
        floor = spark.createDataFrame([(i, int(x)) for i, x in enumerate(least)], "item long, least long")
        ranked = left.join(floor, "item").where("bound >= least").withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "block")))
        left = cut(ranked.select("item", "block", "bound", "n"), "left")
        now = cut(left.where(F.col("n") <= take).groupBy("block").agg(F.collect_list("item").alias("items")), "now")
        if not now.limit(1).count():
            break
        reached = send(least)

        def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for values in _blocks(batches):
                block = Block(values)
                found: list[tuple[int, int, int]] = []
                for i in values["items"]:
                    ids, scores = block.best(weights.value[i], k, int(reached.value[i]))
                    found += [(i, d, s) for d, s in zip(ids.tolist(), scores.tolist())]
                yield _found(found, ["item", "doc_id", "score"])

        more = blocks.join(now, "block").select("docs", "ids", "terms", "df", "places", "impacts", "items").mapInArrow(evaluate, "item long, doc_id long, score long")
        best = cut(best.unionByName(more).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank"), "best")
        kth = best.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
        least = least.copy()
        for r in kth.toLocalIterator():
            least[r["item"]] = r["score"]
        left, take = left.where(F.col("n") > take).drop("n"), take * TIMES
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "item long, item_id long")
    out = best.withColumn("rank", F.row_number().over(first)).join(ids, "item")
    return out.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


def search(items: DataFrame, documents: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``k`` best documents of positive score."""
    spark = documents.sparkSession
    blocks, total, _ = index(documents)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for turn in asked_terms(items):
        out = out.unionByName(visit(spark, blocks, total, turn, k))
    return out


ORACLE = r"""
WITH t AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
c AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY r) AS n FROM t GROUP BY r, term),
s AS (SELECT count(DISTINCT r) AS big_n, count(*) AS big_l FROM t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term),
x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n::BIGINT * big_n) // big_l)))))::BIGINT AS score FROM q JOIN w USING (term) JOIN c USING (term), s GROUP BY item_id, r),
z AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM z WHERE rank <= 50
"""
