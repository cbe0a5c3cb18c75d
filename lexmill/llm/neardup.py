"""Near-duplicate classes over a table of documents: the DataFrame side of ``hyperminhash``.

Contract: documents without words (null, empty, white space) have no shingles and are linked with
nothing; a document with fewer words than a shingle has its whole word sequence as one.  Rows are told
apart by their sets, so repeated rows fall into one class; its id is the least doc_id in it, null ids
left out.  ``deduplicate`` keeps one row of a class: of the rows that repeat its id and belong to it, the one
of least hash; rows without an id stay, and so do texts that only these have.  Other columns are ignored by
``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hyperminhash as H
from .common import cut, slices, text_batches, unused
from .components import connected_components

#: How far below the threshold a pair's estimate may lie before it is left unconfirmed: six standard errors.
MARGIN = 0.15
#: Sides of the blocks in which a bucket's remaining pairs are compared.
BLOCK = 1024
#: Nodes of a part in which their sets meet.
PART = 2048
#: Most candidate ids that are sent to all executors (16 bytes each); beyond it they are joined by a shuffle.
MOST_SENT = 1_000_000


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, set size, 64-bit id of the set and the band keys of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, 2 << 20):
            sets = H.shingle_sets(batch.column(1), width)
            ids = [set_id(s) for s in sets]
            keys = np.concatenate([H.band_keys(H.registers(s)) if len(s) else np.zeros(0, np.int64) for s in sets])
            bounds = np.cumsum([0] + [H.BANDS * (len(s) > 0) for s in sets])
            bands = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), bands], names=["doc_id", "n_shingles", "node", "bands"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, node long, bands array<long>")


def set_id(s: np.ndarray) -> int | None:
    """64-bit id of a set, null for the empty one."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def with_nodes(documents: DataFrame, width: int, out: str) -> DataFrame:
    """All columns and ``out``, the id of a row's set."""
    schema = T.StructType([*documents.schema.fields, T.StructField(out, T.LongType())])
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, 2 << 20):
            ids = [set_id(s) for s in H.shingle_sets(batch.column(text), width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=schema.names)

    return documents.mapInArrow(run, schema)


def full_sets(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """node, registers and whole sets of the documents in ``ids`` (doc_id, node)."""
    if ids.count() <= MOST_SENT:
        ids = F.broadcast(ids)
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, 2 << 20):
            sets = H.shingle_sets(batch.column(1), width)
            # a repeated doc_id may bring another text of the same id: only the node's own set counts
            own = [(node, s) for node, s in zip(batch.column(0).to_pylist(), sets) if len(s) and set_id(s) == node]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in own], pa.int64()), pa.array([H.registers(s).tobytes() for _, s in own], pa.binary()), pa.array([s.tobytes() for _, s in own], pa.binary())], names=["node", "sketch", "shingles"]
            )

    return chosen.mapInArrow(run, "node long, sketch binary, shingles binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate comes near the threshold and whose full sets reach it."""
    least = percent / 100 - MARGIN
    one = sets.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"), F.col("shingles").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, sketch_a, set_a, sketch_b, set_b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "sketch_a", "set_a", "sketch_b", "set_b"))
            sizes = [np.array([len(x.as_buffer()) // 8 for x in s]) for s in (set_a, set_b)]
            rows = [np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(-1, H.BUCKETS) for s in (sketch_a, sketch_b)]
            likely = H.estimated(*rows, *sizes) >= least
            keep = []
            for i in np.flatnonzero(likely).tolist():
                same, union = H.jaccard(np.frombuffer(set_a[i].as_buffer(), np.uint64), np.frombuffer(set_b[i].as_buffer(), np.uint64))
                if 100 * same >= percent * union:
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def likely_pairs(members: DataFrame, percent: int, parts: int) -> DataFrame:
    """Likely pairs of one bucket but of different components, packed: (x, y, a array, b array).

    ``members`` has bucket, node, root, sketch.  Members get a block by their hash (about BLOCK to one), and
    each pair of blocks is one group, so no group holds more than two blocks however large the bucket.  Of the
    buckets that two nodes share only that of the first band counts.  ``x`` and ``y`` say in which of ``parts``
    parts the nodes of a pair are; a row packs all pairs of two parts that a group has found.
    """
    least = percent / 100 - MARGIN
    sizes = cut(members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "sizes")
    # few buckets have more than one block; where they are many, a join of two written tables splits a hot bucket
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_SENT else sizes
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = members.join(sizes, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root", "sketch")
    # by all three, so that the pairs of blocks of one bucket go to different tasks
    dealt = dealt.repartition("bucket", "low", "high")

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket, low, high = (k.as_py() for k in key)
        block, node, root = (group.column(c).to_numpy() for c in ("block", "node", "root"))
        rows = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, H.BUCKETS)
        band = int(np.flatnonzero(H.band_keys(rows[0]) == bucket)[0])
        before = rows[:, : band * H.BAND_ROWS].reshape(len(rows), band, H.BAND_ROWS)
        left, right = [], []
        for i in np.flatnonzero(block == low).tolist():
            j = np.flatnonzero((block == high) & (root != root[i]) & ((node > node[i]) if low == high else True))
            # agreement is at least the corrected estimate, so holding it against the bound loses nothing
            j = j[(rows[j] == rows[i]).mean(axis=1) >= least]
            j = j[~(before[j] == before[i]).all(axis=2).any(axis=1)]
            left.append(np.full(len(j), node[i]))
            right.append(node[j])
        one = np.concatenate([*left, np.zeros(0, np.int64)])
        two = np.concatenate([*right, np.zeros(0, np.int64)])
        x, y = one.astype(np.uint64) % np.uint64(parts), two.astype(np.uint64) % np.uint64(parts)
        swap = x > y
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        x, y = np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64)
        order = np.lexsort((y, x))
        cuts = np.flatnonzero(np.diff(x[order] * parts + y[order], prepend=-1))
        bounds = pa.array([*cuts.tolist(), len(order)], pa.int32())
        first = order[cuts]
        return pa.table({"x": pa.array(x[first]), "y": pa.array(y[first]), "a": pa.ListArray.from_arrays(bounds, pa.array(one[order])), "b": pa.ListArray.from_arrays(bounds, pa.array(two[order]))})

    return dealt.groupBy("bucket", "low", "high").applyInArrow(run, "x long, y long, a array<long>, b array<long>")


def confirmed_in_parts(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among packed pairs that join what was not yet joined, confirmed on full sets.

    ``sets`` has node, root, shingles.  Two parts meet in one group, with the sets of just those nodes that
    have a pair there; a pair whose nodes the group has already joined needs no confirmation.
    """
    wanted = pairs.select("x", "y", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")).distinct().join(sets, "node")
    wanted = wanted.withColumnsRenamed({"x": "of_x", "y": "of_y"})

    def run(key: tuple[pa.Scalar, ...], packed: pa.Table, held: pa.Table) -> pa.Table:
        of = dict(zip(held.column("node").to_pylist(), (np.frombuffer(s.as_buffer(), np.uint64) for s in held.column("shingles"))))
        up = {n: ("root", r) for n, r in zip(held.column("node").to_pylist(), held.column("root").to_pylist())}

        def find(n: object) -> object:
            while (to := up.get(n, n)) != n:
                up[n] = up.get(to, to)
                n = to
            return n

        found = []
        for a, b in zip(packed.column("a").combine_chunks().flatten().to_pylist(), packed.column("b").combine_chunks().flatten().to_pylist()):
            one, two = find(a), find(b)
            if one != two:
                n, m = len(of[a]), len(of[b])
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                same, union = H.jaccard(of[a], of[b])
                if 100 * same >= percent * union:
                    up[one] = two
                    found.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return pairs.groupBy("x", "y").cogroup(wanted.groupBy("of_x", "of_y")).applyInArrow(run, "a long, b long")


def classes(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document doc_id, n_shingles, component_id and kept (whether its id is its class's)."""
    return labelled(documents, width, percent).drop("node")


def labelled(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """``classes`` with the node, the id of a row's set (null without shingles)."""
    text_batches(documents.sparkSession)
    rows = cut(sketches(documents, width), "sketches")
    nodes = rows.where("node is not null")
    reps = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("bucket", "pivot")
    # the members of every bucket that holds more than one node
    members = cut(banded.join(pivots, "bucket").distinct(), "members")
    ids = cut(members.select("node").distinct().join(reps, "node").where("doc_id is not null"), "candidates")
    sets = cut(full_sets(documents, ids, width), "sets")

    stars = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(confirmed(stars, sets, percent), "links")
    roots = cut(connected_components(links), "roots")
    known = members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    # of three nodes or more, not all in one component: pairs without the pivot are still to be compared
    open_ = known.groupBy("bucket").agg(F.min("root").alias("one"), F.max("root").alias("two"), F.count("*").alias("n")).where("one <> two and n > 2").select("bucket")
    open_ = cut(known.join(open_, "bucket"), "open")
    parts = max(1, -(-open_.select("node").distinct().count() // PART))
    rest = cut(likely_pairs(open_.join(sets.select("node", "sketch"), "node"), percent, parts), "rest")
    held = sets.select("node", "shingles").join(open_.select("node", "root").distinct(), "node")
    more = cut(confirmed_in_parts(rest, held, percent), "links")
    roots = cut(connected_components(links.union(more)), "roots")

    named = reps.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = named.join(least, "root").select("node", "component_id")
    linked = nodes.select("doc_id", "n_shingles", "node").join(of, "node").select("doc_id", "n_shingles", "component_id", "node")
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "node")
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate class, that of its id, all columns kept; rows without an id stay."""
    rows = cut(labelled(documents, width, percent).where("doc_id is not null"), "classes")
    of_id = rows.groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    gone = of_id.where("not stays or n > 1").select(F.col("doc_id").alias("__gone"))
    out = documents.join(gone, documents["doc_id"].cast("long") == gone["__gone"], "left_anti")
    twice = of_id.where("stays and n > 1").select(F.col("doc_id").alias("__id"))
    if twice.isEmpty():
        return out
    node = unused(documents, "node")
    repeated = with_nodes(documents.join(twice, documents["doc_id"].cast("long") == twice["__id"], "left_semi"), width, node)
    own = rows.where("kept").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct()
    repeated = repeated.join(own, (repeated["doc_id"].cast("long") == own["__id"]) & repeated[node].eqNullSafe(own["__node"]), "left_semi")
    # the least of each id, first in every task, so that an id with many rows is no group
    row = F.struct(*documents.columns)
    least = repeated.groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(row, F.struct(node, F.xxhash64(F.to_json(row)))).alias("__row"))
    return out.unionByName(least.select("__row.*"))
