"""Token-id output as ORC: encode, write in document order, read back.

Files hold ``doc_id``, ``n_tokens`` and ``token_ids array<int>``; ORC run-length encodes the integers,
keeps row indexes every ``stride`` rows, and Bloom filters and min/max statistics on ``doc_id``, so a
lookup prunes files, stripes and row groups, and any number of readers share a file by stripes.
Rows are range-partitioned and sorted by ``doc_id``: the files in order are the corpus in order.

Contract: null and empty texts give just the end id; null ids come first; rows that repeat a doc_id
are each kept, next to each other, in the order in which the file holds them; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch, slices, text_batches
from .subword import lengths_to_bounds, library_cache

#: ``place`` numbers the rows of a file in the order in which it holds them.
SCHEMA = "doc_id long, place long, n_tokens int, token_ids array<int>"


def encode(df: DataFrame, tokenizer_path: str, end_id: int | None = 1) -> DataFrame:
    """doc_id, place, n_tokens and token_ids of (doc_id, text), with ``end_id`` after each document's ids; ``place`` counts a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, place = library_cache(tokenizer_path), 0
        for batch in slices(batches):
            rows, counts = cache.rows_of(batch.column(1))
            ids, per_chunk = cache.encode_rows(rows)
            bounds = lengths_to_bounds(per_chunk)[lengths_to_bounds(counts)]
            if end_id is not None:
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            places = pa.array(np.arange(place, place + len(lists)))
            place += len(lists)
            yield pa.RecordBatch.from_arrays([batch.column(0), places, pa.array(np.diff(bounds).astype(np.int32)), lists], names=["doc_id", "place", "n_tokens", "token_ids"])

    text_batches(df.sparkSession)
    return df.mapInArrow(run, SCHEMA)


def write_orc(documents: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, stripe_mb: int = 16, stride: int = 1000, compression: str = "zstd") -> None:
    """Write (doc_id, text) as token ids to ORC files under ``path``, in ascending doc_id order."""
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        encode(ordered, tokenizer_path, end_id)
        .write.option("orc.compress", compression.upper())
        .option("orc.stripe.size", stripe_mb << 20)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, place, n_tokens, token_ids; filters on doc_id are pushed to the ORC reader."""
    return spark.read.schema(SCHEMA).orc(path)


def id_digests(tokens: DataFrame) -> DataFrame:
    """Each row's file, place there, doc_id, number of ids, and crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            bounds = lists.offsets.to_pylist()
            crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64())], names=["file", "place", "doc_id", "n_tokens", "ids_crc32"])

    return tokens.select(F.xxhash64("_metadata.file_path").alias("file"), "place", "doc_id", "token_ids").mapInArrow(run, "file long, place long, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before a row.

    Files hold disjoint ranges of doc_id, so a start is the ids of earlier files (one row a file) plus
    a running sum within the file, in the order of its rows.
    """
    rows = cut(rows, "orc-rows")
    before = Window.orderBy(F.col("first").asc_nulls_first(), "last", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n_tokens").alias("ids"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"))
    files = files.withColumn("first", F.when(F.col("nulls") == 0, F.col("first"))).select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"))
    within = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "file").withColumn("start", F.col("ids_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))


def round_trip(documents: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int | None = 1) -> DataFrame:
    """Write ``documents`` and return per document doc_id, start, n_tokens and ids_crc32 as read back."""
    spark = documents.sparkSession
    path = path or scratch(spark, "tokens.orc")
    write_orc(documents, path, tokenizer_path, end_id)
    return with_starts(id_digests(read_orc(spark, path))).select("doc_id", "start", "n_tokens", "ids_crc32")
