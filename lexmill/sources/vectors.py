"""Stores of vectors: inverted lists as a partitioned table with their centres, and a cache of embeddings by content.

A store is a folder: ``centres`` has a row a list, ``vectors`` is partitioned by list, so that a search reads the lists that
it probes and no others.  Changes rewrite the lists that they touch.  One writer at a time; readers see a list before or
after its change.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.vector import ivf_assign, knn_by_list, nearest_lists
from lexmill.stage import cut


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    """Centres of all lists, a few hundred vectors at most."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
    return np.array([r["centre"] for r in rows], float)


def _by_distance(vector: Column, centres: np.ndarray) -> Column:
    """Numbers of the lists, nearest centre first."""
    far = [F.struct(F.aggregate(F.zip_with(vector, F.array(*map(F.lit, map(float, c))), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("far"), F.lit(i).alias("list")) for i, c in enumerate(centres)]
    return F.transform(F.array_sort(F.array(*far)), lambda x: x["list"])


def create(vectors: DataFrame, path: str, lists: int = 16) -> None:
    """Write a store of (vec_id, embedding, ...); rows without an embedding are left out, and so are centres without rows."""
    spark = vectors.sparkSession
    _, centres = ivf_assign(vectors, lists)
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    listed = vectors.where("embedding is not null").withColumn("list", _by_distance(F.col("embedding"), centres)[0])
    listed.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def _rewrite(spark: SparkSession, path: str, gone: DataFrame, new: DataFrame | None) -> None:
    """Replace the lists that hold a vec_id of ``gone`` or get a row of ``new``."""
    old = load(spark, path)
    touched = old.join(gone.select("vec_id").distinct(), "vec_id", "left_semi").select("list")
    touched = touched.union(new.select("list")) if new is not None else touched
    # a list without rows left is kept as an empty file, so that it is overwritten
    lists = sorted(r["list"] for r in touched.distinct().collect())
    if not lists:
        return
    kept = old.where(F.col("list").isin(lists)).join(gone.select("vec_id"), "vec_id", "left_anti")
    rows = cut(kept.unionByName(new) if new is not None else kept, "rewritten")
    held = {r["list"] for r in rows.select("list").distinct().collect()}
    rows.repartition("list").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{path}/vectors")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for x in set(lists) - held:
        folder = hadoop(f"{path}/vectors/list={x}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Insert rows, in place of those of the same vec_id; of rows that share one the first by embedding counts."""
    centres = _centres(spark, path)
    names = [c for c in load(spark, path).columns if c != "list"]
    new = rows.where("embedding is not null").select(*names).withColumn("list", _by_distance(F.col("embedding"), centres)[0])
    new = cut(new.groupBy("vec_id").agg(F.min(F.struct("embedding", *[c for c in [*names, "list"] if c not in ("vec_id", "embedding")])).alias("r")).select("vec_id", "r.*").select(*names, "list"), "upserted")
    _rewrite(spark, path, new, new)


def delete(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Remove the rows of (vec_id)."""
    _rewrite(spark, path, ids, None)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 4) -> DataFrame:
    """(query_id, vec_id, score, rank): the nearest by cosine among the ``probes`` lists nearest to each query (vec_id, embedding).

    The lists asked for meet the table by its partition column, so the scan is pruned to them when the query runs; what is
    read meets the queries of its list block by block.  Rows and queries that hold nulls or no numbers take no part.
    """
    centres = _centres(spark, path)
    asked = cut(nearest_lists(queries, centres, probes), "asked")
    held = load(spark, path).join(asked.where("list >= 0").select("list"), "list", "left_semi")
    return knn_by_list(held, asked, k)


def embedded(texts: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """``texts`` with ``embedding``: from the cache at ``path`` where it knows the content, else by ``embed``, and cached.

    ``embed`` gets distinct (hash, text) that the cache does not know and returns (hash, embedding).
    """
    spark = texts.sparkSession
    rows = texts.withColumn("hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    known = _cached(spark, path)
    missing = rows.select("hash", F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["hash"])
    if known is not None:
        missing = missing.join(known.select("hash"), "hash", "left_anti")
    missing = cut(missing, "missing")
    if missing.limit(1).count():
        embed(missing).select("hash", F.col("embedding").cast("array<double>").alias("embedding")).write.mode("append").parquet(path)
        known = _cached(spark, path)
    if known is None:
        return rows.withColumn("embedding", F.lit(None).cast("array<double>")).drop("hash")
    # a cache written twice for one content holds equal vectors
    return rows.join(known.dropDuplicates(["hash"]), "hash", "left").drop("hash")


def forget(spark: SparkSession, path: str, kept: DataFrame, text: str = "text") -> None:
    """Leave in the cache what ``kept`` holds and nothing else."""
    known = _cached(spark, path)
    if known is not None:
        rows = cut(known.join(kept.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash")), "hash", "left_semi"), "kept")
        rows.write.mode("overwrite").parquet(path)


def _cached(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema("hash string, embedding array<double>").parquet(path) if there else None
