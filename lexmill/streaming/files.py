"""An index that follows a folder: new, changed and deleted files, committed in versions that may be written again.

A stream ticks; every tick compares the folder with the index and commits what differs as the version of its batch.  Rows
of a version are files as they are now, and tombstones of those that are gone, so nothing is rewritten and a reader of an
older version sees what that had.  A batch that is run again finds its version committed and does nothing; one that died
half-way is written over.  Files changed within the last moment wait for a later tick, so that a burst of changes to a file
is one.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.stage import cut

SCHEMA = "path string, hash string, text string, deleted boolean, version long"
#: Seconds for which a file must have been left alone.
QUIET = 1.5


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def current(spark: SparkSession, index: str, version: int | None = None) -> DataFrame:
    """(path, hash, text, version) of the files as of a version, the last one if none is named."""
    if not _exists(spark, index):
        return spark.createDataFrame([], SCHEMA).drop("deleted")
    rows = spark.read.schema(SCHEMA).parquet(index)
    rows = rows if version is None else rows.where(F.col("version") <= version)
    newest = Window.partitionBy("path").orderBy(F.col("version").desc())
    return rows.withColumn("n", F.row_number().over(newest)).where("n = 1 and not deleted").drop("n", "deleted")


def commit(spark: SparkSession, folder: str, index: str, version: int, ending: str = "*.md", quiet: float = QUIET, now: float | None = None) -> int:
    """Bring the index up to the folder as a version; how many files are new, changed or gone.  A version that is there stays as it is."""
    done = f"{index}/version={version}"
    if _exists(spark, f"{done}/_SUCCESS"):
        return 0
    held = current(spark, index, version - 1)
    if _exists(spark, folder):
        files = spark.read.format("binaryFile").option("pathGlobFilter", ending).load(folder)
    else:
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    settled = F.col("modificationTime") <= F.timestamp_seconds(F.lit((now or time.time()) - quiet))
    there = files.select("path", settled.alias("settled"), F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("text"))
    changed = there.where("settled").drop("settled").join(held.select("path", "hash"), ["path", "hash"], "left_anti").withColumn("deleted", F.lit(False))
    gone = held.join(there.select("path"), "path", "left_anti").select("path", "hash", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"))
    rows = cut(changed.select("path", "hash", "text", "deleted").unionByName(gone), "changed")
    n = rows.count()
    if n:
        rows.write.mode("overwrite").parquet(done)
    return n


def compacted(spark: SparkSession, index: str, target: str) -> None:
    """Write the files as they are, one row each, as the only version of a new index."""
    rows = current(spark, index)
    last = rows.agg(F.max("version")).first()[0]
    if last is not None:
        rows.select("path", "hash", "text", F.lit(False).alias("deleted")).write.parquet(f"{target}/version={last}")


def watch(spark: SparkSession, folder: str, index: str, checkpoint: str, every: str = "1.5 seconds", ending: str = "*.md", quiet: float = QUIET) -> StreamingQuery:
    """Keep the index of a folder up to date until the query is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    step = lambda _, i: commit(spark, folder, index, i, ending, quiet)
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
