"""Reading the fixture tables and other sources."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.rows import per_row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Rows of CSV files as Markdown table rows, one column ``row``; the header and rule are added by ``with_header``."""
    df = spark.read.option("header", header).csv(path)
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("row"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its path, md5 as id, and whole text."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumn("doc_id", F.md5("text"))


def feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """Feedback events from JSON lines; bad lines give a row of nulls and are left out."""
    schema = "timestamp string, doc_id string, message_idx int, feedback_type string, issue_types array<string>, detail string, question string, answer string, model string, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def write_feedback(events: DataFrame, path: str) -> None:
    """Append feedback as JSON lines, one folder a day, answers cut to 500 characters."""
    rows = events.withColumn("answer", F.substring("answer", 1, 500)).withColumn("date", F.to_date("timestamp"))
    rows.write.mode("append").partitionBy("date").json(path)


#: File endings that have a loader.
SUPPORTED = (".docx", ".xlsx", ".xls", ".txt", ".md", ".markdown", ".csv")


def is_supported(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"[^/\\.](\.[^./\\]*)$", 1))
    return ending.isin(*SUPPORTED)


def csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each CSV file as one Markdown table, its first row the header, a rule after it.

    A file is one row, read whole, as its rows make one text; cells are trimmed.  Quoted cells may hold commas.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return per_row(rows, ["path"], ["value"], "text string", lambda t: [(markdown_table([[c.strip() for c in r] for r in csv.reader(io.StringIO(t))]),)])


def markdown_table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * max(lines[0].count("|") - 1, 1)) + " |", *lines[1:]])


def write_log(entries: DataFrame, path: str, day: str = "day", text: str = "entry") -> None:
    """Append text entries, one folder a day."""
    entries.select(day, F.col(text).alias("value")).write.mode("append").partitionBy(day).text(path)


def versioned(df: DataFrame, version: int) -> DataFrame:
    """Rows of the current schema version; older ones count as absent."""
    return df.where(F.col("schema_version") == version)


def write_table(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def upsert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Key-value upsert as inserts of absent keys: stored rows stay as they are."""
    return stored.unionByName(new.join(stored.select(key), key, "left_anti"))


def replace_rows(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def delete_rows(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def changed_rows(new: DataFrame, indexed: DataFrame, key: str, content: str) -> DataFrame:
    """Rows that are new or whose content's md5 differs from the indexed one (key, hash)."""
    return new.withColumn("hash", F.md5(content)).join(indexed.select(key, "hash"), [key, "hash"], "left_anti")


def task_states(log: DataFrame, key: list[str]) -> DataFrame:
    """(key, status) of tasks by a log of status and failed: failed once they failed, else as far as they have come."""
    step = F.array_position(F.array(*map(F.lit, ("pending", "processing", "completed"))), F.col("status"))
    far = log.groupBy(*key).agg(F.max("failed").alias("failed"), F.max(step).alias("n"))
    return far.select(*key, F.when(F.col("failed"), "failed").when(F.col("n") == 3, "completed").when(F.col("n") == 2, "processing").otherwise("pending").alias("status"))
