"""Streams: buffering of token streams, debounced file events, feedback counts, incremental indexing, windows.

Every query runs with any streaming source; ``run_available`` drains one into a table for tests and batch use.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUFFER = "stream_id string, seq long, content string, reasoning_content string, done boolean, error string"


class Buffer:
    """What a stream has not handed on yet.  Both the batch and the streaming form go through it."""

    def __init__(self, size: int, content: str = "", reasoning: str = "", over: bool = False) -> None:
        self.size, self.content, self.reasoning, self.over = size, [content], [reasoning], over
        self.lengths = [len(content), len(reasoning)]

    def flushed(self) -> list[dict]:
        content, reasoning = "".join(self.content), "".join(self.reasoning)
        self.content, self.reasoning, self.lengths = [], [], [0, 0]
        return [{"content": content, "reasoning_content": reasoning, "done": False, "error": None}] if content or reasoning else []

    def feed(self, chunk: dict) -> list[dict]:
        """What is handed on: a done or failed chunk as it came, behind what was held, after which the stream is over."""
        ends = bool(chunk.get("done")) or bool(chunk.get("error"))
        if self.over:
            return []
        if ends or self.size <= 0:
            self.over = ends
            return [*self.flushed(), chunk]
        for held, i, text in ((self.content, 0, chunk.get("content") or ""), (self.reasoning, 1, chunk.get("reasoning_content") or "")):
            held.append(text)
            self.lengths[i] += len(text)
        return self.flushed() if max(self.lengths) >= self.size else []


def buffered(chunks: list[dict], size: int) -> list[dict]:
    """Pieces joined until either kind of content has ``size`` characters; done and errors end the stream; 0 passes all through."""
    buffer = Buffer(size)
    return [*(out for c in chunks for out in buffer.feed(c)), *buffer.flushed()]


def _numbered(stream: str, seq: int, rows: list[dict]) -> pd.DataFrame:
    out = [(stream, seq + i, r["content"] or "", r["reasoning_content"] or "", bool(r["done"]), r["error"]) for i, r in enumerate(rows)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in BUFFER.split(", ")])


def _in_order(pdf: pd.DataFrame) -> list[dict]:
    return pdf.astype(object).where(pdf.notna(), None).sort_values("seq").to_dict("records")


def buffer_streams(chunks: DataFrame, size: int) -> DataFrame:
    """The batch form over whole streams (stream_id, seq, content, reasoning_content, done, error)."""
    return chunks.groupBy("stream_id").applyInPandas(lambda key, pdf: _numbered(key[0], 0, buffered(_in_order(pdf), size)), BUFFER)


def buffer_live(chunks: DataFrame, size: int, idle_ms: int | None = None) -> DataFrame:
    """The streaming form: the state of a stream is what has not been flushed yet, the next number, and whether it is over.

    With ``idle_ms`` what is left of a stream that says neither done nor error is handed on once nothing has come for so
    long.  That is for queries that run on: one that is only to drain what is there would wait for it without end.
    """
    state = "content string, reasoning string, seq long, over boolean"

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        content, reasoning, seq, over = held.get if held.exists else ("", "", 0, False)
        buffer = Buffer(size, content, reasoning, over)
        if idle_ms is not None and held.hasTimedOut:
            yield _numbered(key[0], seq, buffer.flushed())
            held.remove()
            return
        rows = [out for pdf in batches for c in _in_order(pdf) for out in buffer.feed(c)]
        held.update(("".join(buffer.content), "".join(buffer.reasoning), seq + len(rows), buffer.over))
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        yield _numbered(key[0], seq, rows)

    return chunks.groupBy("stream_id").applyInPandasWithState(run, BUFFER, state, "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def debounced(events: DataFrame, gap: str = "1.5 seconds", late: str = "1 minute") -> DataFrame:
    """One row per burst of changes of a key: events closer than ``gap`` make one session."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def counts_by_window(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day", key: str = "event_type") -> DataFrame:
    """Events and their values by key in tumbling or sliding windows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_available(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream into a memory table and return it.  For bounded results."""
    name = "s" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def index_incrementally(stream: DataFrame, index_path: str, checkpoint: str, key: str, content: str):
    """Append to the index only rows that are new or whose content's md5 changed."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("hash", F.md5(content)).dropDuplicates([key, "hash"])
        try:
            rows = rows.join(spark.read.parquet(index_path).select(key, "hash"), [key, "hash"], "left_anti")
        except Exception as e:  # no index yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(index_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
