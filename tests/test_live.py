"""Streams that stop and go on: an index that follows a folder, and buffered token streams."""

import random
import time

from pyspark.sql import functions as F

from lexmill.streaming import files as W
from lexmill.streaming import ops as S


def held(spark, index, version=None):
    return {r["path"].rsplit("/", 1)[1]: r["text"] for r in W.current(spark, index, version).collect()}


def test_index_follows_folder(spark, tmp_path):
    folder, index = tmp_path / "notes", str(tmp_path / "index")
    folder.mkdir()
    step = lambda v, now=None: W.commit(spark, str(folder), index, v, now=now or time.time() + 60)
    assert step(0) == 0 and held(spark, index) == {}
    (folder / "a.md").write_text("one")
    (folder / "b.md").write_text("two")
    (folder / "c.txt").write_text("no note")
    assert step(1) == 2 and step(2) == 0
    (folder / "a.md").write_text("changed")
    (folder / "b.md").unlink()
    (folder / "d.md").write_text("new")
    assert step(3) == 3 and held(spark, index) == {"a.md": "changed", "d.md": "new"}
    # a replayed batch changes nothing, even if the folder has moved on
    (folder / "e.md").write_text("later")
    assert step(3) == 0 and held(spark, index) == {"a.md": "changed", "d.md": "new"}
    assert held(spark, index, 1) == {"a.md": "one", "b.md": "two"}
    # a version that died half-way is written over
    (tmp_path / "index" / "version=4").mkdir()
    assert step(4) == 1 and step(5) == 0
    # what was changed just now waits
    (folder / "f.md").write_text("moment")
    assert W.commit(spark, str(folder), index, 6, now=(folder / "f.md").stat().st_mtime + 1) == 0
    assert step(7) == 1 and set(held(spark, index)) == {"a.md", "d.md", "e.md", "f.md"}
    W.compacted(spark, index, str(tmp_path / "small"))
    assert held(spark, str(tmp_path / "small")) == held(spark, index)


def test_watch_restarts(spark, tmp_path):
    folder, index, check = tmp_path / "notes", str(tmp_path / "index"), str(tmp_path / "check")
    folder.mkdir()
    for n in range(2):
        (folder / f"n{n}.md").write_text(f"text {n}")
        query = W.watch(spark, str(folder), index, check, every="500 milliseconds", quiet=0.0)
        for _ in range(60):
            if len(held(spark, index)) == n + 1:
                break
            time.sleep(0.5)
        query.stop()
        assert held(spark, index) == {f"n{i}.md": f"text {i}" for i in range(n + 1)}


def test_buffer_goes_on_after_restart(spark, tmp_path):
    """What two runs from one checkpoint hand on is, joined, what came in."""
    rng = random.Random(3)
    rows = [(f"s{i % 4}", i, rng.choice(["", "ab", "xyz "]), rng.choice(["", "r"]), i >= 36, None) for i in range(40)]
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    for part in (rows[:17], rows[17:]):
        spark.createDataFrame(part, S.BUFFER).coalesce(1).write.mode("append").parquet(log)
        live = S.buffer_live(spark.readStream.schema(S.BUFFER).parquet(log), 5)
        query = live.writeStream.outputMode("append").option("checkpointLocation", check).format("parquet").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(out).orderBy("stream_id", "seq").collect()
    for s in {r[0] for r in rows}:
        for i, name in ((2, "content"), (3, "reasoning_content")):
            assert "".join(r[name] for r in got if r["stream_id"] == s) == "".join(r[i] for r in rows if r[0] == s)
    assert [r["seq"] for r in got if r["stream_id"] == "s0"] == list(range(sum(r["stream_id"] == "s0" for r in got)))
    batch = S.buffer_streams(spark.createDataFrame(rows, S.BUFFER), 5)
    key = lambda d: {(r["stream_id"], r["content"], r["reasoning_content"], r["done"]) for r in d.select("stream_id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("reasoning_content", F.lit("")).alias("reasoning_content"), "done").collect()}
    assert key(spark.read.parquet(out)) == key(batch)
