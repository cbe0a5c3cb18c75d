"""The first others of a group, taken from the group's least ids, against plain loops; memories by blocks of vectors."""

from pyspark.sql import functions as F

from lexmill.operators import fusion as U
from lexmill.operators import memory as M
from lexmill.operators import vector as V

ROWS = [(i, [float(i % 5), 1.0], i % 3 if i % 11 else None) for i in range(60)] + [(3, [2.0, 2.0], 0), (3, [0.0, 0.0], 0), (90, [1.0, 1.0], 7)]


def test_first_alike(spark):
    rows = spark.createDataFrame(ROWS, "vec_id long, embedding array<double>, label int").repartition(5)
    asked = rows.where("vec_id % 4 = 3 or vec_id = 90").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label").dropDuplicates(["query_id"])
    got = U.first_alike(rows, asked, 4)
    wanted = []
    for q, _, label in asked.select("query_id", "vector", "label").collect():
        others = sorted(i for i, _, x in ROWS if x is not None and x == label and i != q)
        wanted += [(q, i, n + 1) for n, i in enumerate(others[:4])]
    assert sorted((r["query_id"], r["vec_id"], r["place"]) for r in got.collect()) == sorted(wanted) and len(wanted) > 40
    # the pairs that are shuffled hold no vectors
    last = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line][0]
    assert "embedding" not in last and "vector" not in last


def memories(spark):
    rows = [(f"m{i:03}", f"text {i % 40} w{i % 7}", [float(i % 4), float(i % 40 % 3), 1.0] if i % 13 else None, "auto_qa", i % 5, 0.5, i % 9) for i in range(80)]
    held = spark.createDataFrame(rows, "id string, content string, embedding array<double>, source_type string, doc_id long, importance double, hit_count long")
    asked = spark.createDataFrame([(1, "text w3", [1.0, 2.0, 0.5], 1), (2, "nothing", [0.0, 0.0, 0.0], 2), (3, "w5 12", [3.0, 0.0, 1.0], 3)], "query_id long, query string, vector array<double>, doc_id long")
    now = F.to_timestamp(F.lit("2024-03-15 00:00:00"))
    return asked, held.withColumns({"created_at": now, "last_hit_at": F.lit(None).cast("timestamp")}), now


def test_memories_by_blocks(spark, monkeypatch):
    asked, held, now = memories(spark)
    calls = []
    whole = V.knn
    monkeypatch.setattr(V, "knn", lambda *a, **k: calls.append(a[2]) or whole(*a, **k))
    got = {(r["query_id"], r["rank"]): r["id"] for r in M.retrieve(asked, held, now).collect()}
    assert calls == [3] and {q for q, _ in got} == {1, 2, 3} and len(got) == 9
    # of equal similarities the least ids come first: this query has no length, so all have 0
    assert {got[2, i] for i in (1, 2, 3)} == {"m001", "m002", "m003"}


def test_memory_context_of_the_same_hits(spark):
    asked, held, now = memories(spark)
    hits = M.retrieve(asked, held.repartition(6), now)
    wanted = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        wanted[r["query_id"]] = wanted.get(r["query_id"], M.CONTEXT_HEAD) + f"\n- [auto_qa] {r['content']}"
    assert {r["query_id"]: r["context"] for r in M.memory_context(hits).collect()} == wanted and len(wanted) == 3
