"""Neighbours list by list against brute force, whether the queries' blocks are sent to all tasks or dealt over them."""

import math

import numpy as np
import pytest

from lexmill.operators import vector as V

rng = np.random.default_rng(4)
ROWS = [(i, [float(x) for x in rng.integers(-3, 4, 5)], int(i % 3)) for i in range(120)] + [(200, [0.0] * 5, 1), (201, None, 1), (202, [1.0, None, 0.0, 0.0, 0.0], 0), (203, [1.0, 2.0], 0), (204, [math.nan] * 5, 2)]
ASKED = [(i, e, j) for i, e, _ in ROWS if i % 10 == 0 or i > 200 for j in range(i % 3 + 1)]


def brute(k):
    fine = lambda e: e is not None and all(x is not None and not math.isnan(x) for x in e)
    cos = lambda a, b: round(float(np.dot(a, b)) / math.sqrt(np.dot(a, a) * np.dot(b, b)), 6) if any(a) and any(b) else 0.0
    found = {}
    for q, e, j in ASKED:
        if fine(e):
            found.setdefault(q, []).extend((-cos(e, x), v) for v, x, i in ROWS if i == j and fine(x) and len(x) == len(e))
    return sorted((q, v, rank + 1) for q, x in found.items() for rank, (_, v) in enumerate(sorted(x)[:k]))


@pytest.mark.parametrize("sent", [V.SENT, 0])
def test_knn_by_list(spark, monkeypatch, sent):
    for name, value in (("SENT", sent), ("ROWS", 7), ("BLOCK", 3), ("HELD", 2), ("PACKING", 60)):
        monkeypatch.setattr(V, name, value)
    vectors, asked = (spark.createDataFrame(r, "vec_id long, embedding array<double>, list int").repartition(3) for r in (ROWS, ASKED))
    got = V.knn_by_list(vectors, asked, 4)
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()) == brute(4)


def test_nearest_lists(spark):
    centres = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 3.0]])
    asked = spark.createDataFrame([(1, [0.5, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"], r["list"]) for r in V.nearest_lists(asked, centres, 2).collect()) == [(1, 0), (1, 1), (2, 0), (2, 2)]


def test_store_with_odd_vectors(spark, tmp_path):
    from lexmill.sources import vectors as S

    path = str(tmp_path / "store")
    S.create(spark.createDataFrame([r[:2] for r in ROWS if r[0] < 120], "vec_id long, embedding array<double>"), path, lists=3)
    S.upsert(spark, path, spark.createDataFrame([(200, [0.0] * 5)], "vec_id long, embedding array<double>"))
    asked = spark.createDataFrame([(7, ROWS[7][1]), (8, [0.0] * 5), (9, None)], "vec_id long, embedding array<double>")
    got = S.search(spark, path, asked, 3, probes=3).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got if r["query_id"] == 8} == {(8, 0), (8, 1), (8, 2)} and {r["score"] for r in got if r["query_id"] == 8} == {0.0}
    assert next(r for r in got if r["query_id"] == 7 and r["rank"] == 1)["score"] == 1.0 and {r["query_id"] for r in got} == {7, 8}


def test_probed_lists_meet_in_blocks(spark, tmp_path):
    """Few probes read few lists, and pairs of a query and a vector are not rows of their own."""
    from lexmill.sources import vectors as S

    path = str(tmp_path / "store")
    S.create(spark.createDataFrame([r[:2] for r in ROWS if r[0] < 120], "vec_id long, embedding array<double>"), path, lists=6)
    asked = spark.createDataFrame([(7, ROWS[7][1])], "vec_id long, embedding array<double>")
    found = S.search(spark, path, asked, 200, probes=2)
    lists = {r["vec_id"]: r["list"] for r in S.load(spark, path).collect()}
    assert len({lists[r["vec_id"]] for r in found.collect()}) == 2
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "dynamicpruning" in plan.lower() and "zip_with" not in plan
