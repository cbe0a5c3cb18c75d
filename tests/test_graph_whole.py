"""Components of the whole co-occurrence graph of documents against union-find, and an error where rounds run out."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import graph as G
from lexmill.plans import graph_queries


def test_document_components(spark, tmp_path):
    texts = ["an ox is by it", "by the river stone", "lone pair", "xx yy zz", "zz ww xx", "one", "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for (words,) in table.select(T.tokens(F.col("text"))).collect():
        for a, b in zip((words or [])[:-1], (words or [])[1:]):
            low, high = sorted((root(a.upper()), root(b.upper())))
            up[high] = low
    got = {r["name"]: r["component"] for r in graph_queries.Q["document_components"][0](spark, str(tmp_path)).collect()}
    assert got == {x: root(x) for x in up} and len(set(got.values())) == 3


def test_unsettled_components_are_an_error(spark):
    path = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)], "src string, tgt string")
    with pytest.raises(RuntimeError):
        G.components(path, rounds=2)
