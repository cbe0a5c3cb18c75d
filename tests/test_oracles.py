"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from lexmill import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return f"{x:.6g}"
    if hasattr(x, "item"):
        return cell(x.item())
    return f"{float(x):.6g}" if isinstance(x, (bool, int)) else str(x)


def rows(df):
    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(name, spark, duck):
    ours = registry.queries()[name](spark, DIR).toPandas()
    theirs = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


#: Queries that SQL cannot express, and what holds of their rows; other tests hold them against plain Python.
WITHOUT_SQL = {
    "communities": "count(*) > 100 and count(cluster) = count(*)", "document_communities": "count(*) > 1000 and count(cluster) = count(*)", "document_community_levels": "count(*) > 1000 and max(level) >= 1",
    "markdown_text": "count(*) = 200 and count(text) = 200", "embedding_batches": "count(*) > 80 and max(batch) > 0", "citation_list": "count(*) > 20 and count(start_phrase) > 20",
    "leiden_reports": "count(*) > 20 and count(report) = count(*) and max(from_below)", "vector_store_probed": "count(distinct query_id) >= 10 and max(rank) = 10", "document_components": "count(*) > 1000 and count(distinct component) < count(*)", "ivf_knn": "max(rank) = 10 and count(*) > 90", "match_citations": "count(highlight) > 10 and min(ref) = 1",
    "mmr": "max(place) = 5 and count(*) = 200", "pca_projection": "min(size(projection)) = 2 and count(*) > 100", "relevant_context": "count(*) > 30 and min(n) > 0", "relevant_snippets": "count(snippet) = 400", "snippets": "count(snippet) = 400 and max(highlights) > 0",
    "retrieve": "count(*) > 100 and min(rank) = 0 and max(similarity) <= 1", "retrieve_reranked": "count(*) > 100 and min(rank) = 0", "structure_split": "count(*) > 200 and count(distinct doc_id) > 190",
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(name, spark):
    assert registry.queries()[name](spark, DIR).selectExpr(f"{WITHOUT_SQL[name]} AS fine").first()["fine"]
