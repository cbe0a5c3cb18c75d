"""Results that all queries share are taken apart once, and give what the pairs of queries and results give."""

from pyspark.sql import functions as F

from lexmill.operators import fusion as U

QUERIES = [(1, "robust model attack"), (2, "深度学习 模型"), (3, ""), (4, None), (5, "the İstanbul LOSS"), (6, "a b c"), (7, "x1 x1 y2"), (8, "鲁棒 method asr 2024")]
RESULTS = [
    (1, "Robust Model", "about a robust model attack", "https://x.com/1"), (2, "深度学习模型", "テスト 深度学习", "http://a.example"), (3, None, "x1 and y2", None), (4, "The İstanbul loss", None, "https://m.twitter.com/2"),
    (5, "", "", ""), (6, "ROBUST model", "About a robust model attack!", "https://X.com/1"), (7, "Robust Model ", "again", "https://x.com/1"), (8, "鲁棒 METHOD", "asr 2024 の", "https://weibo.com"), (9, "model attack", "method " * 40, "https://b.example/"),
]


def frames(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string"), spark.createDataFrame(RESULTS, "rank long, title string, snippet string, url string").repartition(3)


def test_relevance_to_all(spark):
    queries, results = frames(spark)
    pairs = U.lexical_relevance(results.crossJoin(queries)).select("query_id", "rank", "score").collect()
    got = U.relevance_to_all(queries, results).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, pairs)) and len(got) == len(QUERIES) * len(RESULTS)
    assert max(r["score"] for r in got) > 0.6 and sum(r["score"] > 0 for r in got) > 5


def test_relevance_to_all_is_bounded(spark, monkeypatch):
    queries, results = frames(spark)
    many = results.crossJoin(spark.range(500).select("id")).withColumn("rank", F.col("rank") * 1000 + F.col("id")).coalesce(1)
    rows = U.relevance_to_all(queries, many, top=3).collect()
    exact = {}
    for r in sorted(U.relevance_to_all(queries, many).where("score >= 0.08").collect(), key=lambda r: (-r["score"], r["rank"])):
        exact.setdefault(r["query_id"], []).append(tuple(r))
    assert sorted(map(tuple, rows)) == sorted(r for x in exact.values() for r in x[:3])
    monkeypatch.setattr(U, "MOST_QUERIES", 2)
    assert U.relevance_to_all(queries, results) is None


def test_shared_web_results(spark, monkeypatch):
    queries, results = frames(spark)
    blocked = spark.createDataFrame([("b.example",)], "b string")
    wanted = U.web_results(queries, results.crossJoin(queries.select("query_id")), blocked)
    fields = ["query_id", "query", "rank", "title", "snippet", "url", "place", "score"]
    whole = sorted(map(tuple, wanted.select(fields).collect()))
    assert len(whole) > 3
    assert sorted(map(tuple, U.shared_web_results(queries, results, blocked).select(fields).collect())) == whole
    monkeypatch.setattr(U, "MOST_QUERIES", 2)
    assert sorted(map(tuple, U.shared_web_results(queries, results, blocked).select(fields).collect())) == whole


def test_contexts_of_shared_results(spark):
    queries, results = frames(spark)
    wanted = U.formatted_results(U.web_results(queries, results.crossJoin(queries.select("query_id")))).collect()
    got = U.formatted_results(U.shared_web_results(queries, results)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and len(got) > 3
