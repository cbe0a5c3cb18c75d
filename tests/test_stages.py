"""Communities, stored vectors, cached embeddings, prompts in batch and as a stream, blocked hosts."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import fusion as U
from lexmill.operators import graph as G
from lexmill.operators import leiden as N
from lexmill.operators import prompts as P
from lexmill.plans import graph_queries
from lexmill.sources import vectors as S
from lexmill.streaming import prompts as L

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    edges = graph_queries.cooccurrence(spark, DIR).where("weight >= 2 and src <> tgt")
    path = G.cut(edges, "test-edges")
    return path


def clusters(rows):
    out = {}
    for r in rows:
        out.setdefault(r["cluster"], set()).add(r["name"])
    return out


def connected(names, edges):
    names, left = set(names), set(names)
    near = {}
    for a, b in edges:
        if a in names and b in names:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    waiting = [min(names)]
    left.discard(waiting[0])
    while waiting:
        for u in near.get(waiting.pop(), set()) & left:
            left.discard(u)
            waiting.append(u)
    return not left


def propagated(edges):
    """Label propagation: each node in turn takes the heaviest label among its neighbours, the least of equals."""
    near = {}
    for r in edges.collect():
        near.setdefault(r["src"], []).append((r["tgt"], r["weight"]))
        near.setdefault(r["tgt"], []).append((r["src"], r["weight"]))
    label = {v: v for v in near}
    for _ in range(10):
        for v in sorted(near):
            votes = {}
            for u, w in near[v]:
                votes[label[u]] = votes.get(label[u], 0) + w
            label[v] = min(votes, key=lambda c: (-votes[c], c))
    return label


@pytest.mark.parametrize("small", [N.SMALL, 6000])
def test_leiden(graph, small):
    """In one task and by rounds: connected, better than label propagation, the same however rows lie."""
    one = graph.select(F.lit("").alias("part"), "src", "tgt", "weight")
    found = N.leiden(one, small).select("name", "cluster").collect()
    pairs = [(r["src"], r["tgt"]) for r in graph.collect()]
    held = clusters(found)
    assert all(connected(v, pairs) for v in held.values()) and all(c == min(v) for c, v in held.items())
    spark = graph.sparkSession
    mine = N.modularity(graph, spark.createDataFrame([(r["name"], r["cluster"]) for r in found], "name string, cluster string"))
    assert mine >= N.modularity(graph, spark.createDataFrame(list(propagated(graph).items()), "name string, cluster string")) and mine > 0.2
    again = N.leiden(one.repartition(7, "tgt"), small).select("name", "cluster").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in found}


def test_hierarchy(spark):
    """Rings of cliques in rings: the first level has the large parts, the next ones the cliques."""
    edges = []
    for t in "xyz":
        cliques = [f"{t}{c}" for c in "abcd"]
        for c in cliques:
            edges += [(f"{c}{i}", f"{c}{j}", 5.0) for i, j in combinations(range(6), 2)]
        edges += [(f"{a}0", f"{b}1", 4.0) for a, b in combinations(cliques, 2)]
    edges += [("xa3", "ya3", 1.0), ("yb3", "za3", 1.0)]
    rows = N.hierarchy(spark.createDataFrame(edges, "src string, tgt string, weight double"), most=10).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["level"]):
        last[r["name"]] = r["cluster"]
    sizes = {}
    for c in last.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert len(last) == 72 and max(sizes.values()) <= 10
    assert all(last[a] == last[b] for a in last for b in last if a[:2] == b[:2])
    level = {(r["name"], r["level"]): r["cluster"] for r in rows}
    assert all(c.startswith(level[n, k - 1] + "/") for (n, k), c in level.items() if k)


def plain_health(rows, now=None):
    h = P.Health()
    for at, _, ok, seconds in sorted(rows):
        h.at(at)
        h.used(at, ok, seconds)
    if now is not None:
        h.at(now)
    return (h.status, h.total, h.good, h.bad, h.row, round(h.average, 9))


def logs(rng, prompts, n):
    out = []
    for p in range(prompts):
        at = 1_700_000_000.0
        for i in range(rng.randint(1, n)):
            at += rng.choice([1, 30, 899, 900, 901, 5000])
            out.append((f"p{p}", at, i, rng.random() < 0.4, rng.choice([0.0, 1.5, 2.25])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "prompt_id string, s double, event_id long, success boolean, seconds double").withColumn("at", F.timestamp_seconds("s")).drop("s")


@pytest.mark.parametrize("now", [None, 1_700_050_000.0])
def test_prompt_windows_are_the_fold(spark, now):
    rows = logs(random.Random(11), 150, 40)
    got = {r["prompt_id"]: (*tuple(r)[1:6], round(r["average_response_time"], 9)) for r in P.health(frame(spark, rows), now=now).collect()}
    for p in {r[0] for r in rows}:
        assert got[p] == plain_health([r[1:] for r in rows if r[0] == p], now), p


def test_prompt_stream_after_restart(spark, tmp_path):
    """Two runs from one checkpoint give what the batch gives for the whole log; what was taken out comes back by a timer."""
    rows = sorted(logs(random.Random(12), 12, 20), key=lambda r: r[1])
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    half = len(rows) // 2
    end = rows[-1][1] + 10_000
    schema = "prompt_id string, event_id long, success boolean, seconds double, at timestamp"
    for part in (rows[:half], rows[half:], [("clock", end, 0, True, 0.0)]):
        frame(spark, part).select("prompt_id", "event_id", "success", "seconds", "at").coalesce(1).write.mode("append").parquet(log)
        stream = L.live_health(spark.readStream.schema(schema).parquet(log))
        query = stream.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).trigger(availableNow=True).start()
        query.awaitTermination()
    last = {}
    for r in spark.read.parquet(out).orderBy("batch", "at").collect():
        last[r["prompt_id"]] = r
    watermark = end - 60
    for p in {r[0] for r in rows}:
        want = plain_health([r[1:] for r in rows if r[0] == p], watermark)
        assert (last[p]["status"], last[p]["total_requests"], last[p]["success_count"], last[p]["failure_count"], last[p]["consecutive_failures"], round(last[p]["average_response_time"], 9)) == want, p


def nearest(rows, q, k):
    x = np.array([v for _, v in rows], float)
    s = np.round(x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), 6)
    return [i for _, i in sorted((-a, i) for a, (i, _) in zip(s, rows))[:k]]


def test_vector_store(spark, tmp_path):
    table = spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding", "label")
    path = str(tmp_path / "store")
    S.create(table.where("vec_id % 5 <> 1"), path, lists=6)
    S.upsert(spark, path, table.where("vec_id % 5 = 1 or vec_id % 7 = 0").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))))
    S.delete(spark, path, table.where("vec_id % 11 = 3").select("vec_id"))
    want = [(r["vec_id"], r["embedding"][::-1] if r["vec_id"] % 7 == 0 else r["embedding"]) for r in table.collect() if r["vec_id"] % 11 != 3]
    assert sorted((r["vec_id"], list(r["embedding"])) for r in S.load(spark, path).collect()) == sorted((i, list(e)) for i, e in want)
    asked = table.where("vec_id % 20 = 0")
    exact = {r["vec_id"]: nearest(want, np.array(r["embedding"], float), 5) for r in asked.collect()}
    got = {}
    for r in S.search(spark, path, asked, 5, probes=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == exact
    plan = S.search(spark, path, asked, 5, probes=2)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    S.delete(spark, path, S.load(spark, path).where("list = 0"))
    assert S.load(spark, path).where("list = 0").count() == 0


def test_embeddings_are_made_once(spark, tmp_path):
    asked = []

    def embed(missing):
        asked.append(missing.count())
        return missing.select("hash", F.array(F.length("text").cast("double")).alias("embedding"))

    path = str(tmp_path / "cache")
    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id long, text string")
    first = {r["id"]: list(r["embedding"]) for r in S.embedded(texts, path, embed).collect()}
    assert first == {1: [1.0], 2: [2.0], 3: [1.0], 4: [0.0]} and asked == [3]
    assert S.embedded(texts, path, embed).count() == 4 and asked == [3]
    S.embedded(texts.union(spark.createDataFrame([(5, "ccc")], "id long, text string")), path, embed)
    assert asked == [3, 1]
    S.forget(spark, path, texts.where("id = 1"))
    S.embedded(texts, path, embed)
    assert asked == [3, 1, 2]


def test_blocked_hosts(spark):
    urls = ["http://a.b.com/x", "https://b.com", "http://xb.com/", "http://c.org", "nothing", None, "http://B.com:80/"]
    rows = spark.createDataFrame([(1, i, "t", u, "s") for i, u in enumerate(urls)], "query_id int, rank int, title string, url string, snippet string")
    blocked = spark.createDataFrame([("b.com",), ("org",), ("",)], "b string")
    assert sorted(r["rank"] for r in U.unblocked(rows, blocked).collect()) == [2, 4, 5, 6]


def test_tokens_are_the_columns(spark):
    from lexmill.functions import text as T
    from lexmill.operators import ranking as R

    texts = ["Abc d1 É x", "中文字ab 中 x9", "", "İK a-b_c 12", "日本語テキスト the"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.tokens(F.col("text")).alias("t")).collect()
    assert all(sorted(r["t"]) == sorted(R.tokens(r["text"])) for r in rows)


def test_ranking_is_the_joins(spark, monkeypatch):
    """Both ways to rank give the same lists, with ties, repeats, nulls and CJK."""
    from lexmill.operators import lexical as X
    from lexmill.operators import ranking as R

    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)] + ["中文", "the"]
    rows = [(i % 150, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(170)] + [(500, None), (501, "w1 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(15)] + [(99, None), (98, "zzz")], "item_id long, text string")
    one, two = X.bm25_and_overlap(queries, docs, 6)
    best = X.bm25_topk(queries, docs, 6)
    monkeypatch.setattr(R, "MOST_PAIRS", 1)
    other = X.bm25_topk(queries, docs, 6)
    got = lambda d, c: sorted((r["item_id"], r["rank"], r["doc_id"], round(r[c], 5)) for r in d.collect())
    unique = docs.dropDuplicates(["doc_id"])
    assert got(best, "score") == got(one, "score") and got(two, "shared")
    monkeypatch.undo()
    fast, fast_shared = X.bm25_and_overlap(queries, unique, 6)
    monkeypatch.setattr(R, "MOST_PAIRS", 1)
    slow, slow_shared = X.bm25_and_overlap(queries, unique, 6)
    assert got(fast, "score") == got(slow, "score") and got(fast_shared, "shared") == got(slow_shared, "shared")
    assert other.count() > 0
