"""Queries of each relational kind over the star schema and events, with their DuckDB SQL, and streaming ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.operators import evaluation as E
from lexmill.operators import lexical as L
from lexmill.plans.text_queries import Q as TEXT
from lexmill.sources import tables as S
from lexmill.sources.tables import table
from lexmill.streaming import ops as X

C = F.col
Q: dict = {}


def add(name, sql):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


@add("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@add("join_inner", "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def _(s, d):
    return table(s, d, "orders").join(table(s, d, "lineitem"), C("o_orderkey") == C("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@add("join_left_default", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(s, d):
    n = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(s, d, "customer").join(n, C("c_custkey") == C("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@add("join_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def _(s, d):
    a = table(s, d, "customer").where("c_nationkey < 15").groupBy(C("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(s, d, "supplier").where("s_nationkey > 5").groupBy(C("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer")


@add("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 200000"), C("c_custkey") == C("o_custkey"), "left_semi").select("c_custkey")


@add("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_orderpriority like '1%'"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")


@add("join_theta_contains", "SELECT item_id, count(*) AS n FROM documents JOIN benchmark ON contains(documents.text, benchmark.text) GROUP BY item_id")
def _(s, d):
    passages = table(s, d, "benchmark").select("item_id", C("text").alias("passage"))
    return L.containing(passages, table(s, d, "documents").select("doc_id", "text")).groupBy("item_id").agg(F.count("*").alias("n"))


@add("join_range", "SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'purchase' GROUP BY a.event_id")
def _(s, d):
    # what lies within six hours lies in the same or the next piece of six hours, so a user's events need not meet in one task
    e = table(s, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(C("ts").cast("timestamp")).alias("at"))
    width = 6 * 3_600_000_000
    piece = F.floor(C("at") / width)
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "at", F.explode(F.array(piece, piece + 1)).alias("piece"))
    b = e.select("user_id", C("at").alias("later"), piece.alias("piece"))
    return a.join(b, ["user_id", "piece"]).where((C("later") > C("at")) & (C("later") <= C("at") + width)).groupBy("event_id").agg(F.count("*").alias("n"))


@add("join_asof", "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts")
def _(s, d):
    e = table(s, d, "events").where("event_type in ('purchase', 'view')")
    before = F.last(F.when(C("event_type") == "view", C("event_id")), True).over(Window.partitionBy("user_id").orderBy(C("ts")).rangeBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("ts", F.unix_micros(C("ts").cast("timestamp")))
    return e.withColumn("view_id", before).where("event_type = 'purchase' and view_id is not null").select("event_id", "view_id")


@add("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@add("cube", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def _(s, d):
    return table(s, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"))


@add("distinct_aggregates", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@add("window_ranks", "SELECT o_orderkey, row_number() OVER w AS r, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS p, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy(C("o_totalprice").desc(), "o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.row_number().over(w).alias("r"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("p"), F.lag("o_orderkey").over(w).alias("before"))


@add("topn_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def _(s, d):
    return L.top_k(table(s, d, "orders"), 2, ["o_custkey"], [C("o_totalprice").desc(), "o_orderkey"]).select("o_custkey", "o_orderkey")


@add("set_operations", "SELECT k, 'union' AS op FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'intersect' FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'except' FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def _(s, d):
    c, p = table(s, d, "customer").select(C("c_nationkey").alias("k")), table(s, d, "supplier").select(C("s_nationkey").alias("k"))
    n = table(s, d, "nation").select(C("n_nationkey").alias("k"))
    return c.union(p).distinct().withColumn("op", F.lit("union")).union(c.intersect(p).withColumn("op", F.lit("intersect"))).union(n.subtract(p).withColumn("op", F.lit("except")))


@add("interval_merge", "SELECT user_id, min(ts)::VARCHAR AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, max(ts + INTERVAL 6 HOUR) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM events)) GROUP BY user_id, island")
def _(s, d):
    e = table(s, d, "events").select("user_id", C("ts").alias("start"), (C("ts") + F.expr("INTERVAL 6 HOURS")).alias("stop"))
    merged = E.merged_intervals(e, "user_id")
    return merged.join(e.select("user_id", C("start").alias("at")), "user_id").where((C("at") >= C("start")) & (C("at") <= C("stop"))).groupBy("user_id", "start").agg(F.count("*").alias("n")).select("user_id", F.regexp_replace(C("start").cast("string"), r"(\.\d*?)0+$", "$1").alias("start"), "n")


@add("lost_in_middle", f"SELECT item_id AS query_id, doc_id, CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 + 1 ELSE n - (rank - 2) // 2 END::INT AS place FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM ({TEXT['bm25_topk'][1]}))")
def _(s, d):
    h = L.bm25_topk(table(s, d, "benchmark").select("item_id", "text"), table(s, d, "documents").select("doc_id", "text"))
    return E.lost_in_middle(h.select(C("item_id").alias("query_id"), "doc_id", (C("rank") - 1).alias("rank"))).select("query_id", "doc_id", "place")


RELEVANT = f"SELECT item_id AS query_id, rank, contains(documents.text, benchmark.text) AS rel, (SELECT count(*) FROM documents x WHERE contains(x.text, benchmark.text)) AS n FROM ({TEXT['bm25_topk'][1]}) JOIN documents USING (doc_id) JOIN benchmark USING (item_id)"


@add("mrr_recall_ndcg", f"""SELECT query_id, round(coalesce(max(CASE WHEN rel THEN 1.0 / rank END), 0), 6) AS mrr, round(count(*) FILTER (rel AND rank <= 5) / greatest(any_value(n), count(*) FILTER (rel), 1), 6) AS recall_5, round(count(*) FILTER (rel) / greatest(any_value(n), count(*) FILTER (rel), 1), 6) AS recall_10,
round(sum(CASE WHEN rel THEN 1.0 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, greatest(least(any_value(n), 10), 1) + 1), lambda i: 1.0 / log2(i + 1))), 6) AS ndcg_10 FROM ({RELEVANT}) GROUP BY query_id""")
def _(s, d):
    docs, q = table(s, d, "documents").select("doc_id", "text"), table(s, d, "benchmark").select("item_id", "text")
    held = L.containing(q.select("item_id", C("text").alias("passage")), docs)
    n = held.groupBy("item_id").agg(F.count("*").alias("n_relevant"))
    h = L.bm25_topk(q, docs).join(held.withColumn("relevant", F.lit(True)), ["item_id", "doc_id"], "left").join(n, "item_id", "left")
    return E.ranking_metrics(h.select(C("item_id").alias("query_id"), "rank", F.coalesce("relevant", F.lit(False)).alias("relevant"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant")))


@add("citation_alignment", "SELECT conv_id * 100 + turn AS answer_id, ref FROM conversations, (SELECT unnest([1, 2, 3]) AS ref) WHERE CASE WHEN turn % 3 = 0 THEN true ELSE ref = turn % 3 END")
def _(s, d):
    a = table(s, d, "conversations").select((C("conv_id") * 100 + C("turn")).alias("answer_id"), F.when(C("turn") % 3 == 0, C("text")).otherwise(F.concat("text", F.lit(" ["), (C("turn") % 3).cast("string"), F.lit("]"))).alias("answer"))
    refs = s.createDataFrame([(1,), (2,), (3,)], "ref int")
    cites = a.select("answer_id").join(F.broadcast(refs))
    return E.align_citations(a, cites).select("answer_id", "ref")


@add("kv_upsert", "SELECT k, v FROM (SELECT n_nationkey AS k, 'old' AS v FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey >= 15)")
def _(s, d):
    n = table(s, d, "nation").select(C("n_nationkey").alias("k"))
    return S.upsert_absent(n.where("k < 15").withColumn("v", F.lit("old")), n.withColumn("v", F.lit("new")), "k")


@add("feedback_daily", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    return X.counts_by_window(table(s, d, "events"), "1 day")


@add("sliding_counts", "SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * unnest([0, 1])) AS start FROM events) GROUP BY ALL")
def _(s, d):
    return X.counts_by_window(table(s, d, "events"), "12 hours", "6 hours")


@add("session_debounce", "SELECT user_id AS key, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts >= before + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, i")
def _(s, d):
    return X.debounced(table(s, d, "events").select(C("user_id").alias("key"), "ts"), "1 hour").select("key", "start", "n")


@add("stream_feedback_daily", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    e = table(s, d, "events")
    live = s.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", C("ts").cast("timestamp"))
    return X.run_available(s, X.counts_by_window(live, "1 day"), "complete").withColumn("start", C("start").cast("timestamp_ntz"))


#: A stream's buffer as a fold over its pieces: what is held, and what is handed on at each piece.  The fifth piece ends a stream.
BUFFERED = """WITH RECURSIVE c AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text AS t, turn % 3 = 2 AS r FROM conversations),
f(conv_id, i, c, r, out_c, out_r, ends) AS (SELECT conv_id, 0, '', '', NULL::VARCHAR, NULL::VARCHAR, false FROM (SELECT DISTINCT conv_id FROM c) UNION ALL
 SELECT conv_id, i, CASE WHEN full_ THEN '' ELSE hc END, CASE WHEN full_ THEN '' ELSE hr END, CASE WHEN full_ THEN hc END, CASE WHEN full_ THEN hr END, ends FROM (SELECT *, ends OR length(hc) >= 700 OR length(hr) >= 700 AS full_ FROM (
 SELECT f.conv_id, c.i, c.i = 5 AS ends, f.c || CASE WHEN c.r OR c.i = 5 THEN '' ELSE c.t END AS hc, f.r || CASE WHEN c.r AND c.i <> 5 THEN c.t ELSE '' END AS hr FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1 WHERE NOT f.ends))),
o AS (SELECT conv_id, i * 2 AS k, out_c AS c, out_r AS r FROM f WHERE out_c IS NOT NULL AND (out_c <> '' OR out_r <> '') UNION ALL SELECT f.conv_id, f.i * 2 + 1, CASE WHEN c.r THEN '' ELSE c.t END, CASE WHEN c.r THEN c.t ELSE '' END FROM f JOIN c USING (conv_id, i) WHERE f.ends UNION ALL
 SELECT conv_id, 1000000, c, r FROM f JOIN (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id) USING (conv_id, i) WHERE NOT ends AND (c <> '' OR r <> ''))
SELECT conv_id::VARCHAR AS stream_id, (row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1)::BIGINT AS seq, md5(c) AS content, md5(r) AS reasoning FROM o"""


@add("stream_buffer", BUFFERED)
def _(s, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    t = table(s, d, "conversations").withColumn("i", F.row_number().over(order)).withColumn("r", C("turn") % 3 == 2)
    part = lambda on: F.when(on, C("text")).otherwise("")
    t = t.select(C("conv_id").cast("string").alias("stream_id"), C("turn").alias("seq"), part(~C("r")).alias("content"), part(C("r")).alias("reasoning_content"), (C("i") == 5).alias("done"), F.lit(None).cast("string").alias("error"))
    return X.buffer_streams(t, 700).select("stream_id", "seq", F.md5("content").alias("content"), F.md5("reasoning_content").alias("reasoning"))


@add("watermarked_counts", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL")
def _(s, d):
    # in append mode a window is given once the watermark has passed it: those of the last day are not
    e = table(s, d, "events")
    live = s.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", C("ts").cast("timestamp"))
    return X.run_available(s, X.counts_by_window(live, "1 day"), "append").withColumn("start", C("start").cast("timestamp_ntz"))
