"""Queries over conversations and memories, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import memory as M
from lexmill.sources import vectors as W
from lexmill.sources.tables import table
from lexmill.stage import scratch

C = F.col
Q: dict = {}
STOP = ["the", "and", "of", "to", "de", "la", "le", "und", "der", "die", "que", "el"]
TOKENS = "list_filter(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9]+'), lambda t: length(t) > 1)"
#: Memories made of events: each user's events are hits on the memory of their day.
MEMORIES = """
SELECT user_id || ':' || day AS id, 'memory ' || user_id || ' ' || day AS content, day AS created_at, (user_id % 7)::BIGINT AS doc_id, (user_id % 11) / 10.0 AS importance, n AS hit_count, last AS last_hit_at,
  CASE WHEN user_id % 2 = 0 THEN 'short_term' ELSE 'long_term' END AS memory_tier, n / 60.0 AS rrf
FROM (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL)"""
NOW = "TIMESTAMP '2024-03-15 00:00:00'"


def add(name, sql):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


def memories(s, d):
    e = table(s, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.date_trunc("day", "ts").alias("created_at")).agg(F.count("*").alias("hit_count"), F.max("ts").alias("last_hit_at"))
    return g.select(
        F.concat(C("user_id").cast("string"), F.lit(":"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("id"), F.concat(F.lit("memory "), C("user_id").cast("string"), F.lit(" "), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("content"), "created_at",
        (C("user_id") % 7).alias("doc_id"), ((C("user_id") % 11) / 10.0).alias("importance"), "hit_count", "last_hit_at", F.when(C("user_id") % 2 == 0, "short_term").otherwise("long_term").alias("memory_tier"), (C("hit_count") / 60.0).alias("rrf"),
    )


def now():
    return F.to_timestamp(F.lit("2024-03-15 00:00:00"))


PAIRS = "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'"


@add("qa_pairs", f"SELECT conv_id, turn, md5(question) AS q, md5(answer) AS a FROM ({PAIRS})")
def _(s, d):
    return M.qa_pairs(table(s, d, "conversations")).select("conv_id", "turn", F.md5("question").alias("q"), F.md5("answer").alias("a"))


@add("last_pairs", f"SELECT conv_id, turn, age::INT AS age, substr(question, 1, 100) AS question, substr(answer, 1, 200) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM ({PAIRS})) WHERE age <= 3")
def _(s, d):
    return M.last_pairs(table(s, d, "conversations"))


@add("working_window", "SELECT conv_id, turn, role, r::BIGINT AS round FROM (SELECT *, max(r) OVER (PARTITION BY conv_id) AS last FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)) WHERE r > last - 2")
def _(s, d):
    return M.working_window(table(s, d, "conversations"), 2).select("conv_id", "turn", "role", "round")


@add("memory_flush", r"SELECT conv_id, sum(ceil((length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) / 1.5 + length(regexp_replace(text, '[一-鿿]', '', 'g')) / 4.0))::BIGINT AS tokens FROM conversations GROUP BY conv_id HAVING tokens >= 400")
def _(s, d):
    return M.flush_due(table(s, d, "conversations"), 400)


@add("keyword_focus", f"SELECT conv_id, keyword, count(*) AS n FROM (SELECT conv_id, unnest(list_distinct({TOKENS})) AS keyword FROM conversations WHERE role = 'user') WHERE keyword NOT IN ({', '.join(repr(w) for w in STOP)}) GROUP BY ALL HAVING n >= 2")
def _(s, d):
    return M.keyword_focus(table(s, d, "conversations"), "conv_id", STOP, 2)


@add("memory_dynamic_score", f"SELECT id, round(rrf * (0.5 + importance) * greatest(0.1, least(1.0, pow(2, -(epoch_us({NOW}) - epoch_us(last_hit_at)) / 86400000000.0 / 30))) * (1 + least(0.3, 0.1 * log2(1 + hit_count))) * CASE WHEN doc_id = 3 THEN 1.2 ELSE 1 END, 6) AS score FROM ({MEMORIES})")
def _(s, d):
    m = memories(s, d)
    return m.select("id", F.round(M.dynamic_score(m, now(), F.lit(3)), 6).alias("score"))


@add("memory_tiers", f"SELECT id, CASE WHEN memory_tier = 'short_term' AND hit_count >= 5 AND epoch_us({NOW}) - epoch_us(last_hit_at) <= 7 * 86400000000 THEN 'long_term' WHEN memory_tier = 'long_term' AND hit_count < 3 AND epoch_us({NOW}) - epoch_us(last_hit_at) > 90 * 86400000000 THEN 'archived' ELSE memory_tier END AS tier FROM ({MEMORIES})")
def _(s, d):
    return memories(s, d).select("id", M.tier_rules(now()).alias("tier"))


@add("importance_rules", f"""
SELECT id, round(CASE WHEN importance < 1 AND abs(new - importance) > 0.05 THEN new ELSE importance END, 6) AS importance FROM (
SELECT *, coalesce(CASE WHEN up > importance THEN up END, CASE WHEN down < importance THEN down END, importance) AS new FROM (
SELECT *, CASE WHEN hit_count >= 10 AND days <= 3 THEN 1.0 WHEN hit_count >= 5 AND days <= 7 THEN 0.8 WHEN hit_count >= 3 AND days <= 14 THEN 0.6 END AS up, CASE WHEN days > 180 THEN 0.1 WHEN days > 90 AND hit_count < 3 THEN 0.3 WHEN days > 60 AND hit_count < 2 THEN 0.4 END AS down
FROM (SELECT *, (epoch_us({NOW}) - epoch_us(last_hit_at)) / 86400000000.0 AS days FROM ({MEMORIES}))))""")
def _(s, d):
    return memories(s, d).select("id", F.round(M.importance_rules(now()), 6).alias("importance"))


@add("record_hits", f"SELECT id, hit_count + coalesce(h, 0) AS hit_count, CASE WHEN h > 0 THEN {NOW} ELSE last_hit_at END AS last_hit_at FROM ({MEMORIES}) LEFT JOIN (SELECT id, count(*) AS h FROM ({MEMORIES}) WHERE doc_id = 2 GROUP BY id) USING (id)")
def _(s, d):
    m = memories(s, d)
    return M.record_hits(m, m.where("doc_id = 2").select("id"), now()).select("id", "hit_count", "last_hit_at")


@add("compress_buckets", f"""
SELECT doc_id, bucket::INT AS bucket, md5(string_agg(content, ' ' ORDER BY place)) AS content, any_value(most)::DOUBLE AS importance FROM (
SELECT *, place // ceil(n / 5.0)::BIGINT AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at, id) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n, max(importance) OVER (PARTITION BY doc_id) AS most FROM ({MEMORIES}))) WHERE n > 20 AND trim(content) <> '' GROUP BY ALL""")
def _(s, d):
    return M.compressed(memories(s, d)).withColumn("content", F.md5("content")).withColumn("importance", C("importance").cast("double"))


COST = "CASE WHEN length(content) > 0 THEN greatest(length(content) // 2, 1) ELSE 0 END"
CHOSEN = f"SELECT * FROM (SELECT *, sum({COST}) OVER w AS used, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, id) AS place FROM ({MEMORIES}) WINDOW w AS (PARTITION BY doc_id ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING))"


@add("memory_injection", f"SELECT doc_id, id, used::BIGINT AS used FROM ({CHOSEN}) WHERE used <= 800")
def _(s, d):
    return M.injected(memories(s, d), 800, "doc_id").select("doc_id", "id", "used")


def _tier_block(tier: str) -> str:
    label = M.TIER_LABELS[tier]
    return f"CASE WHEN count(*) FILTER (memory_tier = '{tier}') > 0 THEN '## {label}' || chr(10) || string_agg('- {label} ' || content, chr(10) ORDER BY place) FILTER (memory_tier = '{tier}') END"


@add("memory_block", f"""WITH c AS (SELECT doc_id, id, content, memory_tier, place FROM ({CHOSEN}) WHERE used <= CASE WHEN doc_id % 2 = 0 THEN 90 ELSE 400 END)
SELECT doc_id, md5(CASE WHEN count(*) > 10 THEN '## 记忆摘要' || chr(10) || '共 ' || count(*) || ' 条记忆，涵盖：' || array_to_string(list(substr(content, 1, 20) || CASE WHEN length(content) > 20 THEN '...' ELSE '' END ORDER BY place)[1:5], '；') || ' 等 ' || count(*) || ' 项'
 ELSE concat_ws(chr(10) || chr(10), {", ".join(map(_tier_block, M.TIERS))}) END) AS context FROM c GROUP BY doc_id""")
def _(s, d):
    m = memories(s, d)
    few, many = (M.injected(m.where(f"doc_id % 2 = {k}"), b, "doc_id") for k, b in ((0, 90), (1, 400)))
    return M.memory_block(few.unionByName(many), "doc_id").withColumn("context", F.md5("context"))


@add("memory_log", f"SELECT CASE WHEN memory_tier = 'long_term' THEN 'MEMORY' ELSE strftime(created_at, '%Y-%m-%d') END AS day, id, md5(CASE WHEN memory_tier = 'long_term' THEN '##' ELSE '###' END || ' [' || CASE doc_id % 3 WHEN 0 THEN '手动记忆' WHEN 1 THEN '自动摘要' ELSE 'other' END || '] ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || chr(10) || chr(10) || content || chr(10) || chr(10) || '---' || chr(10)) AS entry FROM ({MEMORIES})")
def _(s, d):
    m = memories(s, d).withColumn("source_type", T.by_key(C("doc_id") % 3, {0: "manual", 1: "auto_qa"}, "other"))
    return M.log_entries(m).select("day", "id", F.md5("entry").alias("entry"))


@add("memory_status", f"SELECT memory_tier, count(*) AS n, count(*) FILTER (doc_id <> 1) AS indexed FROM ({MEMORIES}) GROUP BY memory_tier")
def _(s, d):
    return M.status(memories(s, d).withColumn("embedding", F.when(C("doc_id") != 1, F.array(F.lit(1.0)))))


@add("memory_tags", "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN turn % 2 = 0 THEN ['fact', role] ELSE [role] END, ['fact']))), ',') AS added, CASE WHEN turn % 2 = 0 THEN role ELSE role END AS removed FROM conversations")
def _(s, d):
    tags = F.when(C("turn") % 2 == 0, F.array(F.lit("fact"), "role")).otherwise(F.array("role"))
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(M.with_tag(tags, "fact"), ",").alias("added"), F.array_join(M.without_tag(tags, "fact"), ",").alias("removed"))


@add("important_memories", f"SELECT conv_id, turn, md5('Q: ' || question || chr(10) || 'A: ' || answer) AS content, 1.0 AS importance, 'long_term' AS memory_tier FROM ({PAIRS})")
def _(s, d):
    p = M.qa_pairs(table(s, d, "conversations")).withColumns({"id": F.concat_ws(":", "conv_id", "turn"), "source_type": F.lit("liked"), "created_at": now(), "doc_id": C("conv_id")})
    m = M.important_memories(p)
    return m.select(F.split("id", ":")[0].cast("long").alias("conv_id"), F.split("id", ":")[1].cast("long").alias("turn"), F.md5("content").alias("content"), "importance", "memory_tier")


@add("qa_summaries", f"SELECT conv_id, turn, md5('Q: ' || substr(question, 1, 100) || chr(10) || 'A: ' || substr(answer, 1, 200)) AS content, 0.5 AS importance FROM ({PAIRS}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def _(s, d):
    return M.qa_summaries(table(s, d, "conversations")).select("conv_id", "turn", F.md5("content").alias("content"), "importance")


#: A stand-in for an embedding model: counts of tokens by a hash of sixteen values.  The fixtures have no vectors of texts.
WIDTH = 16


def hashed_embedding(text):
    place = F.transform(T.tokens(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % WIDTH).cast("int"))
    none = F.array_repeat(F.lit(0.0), WIDTH)
    # one fold over the tokens, as a use of them for each place would make them anew
    return F.aggregate(place, none, lambda acc, p: F.transform(acc, lambda x, i: x + F.when(i == p, 1.0).otherwise(0.0)))


EMBEDDED = f"list_transform(range({WIDTH}), lambda j: len(list_filter({TOKENS}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {WIDTH} = j))::DOUBLE)"
ANSWERS = f"""SELECT min(id) AS id, content, any_value(e) AS e, min_by(conv_id, id) AS conv_id FROM (SELECT conv_id || ':' || turn AS id, text AS content, conv_id, {EMBEDDED} AS e FROM conversations WHERE role = 'assistant') GROUP BY content"""
REMEMBERED = f"""WITH m AS MATERIALIZED (SELECT id, content, e, conv_id, {TOKENS.replace('text', 'content')} AS toks FROM ({ANSWERS})), q AS MATERIALIZED (SELECT conv_id * 100 + turn AS query_id, text AS query, conv_id, {EMBEDDED} AS v, {TOKENS} AS toks FROM conversations WHERE role = 'user' AND conv_id % 20 = 0),
v AS (SELECT query_id, content, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) - 1 AS rank FROM (SELECT query_id, content, id, round(coalesce(list_inner_product(v, e) / nullif(sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(e, e)), 0), 0), 9) AS s FROM q, m) QUALIFY rank < 3),
tf AS (SELECT id, len(any_value(toks)) AS dl, term, count(*) AS tf FROM (SELECT id, toks, unnest(toks) AS term FROM m) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(toks) AS term FROM q) GROUP BY ALL), st AS (SELECT count(*) AS n, greatest(avg(len(toks)), 1.0) AS avgdl FROM m),
w AS (SELECT query_id, id, round(sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS s FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL),
b AS (SELECT query_id, content, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) - 1 AS rank FROM w JOIN m USING (id) WHERE s > 0 QUALIFY rank < 3),
u AS (SELECT query_id, content, rank, 0 AS l FROM v UNION ALL SELECT query_id, content, rank, 1 FROM b), f AS (SELECT query_id, content, sum(0.5 / (61 + rank)) AS s, min(l) AS l, min_by(rank, l) AS r, max(l) AS h FROM u GROUP BY ALL),
g AS (SELECT *, CASE WHEN min(l) OVER (PARTITION BY query_id) = 0 AND max(h) OVER (PARTITION BY query_id) = 1 THEN round(s, 9) END AS rrf FROM f), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, l, r, content) AS place FROM g QUALIFY place <= 3),
x AS (SELECT query_id, m.id, content, m.conv_id AS doc_id, place, round(coalesce(rrf, 0) * (0.5 + (m.conv_id % 11) / 10.0) * greatest(0.1, pow(2, -(m.conv_id % 60) / 30.0)) * (1 + least(0.3, 0.1 * log2(1 + m.conv_id % 9))) * CASE WHEN m.conv_id = q.conv_id THEN 1.2 ELSE 1 END, 9) AS score FROM t JOIN m USING (content) JOIN q USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM x"""


def remembered(s, d):
    t = table(s, d, "conversations")
    held = t.where("role = 'assistant'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), C("text").alias("content"), hashed_embedding(C("text")).alias("embedding"), F.lit("auto_qa").alias("source_type"), C("conv_id").alias("doc_id"), ((C("conv_id") % 11) / 10.0).alias("importance"), (C("conv_id") % 9).alias("hit_count"))
    held = held.withColumns({"created_at": now() - F.make_interval(days=(C("doc_id") % 60).cast("int")), "last_hit_at": F.lit(None).cast("timestamp")})
    q = t.where("role = 'user' and conv_id % 20 = 0").select((C("conv_id") * 100 + C("turn")).alias("query_id"), C("text").alias("query"), hashed_embedding(C("text")).alias("vector"), C("conv_id").alias("doc_id"))
    return M.retrieve(q, held, now())


@add("memory_retrieve", f"SELECT query_id, id, doc_id, score, rank::INTEGER AS rank FROM ({REMEMBERED})")
def _(s, d):
    return remembered(s, d).select("query_id", "id", "doc_id", "score", "rank")


@add("memory_context", f"SELECT query_id, md5('用户历史记忆：' || chr(10) || string_agg('- [auto_qa] ' || content, chr(10) ORDER BY rank)) AS context FROM ({REMEMBERED}) GROUP BY query_id")
def _(s, d):
    return M.memory_context(remembered(s, d)).withColumn("context", F.md5("context"))


@add("memory_trim", f"SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id, importance < 1 ORDER BY created_at, id) AS age FROM ({MEMORIES})) WHERE NOT (importance < 1 AND age <= n - 50)")
def _(s, d):
    return M.trimmed(memories(s, d)).select("id")


@add("active_pool", "SELECT user_id AS id, max(ts) AS last_at FROM events GROUP BY user_id ORDER BY last_at DESC, id LIMIT 100")
def _(s, d):
    return M.active_pool(table(s, d, "events").select(C("user_id").alias("id"), C("ts").alias("at"))).withColumnRenamed("at", "last_at")


@add("feedback_stats", "SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS likes, count(*) FILTER (event_type IN ('click', 'view')) AS dislikes FROM events")
def _(s, d):
    return table(s, d, "events").agg(F.count("*").alias("total"), F.count_if(C("event_type") == "purchase").alias("likes"), F.count_if(C("event_type").isin("click", "view")).alias("dislikes"))


@add("prompt_health", """
SELECT event_type, count(*) FILTER (value >= 50) AS successes, count(*) FILTER (value < 50) AS failures, round(avg(value) FILTER (r <= 20), 6) AS recent FROM (
SELECT *, row_number() OVER (PARTITION BY event_type, value >= 50 ORDER BY ts DESC, event_id DESC) + CASE WHEN value >= 50 THEN 0 ELSE 1000000000 END AS r FROM events) GROUP BY event_type""")
def _(s, d):
    from pyspark.sql import Window

    good = C("value") >= 50
    r = F.row_number().over(Window.partitionBy("event_type", good).orderBy(C("ts").desc(), C("event_id").desc()))
    rows = table(s, d, "events").withColumn("r", r)
    return rows.groupBy("event_type").agg(F.count_if(good).alias("successes"), F.count_if(~good).alias("failures"), F.round(F.avg(F.when(good & (C("r") <= 20), C("value"))), 6).alias("recent"))


@add("memory_add_defaults", f"SELECT conv_id, turn, CASE WHEN role = 'system' THEN 1.0 ELSE 0.5 END AS importance, 'short_term' AS memory_tier FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.when(C("role") == "system", 1.0).otherwise(0.5).alias("importance"), F.lit("short_term").alias("memory_tier"))


@add("llm_cache_keys", "SELECT conv_id, turn, md5('model' || chr(31) || role || chr(31) || text) AS cache_key FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(F.concat_ws("\x1f", F.lit("model"), "role", "text")).alias("cache_key"))


@add("embedding_cache", f"SELECT conv_id, turn, array_to_string(list_transform({EMBEDDED}, lambda x: x::INTEGER::VARCHAR), ',') AS embedding FROM conversations")
def _(s, d):
    path = scratch(s, "embeddings")
    texts = table(s, d, "conversations").select("conv_id", "turn", "text")
    embed = lambda missing: missing.select("hash", hashed_embedding(C("text")).alias("embedding"))
    W.embedded(texts.where("turn < 2"), path, embed)
    made = W.embedded(texts, path, embed)
    return made.select("conv_id", "turn", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))
