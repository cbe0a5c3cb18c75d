"""Conversational memory: pairs and windows of turns, life-cycle rules, scores, compression, injection.

Times are compared with ``now``, a literal, so results do not hang on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import fusion as U
from lexmill.operators import lexical as L
from lexmill.operators import vector as V
from lexmill.stage import cut

HALF_LIFE_DAYS = 30
#: The order of tiers in injected context.
TIERS = ["long_term", "short_term", "working", "archived"]


def qa_pairs(turns: DataFrame) -> DataFrame:
    """User turns with the assistant turn right after them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def last_pairs(turns: DataFrame, n: int = 3, question: int = 100, answer: int = 200) -> DataFrame:
    """The last ``n`` pairs of each conversation, cut to fixed lengths."""
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    rows = qa_pairs(turns).withColumn("age", order).where(F.col("age") <= n)
    return rows.select("conv_id", "turn", "age", F.substring("question", 1, question).alias("question"), F.substring("answer", 1, answer).alias("answer"))


def working_window(turns: DataFrame, rounds: int = 10) -> DataFrame:
    """Turns of each conversation's last rounds; a round begins with a user turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    numbered = turns.withColumn("round", F.sum((F.col("role") == "user").cast("int")).over(w))
    last = F.max("round").over(Window.partitionBy("conv_id"))
    return numbered.withColumn("last", last).where(F.col("round") > F.col("last") - rounds).drop("last")


def flush_due(turns: DataFrame, threshold: int = 4000) -> DataFrame:
    """Conversations whose estimated tokens come to the threshold."""
    return turns.groupBy("conv_id").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens")).where(F.col("tokens") >= threshold)


def days_since(then: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / 86_400_000_000


def dynamic_score(memories: DataFrame, now: Column, doc_id: Column) -> Column:
    """rrf * (0.5 + importance) * decay * hit bonus * 1.2 for the same document."""
    days = days_since(F.coalesce("last_hit_at", "created_at"), now)
    decay = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.pow(F.lit(2.0), -days / HALF_LIFE_DAYS)))
    hits = 1 + F.least(F.lit(0.3), 0.1 * F.log2(1 + F.col("hit_count")))
    return F.col("rrf") * (0.5 + F.col("importance")) * decay * hits * F.when(F.col("doc_id") == doc_id, 1.2).otherwise(1.0)


def tier_rules(now: Column) -> Column:
    """Promote what is hit often and lately; archive what is old and hardly hit."""
    last = days_since(F.col("last_hit_at"), now)
    idle = days_since(F.coalesce("last_hit_at", "created_at"), now)
    return (
        F.when((F.col("memory_tier") == "short_term") & (F.col("hit_count") >= 5) & (last <= 7), "long_term")
        .when((F.col("memory_tier") == "long_term") & (F.col("hit_count") < 3) & (idle > 90), "archived")
        .otherwise(F.col("memory_tier"))
    )


def importance_rules(now: Column) -> Column:
    """Raise or lower importance by hits and idle days; full importance and changes of at most 0.05 stay."""
    days, hits, old = days_since(F.coalesce("last_hit_at", "created_at"), now), F.col("hit_count"), F.col("importance")
    raised = F.when((hits >= 10) & (days <= 3), 1.0).when((hits >= 5) & (days <= 7), 0.8).when((hits >= 3) & (days <= 14), 0.6)
    lowered = F.when(days > 180, 0.1).when((days > 90) & (hits < 3), 0.3).when((days > 60) & (hits < 2), 0.4)
    new = F.coalesce(F.when(raised > old, raised), F.when(lowered < old, lowered), old)
    return F.when((old < 1.0) & (F.abs(new - old) > 0.05), new).otherwise(old)


def record_hits(memories: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Add the number of hits of each id, and set the last hit of those hit."""
    n = hits.groupBy("id").agg(F.count("*").alias("new_hits"))
    rows = memories.join(n, "id", "left")
    return rows.withColumns({"hit_count": F.col("hit_count") + F.coalesce("new_hits", F.lit(0)), "last_hit_at": F.when(F.col("new_hits") > 0, now).otherwise(F.col("last_hit_at"))}).drop("new_hits")


def compressed(memories: DataFrame, into: int = 5, over: int = 20) -> DataFrame:
    """(doc_id, bucket, content, importance): documents with more than ``over`` memories get them merged, oldest first, into ``into`` runs of equal size.

    Blank contents are left out, and a run of nothing else is none; every run has the document's greatest importance.
    """
    by_doc = Window.partitionBy("doc_id")
    rows = memories.withColumns({"n": F.count("*").over(by_doc), "importance": F.max("importance").over(by_doc)}).where(F.col("n") > over)
    place = F.row_number().over(by_doc.orderBy("created_at", "id")) - 1
    rows = rows.withColumn("bucket", F.floor(place / F.ceil(F.col("n") / into)).cast("int")).withColumn("place", place)
    parts = F.array_sort(F.collect_list(F.struct("place", "content")))
    merged = rows.where(F.regexp_replace("content", r"\s", "") != "").groupBy("doc_id", "bucket").agg(parts.alias("p"), F.max("importance").alias("importance"))
    return merged.select("doc_id", "bucket", F.array_join(F.col("p.content"), " ").alias("content"), "importance")


def _cost(content: Column) -> Column:
    """Half a token a character, one at least; none for nothing."""
    return F.when(F.length(content) > 0, F.greatest(F.floor(F.length(content) / 2), F.lit(1))).otherwise(0)


def injected(memories: DataFrame, budget: int = 800, by: str = "conv_id") -> DataFrame:
    """Most important first, half a token a character, as long as the budget lasts; tiers in their fixed order."""
    order = Window.partitionBy(by).orderBy(F.col("importance").desc(), "id")
    used = F.sum(_cost(F.col("content"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    tier = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), F.col("memory_tier")), F.lit(0)), F.lit(len(TIERS) + 1))
    return memories.withColumns({"used": used, "place": F.row_number().over(order)}).where(F.col("used") <= budget).withColumn("tier_place", tier)


#: How tiers and sources are named in contexts and logs, and the heads of these.
TIER_LABELS = {"long_term": "[长期记忆]", "short_term": "[文档记忆]", "working": "[工作记忆]", "archived": "[归档记忆]"}
SOURCE_LABELS = {"auto_qa": "自动摘要", "manual": "手动记忆", "liked": "点赞记忆", "keyword": "关键词", "llm_distilled": "LLM 提炼"}
CONTEXT_HEAD, SUMMARY_HEAD = "用户历史记忆：", "## 记忆摘要\n"


def memory_block(chosen: DataFrame, by: str = "conv_id", most: int = 10) -> DataFrame:
    """(by, context) of ``injected`` rows: a list for each known tier, or beyond ``most`` memories one sentence of their beginnings."""
    trimmed_ = F.regexp_replace("content", r"^\s+|\s+$", "")
    label = T.by_key(F.col("memory_tier"), TIER_LABELS, "")
    rows = chosen.withColumns({"t": trimmed_, "label": label})
    n = rows.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("place", "t")))).alias("all"))
    short = F.transform("all.t", lambda t: F.concat(F.substring(t, 1, 20), F.when(F.length(t) > 20, "...").otherwise("")))
    more = F.when(F.size("all") > 5, F.concat(F.lit(" 等 "), F.size("all").cast("string"), F.lit(" 项"))).otherwise("")
    told = F.when(F.size("all") > 0, F.concat(F.lit("共 "), F.col("n").cast("string"), F.lit(" 条记忆，涵盖："), F.array_join(F.slice(short, 1, 5), "；"), more)).otherwise("无可用记忆")
    lines = F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("place", F.concat(F.lit("- "), "label", F.lit(" "), "t").alias("line")))))
    tiers = rows.where(F.col("label") != "").groupBy(by, "tier_place", "label").agg(lines.alias("l"))
    block = F.concat_ws("\n", F.concat(F.lit("## "), "label"), F.nullif(F.array_join("l.line", "\n"), F.lit("")))
    lists = tiers.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("tier_place", block.alias("block")))).alias("b"))
    return n.join(lists, by, "left").select(by, F.when(F.col("n") > most, F.concat(F.lit(SUMMARY_HEAD), told)).otherwise(F.coalesce(F.array_join("b.block", "\n\n"), F.lit(""))).alias("context"))


def retrieve(queries: DataFrame, memories: DataFrame, now: Column, top: int = 3) -> DataFrame:
    """(query_id, id, content, source_type, doc_id, score, rank) for (query_id, query, vector, doc_id) over (id, content, embedding, ...).

    The best by cosine and the best by BM25 are fused, half and half, and ordered by the dynamic score; memories of
    equal content are one hit, told by the least id.  Memories whose vector is null or holds no numbers are found by their
    words alone.  Filters on memories belong before the call.
    """
    others = F.struct(*[c for c in memories.columns if c != "content"])
    held = cut(memories.where("content is not null").groupBy("content").agg(F.min_by(others, "id").alias("r")).select("content", "r.*"), "memories")
    # numbers that rise with the ids, so that ties go to the least id
    numbered = cut(held.select("id", "embedding").orderBy("id").withColumn("vec_id", F.monotonically_increasing_id()), "numbered")
    asked = cut(queries.select("query_id", F.col("vector").alias("embedding")).withColumn("vec_id", F.monotonically_increasing_id()), "asked")
    near = V.knn(numbered, asked, top, places=9).select(F.col("query_id").alias("nth"), "vec_id", "score")
    near = near.join(asked.select("query_id", F.col("vec_id").alias("nth")), "nth").join(numbered.select("id", "vec_id"), "vec_id")
    vectors = L.top_k(near.select("query_id", "id", "score"), top, ["query_id"], [F.col("score").desc(), "id"]).join(held.select("id", "content"), "id")
    vectors = vectors.select("query_id", F.col("content").alias("chunk"), (F.col("rank") - 1).alias("rank"))
    words = L.bm25_topk(queries.select("query_id", F.col("query").alias("text")), held.select("id", F.col("content").alias("text")), top, "query_id", "id")
    words = words.join(held.select("id", "content"), "id").select("query_id", F.col("content").alias("chunk"), (F.col("rank") - 1).alias("rank"))
    fused = U.hybrid_merge(vectors, words, queries.select("query_id", F.lit("specific").alias("query_type")), top)
    # a list alone has no fused score: its order stays
    rows = fused.withColumn("rrf", F.coalesce("rrf_score", F.lit(0.0))).select("query_id", F.col("chunk").alias("content"), "rrf", F.col("rank").alias("place"))
    rows = rows.join(held.drop("embedding"), "content").join(queries.select("query_id", F.col("doc_id").alias("asked_doc")), "query_id")
    rows = rows.withColumn("score", F.round(dynamic_score(rows, now, F.col("asked_doc")), 9))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "id", "content", "source_type", "doc_id", "score", "rank")


def memory_context(hits: DataFrame) -> DataFrame:
    """(query_id, context) of retrieved memories: a line for each, with its source."""
    line = F.concat(F.lit("- ["), F.coalesce("source_type", F.lit("unknown")), F.lit("] "), "content")
    made = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return made.select("query_id", F.concat(F.lit(CONTEXT_HEAD + "\n"), F.array_join("l.line", "\n")).alias("context"))


def important_memories(marked: DataFrame) -> DataFrame:
    """Memories of marked answers (id, question, answer, source_type, created_at, doc_id): of full importance, long-term at once."""
    content = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer")
    return marked.select("id", content.alias("content"), "source_type", "created_at", "doc_id", F.lit(1.0).alias("importance"), F.lit("long_term").alias("memory_tier"))


def qa_summaries(turns: DataFrame, n: int = 3) -> DataFrame:
    """(conv_id, turn, content, source_type, importance): the last pairs of each conversation, cut, as memories."""
    p = last_pairs(turns, n)
    content = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer")
    return p.select("conv_id", "turn", content.alias("content"), F.lit("auto_qa").alias("source_type"), F.lit(0.5).alias("importance"))


def log_entries(memories: DataFrame) -> DataFrame:
    """(day, created_at, entry): Markdown entries of a memory log, one file a day; long-term ones stand in a file of their own."""
    long_term = F.col("memory_tier") == "long_term"
    label = T.by_key(F.col("source_type"), SOURCE_LABELS, F.col("source_type"))
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    entry = F.concat(F.when(long_term, "##").otherwise("###"), F.lit(" ["), label, F.lit("] "), at, F.lit("\n\n"), "content", F.lit("\n\n---\n"))
    return memories.select(F.when(long_term, "MEMORY").otherwise(F.date_format("created_at", "yyyy-MM-dd")).alias("day"), "created_at", "id", entry.alias("entry"))


def status(memories: DataFrame) -> DataFrame:
    """(memory_tier, n, indexed): memories of each tier, and how many of them have a vector."""
    return memories.groupBy("memory_tier").agg(F.count("*").alias("n"), F.count("embedding").alias("indexed"))


def with_tag(tags: Column, tag: str) -> Column:
    return F.array_sort(F.array_union(tags, F.array(F.lit(tag))))


def without_tag(tags: Column, tag: str) -> Column:
    return F.array_remove(tags, tag)


def trimmed(memories: DataFrame, limit: int = 50, by: str = "doc_id") -> DataFrame:
    """At most ``limit`` a document: the oldest of less than full importance go first, important ones never."""
    n = F.count("*").over(Window.partitionBy(by))
    light = F.col("importance") < 1.0
    age = F.row_number().over(Window.partitionBy(by, light).orderBy("created_at", "id"))
    return memories.withColumns({"n": n, "age": age}).where(~(light & (F.col("age") <= F.col("n") - limit))).drop("n", "age")


def active_pool(accesses: DataFrame, capacity: int = 100) -> DataFrame:
    """The ids used last: one row an id, the ``capacity`` latest."""
    return accesses.groupBy("id").agg(F.max("at").alias("at")).orderBy(F.col("at").desc(), "id").limit(capacity)


def keyword_focus(turns: DataFrame, by: str, stop_words: list[str], threshold: int = 3) -> DataFrame:
    """(by, keyword, n): keywords of the user's turns, each once a turn, seen at least ``threshold`` times."""
    words = F.filter(F.array_distinct(T.tokens(F.col("text"))), lambda w: (F.length(w) >= 2) & ~w.isin(stop_words))
    return turns.where("role = 'user'").select(by, F.explode(words).alias("keyword")).groupBy(by, "keyword").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
