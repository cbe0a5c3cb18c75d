"""Retrieval as one operator: candidates by vectors and words, fusion, phrases, diversity, groups, tables, context.

All queries of a table run together, each within its own document.  Hits are told apart by their text, as in
``fusion``; a ranked list has query_id, chunk (the key of a text in its document), rank (from 0) and similarity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.questions import rewritten
from lexmill.operators import context as X
from lexmill.operators import fusion as U
from lexmill.operators import groups as G
from lexmill.operators import lexical as L
from lexmill.stage import cut


@dataclass(frozen=True)
class Settings:
    """What a retrieval may be told.  ``rerank`` gives hits (query_id, query, chunk, ...) a ``score``."""

    top: int = 10
    candidates: int = 20
    rerank: Callable[[DataFrame], DataFrame] | None = None
    per_group: int = 2
    least_chunks: int = 10
    tables: int = 3
    phrases: int = 5
    phrase_similarity: float = 0.95
    table_similarity: float = 0.45
    neighbours: int = 1


def prepared(queries: DataFrame, s: Settings) -> DataFrame:
    """(query_id, doc_id, query, vector, query_type, candidates) of (query_id, doc_id, query, selected, vector): rewritten, typed, and with the size of its pool."""
    rows = queries.withColumn("query", rewritten(F.col("query"), F.col("selected"))).drop("selected")
    rows = rows.withColumn("query_type", T.query_type(F.col("query")))
    pool = F.greatest(F.lit(s.candidates), T.by_key(F.col("query_type"), T.CANDIDATES, 20), F.lit(s.top), F.lit(s.top * 5 if s.rerank else 0))
    return rows.withColumn("candidates", pool)


def pooled(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """The chunks of documents that are asked about, each tokenised once, and told apart by text.

    ``key`` is the document and the first chunk of it with the same text; ranked lists carry it in place of the text, as
    ``chunk``.  Columns: doc_id, chunk_idx, key, text, page, e (unit vector), toks.
    """
    same = Window.partitionBy("doc_id", "chunk")
    rows = chunks.join(asked.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("first", F.min("chunk_idx").over(same))
    return rows.select("doc_id", "chunk_idx", F.struct("doc_id", F.col("first").alias("at")).alias("key"), F.col("chunk").alias("text"), "page", T.normalised(F.col("embedding")).alias("e"), T.tokens(F.col("chunk")).alias("toks"))


def _firsts(pool: DataFrame) -> DataFrame:
    return pool.where(F.col("chunk_idx") == F.col("key.at"))


def vector_list(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """Each query's nearest chunks of its document by cosine, similarity (cos + 1) / 2, the lower chunk first among equals."""
    near = asked.select("query_id", "doc_id", "candidates", T.normalised(F.col("vector")).alias("v"))
    scored = pool.select("doc_id", "chunk_idx", F.col("key").alias("chunk"), "e").join(near, "doc_id").withColumn("similarity", F.round(T.similarity_of(T.dot(F.col("v"), F.col("e")), "ip"), 9)).drop("e", "v")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_idx")
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < F.col("candidates")).select("query_id", "chunk", "similarity", "rank")


def word_list(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """Each query's best chunks of its document by BM25, among the document's chunks alone."""
    rows = pool.select(F.struct("chunk_idx", "key").alias("row"), "doc_id", "toks")
    scored = L.term_hits(asked.select("query_id", "doc_id", F.col("query").alias("text")), rows, "query_id", "row", "doc_id", "toks")
    scored = scored.join(asked.select("query_id", "candidates"), "query_id").withColumn("score", F.round("score", 6)).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "row.chunk_idx")
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < F.col("candidates")).select("query_id", F.col("row.key").alias("chunk"), "rank")


def inject_phrases(hits: DataFrame, asked: DataFrame, pool: DataFrame, s: Settings) -> DataFrame:
    """Hits and behind them up to five chunks that hold a query of several words as it stands and are no hits."""
    phrase = F.lower(F.regexp_replace("query", r"^\s+|\s+$", ""))
    some = asked.select("query_id", "doc_id", phrase.alias("phrase")).where((F.length("phrase") > 3) & F.contains("phrase", F.lit(" ")))
    found = _firsts(pool).select("doc_id", F.col("key").alias("chunk"), "text").join(some, "doc_id").where(F.contains(F.lower("text"), "phrase")).select("query_id", "chunk")
    found = found.join(hits.select("query_id", "chunk"), ["query_id", "chunk"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("chunk")
    some = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= s.phrases)
    last = hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    more = some.join(last, "query_id", "left").select("query_id", "chunk", F.lit(s.phrase_similarity).alias("similarity"), (F.coalesce("last", F.lit(-1)) + F.col("n")).alias("rank"))
    return hits.unionByName(more)


def boosted(hits: DataFrame, asked: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, chunk, text, similarity, rank): similarities adjusted for phrases, tables and references, and the list in their order."""
    texts = _firsts(pool).select(F.col("key").alias("key"), "text")
    rows = hits.join(asked.select("query_id", "query"), "query_id").withColumnRenamed("chunk", "key").join(texts, "key")
    rows = U.phrase_boost(rows.withColumnRenamed("text", "chunk"))
    order = Window.partitionBy("query_id").orderBy(F.col("adjusted").desc(), "rank")
    return rows.select("query_id", F.col("key").alias("chunk"), F.col("chunk").alias("text"), F.col("adjusted").alias("similarity"), (F.row_number().over(order) - 1).alias("rank"))


def diverse(hits: DataFrame, top: int) -> DataFrame:
    """Lists of more than ``top`` cut to three times that by diversity."""
    return U.mmr(hits, top * 3, text="text").select("query_id", "chunk", "similarity", (F.col("place") - 1).alias("rank"))


def with_groups(hits: DataFrame, asked: DataFrame, pool: DataFrame, groups: DataFrame, s: Settings) -> DataFrame:
    """Hits fused with the groups nearest to the query by the distance of digests, where a document has ten chunks or more and groups.

    ``groups`` has doc_id, group_no, chunk_indices, embedding.  Queries of other documents keep their hits.
    """
    large = pool.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= s.least_chunks).select("doc_id")
    some = asked.join(large, "doc_id").select("query_id", "doc_id", T.normalised(F.col("vector")).alias("v"))
    near = groups.select("doc_id", "group_no", F.col("embedding").alias("e")).join(some, "doc_id")
    far = F.aggregate(F.zip_with("v", "e", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
    order = Window.partitionBy("query_id").orderBy("far", "group_no")
    found = near.withColumn("far", F.round(far, 9)).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < 2 * s.top)
    name = F.struct("doc_id", "group_no")
    members = groups.select("doc_id", name.alias("group_id"), F.explode("chunk_indices").alias("chunk_idx")).join(pool.select("doc_id", "chunk_idx", F.col("key").alias("chunk")), ["doc_id", "chunk_idx"]).select("group_id", "chunk").distinct()
    grouped = cut(found.select("query_id", name.alias("group_id"), "rank"), "grouped")
    ids = grouped.select("query_id").distinct()
    fused = U.group_fusion(hits.join(ids, "query_id", "left_semi"), grouped, cut(members, "members"), s.top, s.per_group)
    kept = fused.join(hits.select("query_id", "chunk", F.col("similarity").alias("own")), ["query_id", "chunk"], "left")
    kept = kept.select("query_id", "chunk", F.coalesce("own", F.lit(0.5)).alias("similarity"), (F.col("rank") - 1).alias("rank"))
    return kept.unionByName(hits.join(ids, "query_id", "left_anti").select("query_id", "chunk", "similarity", "rank"))


def widened(hits: DataFrame, pool: DataFrame, n: int) -> DataFrame:
    """``hits`` with ``expanded``: each hit's chunk between up to ``n`` before and after it, joined by line feeds.

    Null where there is none to add, and where an earlier hit of the query has the same stretch.
    """
    if n <= 0:
        return hits.withColumn("expanded", F.lit(None).cast("string"))
    at = F.col("chunk.at")
    wide = hits.select("query_id", "rank", F.col("chunk.doc_id").alias("doc_id"), F.explode(F.sequence(at - n, at + n)).alias("chunk_idx"))
    near = wide.join(pool.select("doc_id", "chunk_idx", "text"), ["doc_id", "chunk_idx"])
    made = near.groupBy("query_id", "rank", "doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))).alias("c"))
    again = Window.partitionBy("query_id", "doc_id", F.col("c")[0]["chunk_idx"], F.element_at("c", -1)["chunk_idx"]).orderBy("rank")
    text = F.when((F.size("c") > 1) & (F.row_number().over(again) == 1), F.array_join("c.text", "\n"))
    return hits.join(made.select("query_id", "rank", text.alias("expanded")), ["query_id", "rank"], "left")


def add_tables(hits: DataFrame, asked: DataFrame, pool: DataFrame, s: Settings) -> DataFrame:
    """(query_id, query, doc_id, chunk, similarity, rank, page, table_augmented, expanded): hits, by text again, and behind them up to three chunks that look like tables, stand on a page of a hit and are no hits.

    Hits get the page of the first chunk of their text.
    """
    first = _firsts(pool)
    fields = ["query_id", "doc_id", "chunk", "text", "similarity", "rank", "page", "table_augmented", "expanded"]
    rows = hits.join(first.select(F.col("key").alias("chunk"), "doc_id", "text", "page"), "chunk", "left").withColumn("table_augmented", F.lit(False)).select(*fields)
    looks = first.where(T.is_likely_table(F.col("text"))).select("doc_id", "page", F.col("key").alias("chunk"), "text")
    near = looks.join(rows.select("query_id", "doc_id", "page").distinct(), ["doc_id", "page"]).join(hits.select("query_id", "chunk"), ["query_id", "chunk"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("chunk")
    some = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= s.tables)
    last = hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    more = some.join(last, "query_id").withColumns({"similarity": F.lit(s.table_similarity), "rank": F.col("last") + F.col("n"), "table_augmented": F.lit(True), "expanded": F.lit(None).cast("string")}).select(*fields)
    out = rows.unionByName(more).drop("chunk").withColumnRenamed("text", "chunk")
    return out.join(asked.select("query_id", "query"), "query_id")


def retrieve(queries: DataFrame, chunks: DataFrame, groups: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """(query_id, doc_id, chunk, similarity, rank, page, table_augmented, expanded, snippet, highlights) for (query_id, doc_id, query, selected, vector).

    ``chunks`` has doc_id, chunk_idx, chunk, page and embedding.  The vector list takes up phrases, is boosted and made
    diverse, and is fused with BM25; a reranker orders what is left; groups, neighbours and tables come last.  Each of
    these lists is a stage: it is written once and read by the later ones, with keys of chunks in place of their texts.
    """
    s = settings
    asked = cut(prepared(queries, s), "asked")
    pool = cut(pooled(chunks, asked), "pool")
    hits = cut(vector_list(asked, pool), "vectors")
    hits = boosted(inject_phrases(hits, asked, pool, s), asked, pool)
    hits = cut(hits.drop("text") if s.rerank else diverse(hits, s.top), "hits")
    words = cut(word_list(asked, pool), "words")
    fused = U.hybrid_merge(hits, words, asked, s.top)
    own = hits.groupBy("query_id", "chunk").agg(F.min_by("similarity", "rank").alias("similarity"))
    out = fused.join(own, ["query_id", "chunk"], "left").select("query_id", "chunk", F.coalesce("similarity", F.lit(0.5)).alias("similarity"), (F.col("rank") - 1).alias("rank"))
    if s.rerank:
        texts = _firsts(pool).select(F.col("key").alias("chunk"), "text")
        shown = out.join(asked.select("query_id", "query"), "query_id").join(texts, "chunk").withColumnRenamed("chunk", "key").withColumnRenamed("text", "chunk")
        scored = U.rerank_normalised(s.rerank(shown))
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
        out = boosted(scored.select("query_id", F.col("key").alias("chunk"), F.bround(F.col("percent") / 100, 4).alias("similarity"), (F.row_number().over(best) - 1).alias("rank")), asked, pool).drop("text")
    out = cut(out, "fused")
    if groups is not None:
        out = cut(with_groups(out, asked, pool, groups, s), "grouped-hits")
    out = cut(add_tables(widened(out, pool, s.neighbours), asked, pool, s), "retrieved")
    keys = [c for c in out.columns if c != "query"]
    return L.snippets(out.withColumn("text", F.col("chunk")), keys)


def group_members(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """(group_id, chunk): which texts a group holds."""
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("group_no").cast("string"))
    return groups.select("doc_id", name.alias("group_id"), F.explode("chunk_indices").alias("chunk_idx")).join(chunks.select("doc_id", "chunk_idx", "chunk"), ["doc_id", "chunk_idx"]).select("doc_id", "group_id", "chunk").distinct()


def contexts(hits: DataFrame, queries: DataFrame, chunks: DataFrame, groups: DataFrame, budget: int = 6500) -> tuple[DataFrame, DataFrame]:
    """Contexts (query_id, context, citations) and their traces, from hits as ``retrieve`` gives them.

    Groups are ranked by their hits, cut to the number of the question's kind, given granularities by place, fitted to
    the token budget and put together; ``groups`` has doc_id, group_no, chunk_indices, full_text, digest, summary,
    keywords, page_start, page_end.
    """
    kinds = queries.select("query_id", "query", T.query_type(F.col("query")).alias("kind"))
    most = T.by_key(F.col("kind"), {k: v[1] for k, v in T.GRANULARITY.items()}, 5)
    ranked = G.rank_groups(hits.select("query_id", "doc_id", "chunk", "rank", "similarity"), group_members(groups, chunks), ["doc_id", "chunk"])
    order = Window.partitionBy("query_id").orderBy("rank", "group_id")
    ranked = ranked.withColumn("rank", F.row_number().over(order) - 1).join(kinds, "query_id").where(F.col("rank") < most)
    named = groups.withColumn("group_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("group_no").cast("string"))).drop("doc_id", "group_no")
    chosen = cut(G.granularity_mixed(ranked.join(named, "group_id")), "chosen")
    fitted = G.fit_within_budget(chosen, budget)
    used = chosen.drop("granularity").join(fitted.select("query_id", "rank", "granularity"), ["query_id", "rank"])
    text: Column = T.by_key(F.col("granularity"), {"full": F.col("full_text"), "digest": F.col("digest")}, F.col("summary"))
    lit = X.highlight_text(used.select("query_id", "rank", "query", F.col("best_chunk").alias("chunk")), ["query_id", "rank"])
    made = X.build_context(used.withColumn("text", text).join(lit, ["query_id", "rank"]))
    return made, X.trace_meta(fitted, hits)
