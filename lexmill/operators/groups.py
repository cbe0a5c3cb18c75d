"""Semantic groups of chunks, granularity and token budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

LARGEST, TARGET = 6000, 5000
SUMMARY, DIGEST = 80, 1000


#: First lines that begin a block: numbered and Markdown headings, code fences, table rows.
BLOCK_START = r"^\d+(\.\d+)*\.?\s+\S|^#{1,6}\s+\S|^```|^.*\|.*\|"


def starts_block(text: Column) -> Column:
    """Whether a chunk's first line is a heading (its ASCII letters, two at least, all capitals will do), a table row or a code fence."""
    line = F.regexp_replace(F.split(text, "\n")[0], r"^\s+|\s+$", "")
    letters = F.regexp_replace(line, "[^a-zA-Z]", "")
    return line.rlike(BLOCK_START) | ((F.length(letters) >= 2) & (letters == F.upper(letters)))


def boundaries(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with ``boundary``: the page changes, or the chunk begins a block.  The first chunk has none."""
    w = Window.partitionBy(key).orderBy("chunk_idx")
    before = F.lag("page").over(w)
    return chunks.withColumn("boundary", F.coalesce((before != F.col("page")) | (F.lag("chunk_idx").over(w).isNotNull() & starts_block(F.col("chunk"))), F.lit(False)))


def aggregate_chunks(chunks: DataFrame, largest: int = LARGEST, target: int = TARGET, key: str = "doc_id") -> DataFrame:
    """(key, group_no, chunk_indices, full_text, char_count, page_start, page_end).

    A group ends before a boundary, before a chunk that would make it longer than ``largest``, and once it has
    ``target`` characters.  The fold goes over the lengths of one document's chunks.
    """
    rows = boundaries(chunks, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_idx", F.length("chunk").alias("n"), "boundary"))).alias("c"))
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("used"), F.array().cast("array<struct<chunk_idx:int,group_no:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        full = (acc["used"] > 0) & (c["boundary"] | (acc["used"] + c["n"] > largest) | (acc["used"] >= target))
        g = acc["g"] + full.cast("int")
        return F.struct(g.alias("g"), (F.when(full, 0).otherwise(acc["used"]) + c["n"]).alias("used"), F.array_append(acc["out"], F.struct(c["chunk_idx"].cast("int").alias("chunk_idx"), g.alias("group_no"))).alias("out"))

    placed = rows.select(key, F.explode(F.aggregate("c", start, step, lambda a: a["out"])).alias("p")).select(key, "p.chunk_idx", "p.group_no")
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk")))
    grouped = placed.join(chunks, [key, "chunk_idx"]).groupBy(key, "group_no").agg(parts.alias("c"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    text = F.array_join(F.col("c.chunk"), "\n")
    return grouped.select(key, "group_no", F.col("c.chunk_idx").alias("chunk_indices"), text.alias("full_text"), F.length(text).alias("char_count"), "page_start", "page_end")


def digests(groups: DataFrame) -> DataFrame:
    """Summary and digest where no model writes them: the beginning of the text, and whether it was cut."""
    cut = lambda n: F.substring("full_text", 1, n)
    return groups.withColumns({"summary": cut(SUMMARY), "digest": cut(DIGEST), "summary_status": F.when(F.length("full_text") > SUMMARY, "failed").otherwise("ok")})


def granularity_mixed(ranked: DataFrame) -> DataFrame:
    """Granularity by place: the first in full, two as digests, the rest as summaries."""
    return ranked.withColumn("granularity", F.when(F.col("rank") == 0, "full").when(F.col("rank") <= 2, "digest").otherwise("summary"))


def rank_groups(hits: DataFrame, members: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(query_id, group_id, rank, similarity, best_chunk): groups by the best place of their chunks; those under half the best similarity go where that exceeds a half."""
    best_chunk = F.min_by("chunk", F.struct(-F.col("similarity"), "rank"))
    g = hits.join(members, on or ["chunk"]).groupBy("query_id", "group_id").agg(F.min("rank").alias("rank"), F.max("similarity").alias("similarity"), best_chunk.alias("best_chunk"))
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    return g.withColumn("best", best).where((F.col("best") <= 0.5) | (F.col("similarity") >= 0.5 * F.col("best"))).drop("best")


def budget_prefix(ranked: DataFrame, budget: int, by: str, order: list, size: Column) -> DataFrame:
    """Rows whose running size stays within the budget."""
    used = F.sum(size).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", used).where(F.col("used") <= budget)


def fit_within_budget(selected: DataFrame, budget: int = 6500) -> DataFrame:
    """(query_id, rank, granularity, tokens) of (query_id, rank, granularity, full_text, digest, summary).

    A group that does not fit steps down from full to digest to summary; the first that does not fit even so
    ends the query's list.
    """
    need = selected.select("query_id", "rank", "granularity", *[T.estimate_tokens(F.col(c)).alias(n) for n, c in (("full", "full_text"), ("digest", "digest"), ("summary", "summary"))])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        levels, used, out = ["full", "digest", "summary"], 0, []
        for r in pdf.sort_values("rank").to_dict("records"):
            fit = next((x for x in levels[levels.index(r["granularity"]) :] if used + r[x] <= budget), None)
            if fit is None:
                break
            used += r[fit]
            out.append((key[0], r["rank"], fit, r[fit]))
        return pd.DataFrame(out, columns=["query_id", "rank", "granularity", "tokens"])

    kind = selected.schema["query_id"].dataType.simpleString()
    return need.groupBy("query_id").applyInPandas(run, f"query_id {kind}, rank int, granularity string, tokens long")


def granularity_dynamic(ranked: DataFrame, budget: int = 6500) -> DataFrame:
    """(query_id, rank, granularity, tokens) of (query_id, rank, query_type, char_count, full_text, digest, summary).

    As many groups as the kind of question takes; the first in full (an overview's as a digest), two in the kind's
    own granularity, the rest as summaries, as are groups of under 500 characters.  What does not fit steps down.
    """
    kind, rank = F.col("query_type"), F.col("rank")
    most = T.by_key(kind, {k: v[1] for k, v in T.GRANULARITY.items()}, 5)
    base = T.by_key(kind, {k: v[0] for k, v in T.GRANULARITY.items()}, "digest")
    wanted = F.when(F.col("char_count") < 500, "summary").when(rank == 0, F.when(kind == "overview", "digest").otherwise("full")).when(rank < 3, base).otherwise("summary")
    return fit_within_budget(ranked.where(rank < most).withColumn("granularity", wanted), budget)


def document_map(groups: DataFrame, most: int = 50, key: str = "doc_id") -> DataFrame:
    """(key, group_no, char_count, keywords, summary, page_start, page_end): a document's first groups, summaries cut at 200 characters."""
    return groups.where(F.col("group_no") < most).select(key, "group_no", "char_count", "keywords", F.substring("summary", 1, 200).alias("summary"), "page_start", "page_end")


def fetched(granularity: Column, most: int = 8000) -> Column:
    """A group's text of a granularity; where that is empty the full text, digest or summary, whichever is not."""
    asked = T.by_key(granularity, {"full": F.col("full_text"), "digest": F.col("digest")}, F.col("summary"))
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.substring(F.coalesce(filled(asked), filled(F.col("full_text")), filled(F.col("digest")), filled(F.col("summary")), F.lit("")), 1, most)


def dynamic_budget(window: Column, ratio: float, reserve: Column | int = 1500, least: int = 2000) -> Column:
    """Tokens for the context: a share of the model's window less what the answer needs."""
    return F.greatest(F.floor(window * ratio) - reserve, F.lit(least))
