"""Retrieval and citation metrics, citation alignment, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def ranking_metrics(ranked: DataFrame) -> DataFrame:
    """mrr, recall_5, recall_10 and ndcg_10 per query of (query_id, rank from 1, relevant boolean, n_relevant)."""
    hit = F.col("relevant")
    gain = F.when(hit & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = ranked.groupBy("query_id").agg(
        F.coalesce(F.max(F.when(hit, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"), F.count_if(hit & (F.col("rank") <= 5)).alias("h5"), F.count_if(hit & (F.col("rank") <= 10)).alias("h10"), F.sum(gain).alias("dcg"), F.max("n_relevant").alias("n")
    )
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n", F.lit(10)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    n = F.greatest("n", "h10", F.lit(1))
    return per.select("query_id", F.round("mrr", 6).alias("mrr"), F.round(F.col("h5") / n, 6).alias("recall_5"), F.round(F.col("h10") / n, 6).alias("recall_10"), F.round(F.col("dcg") / best, 6).alias("ndcg_10"))


def align_citations(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations (answer_id, ref, ...) whose number the answer uses, in order of first use; all where it uses none."""
    used = answers.select("answer_id", T.inline_refs(F.col("answer")).alias("refs"))
    placed = citations.join(used, "answer_id").withColumn("place", F.when(F.size("refs") == 0, F.col("ref")).otherwise(F.array_position("refs", F.col("ref"))))
    return placed.where("place > 0").drop("refs")


def citation_support(answers: DataFrame, citations: DataFrame, least: float = 0.08) -> DataFrame:
    """Per sentence of an answer that cites: the best token overlap with what it cites, and whether it is supported."""
    rows = answers.select("answer_id", F.posexplode(T.sentences(F.col("answer"))).alias("idx", "sentence"))
    rows = rows.withColumn("ref", F.explode(T.inline_refs(F.col("sentence")))).join(citations.select("answer_id", "ref", "highlight"), ["answer_id", "ref"])
    one, two = (F.array_distinct(T.tokens(F.col(c))) for c in ("sentence", "highlight"))
    share = F.size(F.array_intersect(one, two)) / F.greatest(F.size(one), F.lit(1))
    return rows.groupBy("answer_id", "idx").agg(F.round(F.max(share), 6).alias("overlap")).withColumn("supported", F.col("overlap") >= least)


def lost_in_middle(ranked: DataFrame) -> DataFrame:
    """``place``: the best at both ends (1, 3, 5 ... 6, 4, 2)."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    return ranked.withColumn("place", F.when(F.col("rank") % 2 == 0, F.col("rank") / 2 + 1).otherwise(n - (F.col("rank") - 1) / 2).cast("int"))


def merged_intervals(spans: DataFrame, by: str) -> DataFrame:
    """Overlapping or touching [start, stop) spans of each group merged: islands where a span starts beyond all before it."""
    order = Window.partitionBy(by).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > reach, 1).otherwise(0)).over(order)
    return spans.withColumn("reach", reach).withColumn("island", island).groupBy(by, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")
