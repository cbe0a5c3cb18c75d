"""Fusing and adjusting ranked lists.

A ranked list has query_id, chunk, rank (from 0) and similarity; hits are told apart by their text, so equal
texts merge and their reciprocal ranks add up.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.functions import text as T
from lexmill.operators.lexical import top_k
from lexmill.stage import cut

K = 60
#: Most queries, and characters of these, that are sent to all tasks, and scores that a task holds at once.
MOST_QUERIES, MOST_CHARACTERS, CELLS = 10_000, 8_000_000, 1_000_000


def rrf(lists: list[DataFrame], weights: list[Column | float] | None = None, top: int | None = None, k: int = K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; first come first among equal scores."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select("query_id", "chunk", "rank", F.lit(i).alias("list"), ((w if isinstance(w, Column) else F.lit(w)) / (k + F.col("rank") + 1)).alias("gain")) for i, (x, w) in enumerate(zip(lists, weights))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.min(F.struct("list", "rank"))
    fused = out.groupBy("query_id", "chunk").agg(F.round(F.sum("gain"), 9).alias("rrf_score"), first.alias("first"))
    order = [F.col("rrf_score").desc(), F.col("first.list"), F.col("first.rank"), F.col("chunk")]
    return top_k(fused, top or (1 << 30), ["query_id"], order).select("query_id", "chunk", "rrf_score", "rank")


def hybrid_merge(vector: DataFrame, lexical: DataFrame, kinds: DataFrame, top: int = 10, k: int = K) -> DataFrame:
    """Weighted fusion, the vector list's weight by the query's kind (query_id, query_type).

    A query with one list empty keeps the other as it stands, cut to ``top``.  Both lists go through one shuffle:
    whether a query has both is a flag over its rows.
    """
    part = lambda x, i: x.select("query_id", "chunk", "rank", F.lit(i).alias("list"))
    rows = part(vector, 0).unionByName(part(lexical, 1)).join(kinds.select("query_id", "query_type"), "query_id", "left")
    weight = F.coalesce(T.by_key(F.col("query_type"), T.ALPHA, 0.5), F.lit(0.5))
    gain = F.when(F.col("list") == 0, weight).otherwise(1 - weight) / (k + F.col("rank") + 1)
    per = rows.groupBy("query_id", "chunk").agg(F.sum(gain).alias("s"), F.min(F.struct("list", "rank")).alias("first"), F.min("list").alias("low"), F.max("list").alias("high"))
    every = Window.partitionBy("query_id")
    both = (F.min("low").over(every) == 0) & (F.max("high").over(every) == 1)
    fused = per.withColumn("rrf_score", F.when(both, F.round("s", 9)))
    order = every.orderBy(F.col("rrf_score").desc(), "first.list", "first.rank", "chunk")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "chunk", "rrf_score", "rank")


def phrase_boost(hits: DataFrame, boost: float = 1.2) -> DataFrame:
    """Adjust similarity (query, chunk, similarity): table fragments halve, reference lists lose a third, phrases and high coverage gain."""
    q = F.trim(F.lower("query"))
    terms = F.filter(F.split(q, r"[\s,;，。；、]+"), lambda t: F.length(t) > 1)
    chunk = F.lower("chunk")
    coverage = F.size(F.filter(terms, lambda t: F.contains(chunk, t))) / F.greatest(F.size(terms), F.lit(1))
    capped = lambda f: F.least(F.col("similarity") * f, F.lit(1.0))
    adjusted = (
        F.when(F.length(q) < 2, F.col("similarity"))
        .when(F.length("chunk") == 0, F.col("similarity"))
        .when(T.is_table_fragment(F.col("chunk")), F.col("similarity") * 0.5)
        .when(~T.is_reference_query(F.col("query")) & T.is_reference_like(F.col("chunk")), F.col("similarity") * 0.65)
        .when(F.contains(chunk, q), capped(F.lit(boost)))
        .when((F.size(terms) > 0) & (coverage >= 0.8), capped(1.0 + (boost - 1.0) * coverage * 0.5))
        .otherwise(F.col("similarity"))
    )
    return hits.withColumn("adjusted", F.round(adjusted, 6))


def mmr(hits: DataFrame, k: int = 5, weight: float = 0.5, most: int = 600, text: str = "chunk") -> DataFrame:
    """(query_id, place, chunk, similarity): greedy diversity over (query_id, chunk, similarity, rank), relevance less likeness to what is chosen.

    Likeness is the Jaccard similarity of white-space words in the first ``most`` characters.  The first of the
    ranked list comes first, the earlier of equals next; a list of at most ``k`` stays as it is.  Candidates of a
    query are a ranked list cut to a few dozen, so a group is small.  ``text`` names the column of the words.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank").to_dict("records")
        words = [set(r[text][:most].split()) for r in rows]
        like, left, chosen = [0.0] * len(rows), list(range(len(rows))), []
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (weight * rows[i]["similarity"] - (1 - weight) * like[i], -i)) if chosen else left[0]
            chosen.append(best)
            left.remove(best)
            for i in left:
                like[i] = max(like[i], len(words[i] & words[best]) / max(len(words[i] | words[best]), 1))
        chosen = chosen if len(rows) > k else list(range(len(rows)))
        return pd.DataFrame({"query_id": [key[0]] * len(chosen), "place": range(1, len(chosen) + 1), "chunk": [rows[i]["chunk"] for i in chosen], "similarity": [rows[i]["similarity"] for i in chosen]})

    kind = {c: hits.schema[c].dataType.simpleString() for c in ("query_id", "chunk")}
    return hits.select(*dict.fromkeys(["query_id", "chunk", text, "similarity", "rank"])).groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, place int, chunk {kind['chunk']}, similarity double")


def rerank_normalised(hits: DataFrame) -> DataFrame:
    """Scores of each query stretched to 40 to 99; a lone score, or equal ones, give 40."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("percent", F.round(40 + (F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0) * 59, 2))


def by_similarity(hits: DataFrame) -> DataFrame:
    """The order where no reranker answers: by similarity, the earlier of equals first."""
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "rank")
    return hits.withColumn("rank", F.row_number().over(order) - 1)


def adaptive_filter(scored: DataFrame, floor: float = 0.08, share: float = 0.35, none: float = 0.02) -> DataFrame:
    """Keep what scores at least max(floor, share of the query's best); nothing where the best is at most ``none``."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("best", best).where((F.col("best") > none) & (F.col("score") >= F.greatest(F.lit(floor), share * F.col("best")))).drop("best")


def group_fusion(chunk_hits: DataFrame, group_hits: DataFrame, members: DataFrame, top: int = 10, per_group: int = 2, k: int = K) -> DataFrame:
    """Fuse chunk ranks with the ranks that chunks inherit from their groups; at most ``per_group`` chunks of a group.

    ``members`` has group_id, chunk; ``group_hits`` has query_id, group_id, rank.
    """
    inherited = group_hits.join(members, "group_id").select("query_id", "chunk", "rank")
    fused = rrf([chunk_hits.select("query_id", "chunk", "rank"), inherited], None, None, k)
    own = members.groupBy("chunk").agg(F.min("group_id").alias("group_id"))
    order = Window.partitionBy("query_id", "group_id", F.when(F.col("group_id").isNull(), F.col("chunk"))).orderBy("rank")
    kept = fused.join(own, "chunk", "left").withColumn("in_group", F.row_number().over(order)).where(F.col("in_group") <= per_group)
    return top_k(kept.drop("rank", "in_group"), top, ["query_id"], [F.col("rrf_score").desc(), "chunk"])


#: Words of technical questions, and hosts that are noise for these.
TECHNICAL_WORDS = ["论文", "方法", "模型", "算法", "攻击", "防御", "鲁棒", "公式", "实验", "asr", "adversarial", "model", "method", "algorithm", "benchmark", "loss", "dataset"]
NOISY_HOSTS = ["instagram.com", "ameblo.jp", "weibo.com", "x.com", "twitter.com", "facebook.com"]
CJK, KANA = "[一-鿿]", "[぀-ヿ]"


def relevance_tokens(text: Column) -> Column:
    """Distinct ASCII runs of two or more characters, and CJK runs of two or more with their pairs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ascii_ = F.regexp_extract_all(low, F.lit("([a-z0-9]{2,})"), 1)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    runs = F.regexp_extract_all(low, F.lit(f"({CJK}{{2,}})"), 1)
    return F.array_distinct(F.concat(ascii_, runs, F.flatten(F.transform(runs, pairs))))


def _told() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))


def _noisy() -> Column:
    host = T.domain(F.coalesce("url", F.lit("")))
    return reduce(Column.__or__, [T.is_blocked(host, F.lit(h)) for h in NOISY_HOSTS])


def lexical_relevance(pairs: DataFrame) -> DataFrame:
    """``score`` of (query, title, snippet, url): 0.65 of the query's tokens in the title and 0.35 of those in title and snippet.

    The query as it stands there adds 0.2; kana results of a CJK query count 0.45, noisy hosts of a technical one
    a half.  Queries without tokens score 0.
    """
    text = _told()
    rows = pairs.withColumns({"__q": relevance_tokens(F.col("query")), "__t": relevance_tokens(F.col("title")), "__b": relevance_tokens(text), "__all": text})
    n = F.greatest(F.size("__q"), F.lit(1))
    share = lambda c: F.size(F.array_intersect("__q", c)) / n
    score = share("__t") * 0.65 + share("__b") * 0.35 + F.when((F.col("query") != "") & F.contains(F.lower("__all"), F.lower("query")), 0.2).otherwise(0.0)
    kana = F.when(F.col("query").rlike(CJK) & F.col("__all").rlike(KANA), 0.45).otherwise(1.0)
    noise = F.when(T.contains_any(F.lower("query"), TECHNICAL_WORDS) & _noisy(), 0.5).otherwise(1.0)
    return rows.withColumn("score", F.round(F.when(F.size("__q") > 0, score * kana * noise).otherwise(0.0), 12)).drop("__q", "__t", "__b", "__all")


def _relevance_tokens(low: str) -> set[str]:
    """``relevance_tokens`` of a text in lower case."""
    out = set(_WORD.findall(low))
    for run in _RUN.findall(low):
        out.add(run)
        out.update(run[i : i + 2] for i in range(len(run) - 1))
    return out


_WORD, _RUN = re.compile("[a-z0-9]{2,}"), re.compile(f"{CJK}{{2,}}")


def _rounded(values: np.ndarray) -> np.ndarray:
    """Rounded to twelve places as the column function does, half up by the decimal digits."""
    some, at = np.unique(values, return_inverse=True)
    unit = Decimal(1).scaleb(-12)
    return np.array([float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in some.tolist()], float)[at]


def relevance_to_all(queries: DataFrame, results: DataFrame, top: int | None = None, floor: float = 0.08) -> DataFrame | None:
    """(query_id, rank, score) as by ``lexical_relevance``, of every query (query_id, query) and every result (rank, title, snippet, url).

    The queries go to all tasks, a result is taken apart once, and a batch of results is scored against all queries at
    once.  With ``top`` a task passes on, of each query, the ``top`` best that it has seen of at least ``floor``, the
    first by rank of equals.  None where the queries are not bounded.
    """
    n, size = queries.agg(F.count("*"), F.sum(F.length("query"))).first()
    if n > MOST_QUERIES or (size or 0) > MOST_CHARACTERS:
        return None
    of_query = {"tokens": relevance_tokens(F.col("query")), "low": F.coalesce(F.lower("query"), F.lit("")), "cjk": F.coalesce(F.col("query").rlike(CJK), F.lit(False)), "technical": F.coalesce(T.contains_any(F.lower("query"), TECHNICAL_WORDS), F.lit(False))}
    asked = queries.select("query_id", *[c.alias(name) for name, c in of_query.items()]).collect()
    asked.sort(key=lambda r: len(r["low"]))
    owners: dict[str, list[int]] = {}
    for i, r in enumerate(asked):
        for t in r["tokens"]:
            owners.setdefault(t, []).append(i)
    lengths, lows = [len(r["low"]) for r in asked], [r["low"] for r in asked]
    counts = np.array([len(r["tokens"]) for r in asked], float)
    flags = np.array([r["cjk"] for r in asked], bool), np.array([r["technical"] for r in asked], bool)
    empty = bisect_right(lengths, 0)
    names = pa.array([r["query_id"] for r in asked], to_arrow_type(queries.schema["query_id"].dataType))
    sent = queries.sparkSession.sparkContext.broadcast((owners, lengths, lows, counts, flags, names))
    kind = results.schema["rank"].dataType

    def shares(found: list[set[str]], owners: dict[str, list[int]], n: int) -> np.ndarray:
        cells = [i * n + q for i, tokens in enumerate(found) for t in tokens if t in owners for q in owners[t]]
        return np.bincount(np.array(cells, np.int64), minlength=len(found) * n).reshape(len(found), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, lengths, lows, counts, (cjk, technical), names = sent.value
        n = len(lows)
        best: list[list[tuple]] = [[] for _ in range(n)]
        step = max(1, CELLS // max(n, 1))
        for batch in batches:
            for at in range(0, batch.num_rows if n else 0, step):
                ranks, titles, texts, kana, noisy = batch.slice(at, step).columns
                titles, texts = titles.to_pylist(), texts.to_pylist()
                by_title, by_text = (shares([_relevance_tokens(t) for t in x], owners, n) for x in (titles, texts))
                whole = np.zeros((len(texts), n))
                for i, t in enumerate(texts):
                    for q in range(empty, bisect_right(lengths, len(t))):
                        if lows[q] in t:
                            whole[i, q] = 0.2
                least = np.maximum(counts, 1)
                score = by_title / least * 0.65 + by_text / least * 0.35 + whole
                score = score * np.where(np.outer(kana.to_numpy(zero_copy_only=False), cjk), 0.45, 1.0) * np.where(np.outer(noisy.to_numpy(zero_copy_only=False), technical), 0.5, 1.0)
                score[:, counts == 0] = 0.0
                some = score > 0
                score[some] = _rounded(score[some])
                if top is None:
                    who = np.tile(np.arange(n), len(texts))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), ranks.take(pa.array(np.repeat(np.arange(len(texts)), n))), pa.array(score.ravel())], names=["query_id", "rank", "score"])
                    continue
                keys = ranks.to_pylist()
                docs, who = np.nonzero(score >= floor)
                for d, q, v in zip(docs.tolist(), who.tolist(), score[docs, who].tolist()):
                    best[q].append((-v, keys[d]))
                    if len(best[q]) > 8 * top:
                        best[q] = sorted(best[q])[:top]
        rows = [(q, *r) for q, found in enumerate(best) for r in sorted(found)[: top or 0]]
        yield pa.RecordBatch.from_arrays([names.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[2] for r in rows], to_arrow_type(kind)), pa.array([-r[1] for r in rows], pa.float64())], names=["query_id", "rank", "score"])

    fields = F.lower(F.coalesce("title", F.lit(""))).alias("low"), F.lower(_told()).alias("text"), _told().rlike(KANA).alias("kana"), _noisy().alias("noisy")
    return results.select("rank", *fields).mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank {kind.simpleString()}, score double")


def distinct_results(results: DataFrame) -> DataFrame:
    """Web results (query_id, rank, title, url, snippet) trimmed, without those that have neither title nor URL, the first of equal ones (case ignored)."""
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    rows = results.withColumns({c: trim(c) for c in ("title", "url", "snippet")}).where("title <> '' or url <> ''")
    first = Window.partitionBy("query_id", F.lower("title"), F.lower("url")).orderBy("rank")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def unblocked(results: DataFrame, blocked: DataFrame) -> DataFrame:
    """The results whose host is neither a blocked domain (b) nor below one.

    A host is looked up by each of its ends at a dot, an equality, so that any number of domains may be blocked.
    """
    parts = F.split(T.domain(F.coalesce("url", F.lit(""))), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rows = results.withColumn("__row", F.struct("query_id", "rank", "url"))
    out = rows.select("__row", F.explode(ends).alias("__end")).join(blocked.select(F.col("b").alias("__end")).where("__end <> ''").distinct(), "__end").select("__row").distinct()
    return rows.join(out, "__row", "left_anti").drop("__row")


def web_results(queries: DataFrame, results: DataFrame, blocked: DataFrame | None = None, top: int = 5) -> DataFrame:
    """What is left of (query_id, rank, title, url, snippet) for (query_id, query): distinct, not blocked (b), relevant enough, best first."""
    rows = distinct_results(results)
    if blocked is not None:
        rows = unblocked(rows, blocked)
    scored = adaptive_filter(lexical_relevance(rows.join(queries, "query_id")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def shared_web_results(queries: DataFrame, results: DataFrame, blocked: DataFrame | None = None, top: int = 5) -> DataFrame:
    """``web_results`` where all queries have the same results (rank, title, url, snippet), ranks told apart: these are cleaned once for all of them."""
    rows = distinct_results(results.withColumn("query_id", F.lit(0)))
    if blocked is not None:
        rows = unblocked(rows, blocked)
    rows = cut(rows.drop("query_id"), "results")
    best = relevance_to_all(queries, rows, top)
    if best is None:
        best = lexical_relevance(rows.crossJoin(queries)).select("query_id", "rank", "score")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    placed = adaptive_filter(best).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return placed.join(rows, "rank").join(queries, "query_id")


def cosine(a: Column, b: Column) -> Column:
    """To nine places; 0 where a vector has no length."""
    size = F.sqrt(T.dot(a, a)) * F.sqrt(T.dot(b, b))
    return F.round(F.when(size == 0, 0.0).otherwise(T.dot(a, b) / F.nullif(size, F.lit(0.0))), 9)


def first_alike(rows: DataFrame, queries: DataFrame, most: int, by: str = "label") -> DataFrame:
    """(query_id, vec_id, cos, place): for each query (query_id, vector, by) the first ``most`` other rows (vec_id, embedding, by) of its group, and their cosines.

    A group's first ``most`` + 1 ids are enough for all of its queries, and no more is joined.
    """
    ids = Window.partitionBy(by).orderBy("vec_id")
    some = rows.where(F.col(by).isNotNull()).select("vec_id", "embedding", by).withColumn("nth", F.dense_rank().over(ids)).where(F.col("nth") <= most + 1)
    some = some.withColumn("copy", F.row_number().over(Window.partitionBy(by, "vec_id").orderBy("embedding"))).where(F.col("copy") <= most)
    held = some.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("some"))
    others = F.slice(F.filter("some", lambda x: x["vec_id"] != F.col("query_id")), 1, most)
    near = queries.join(held, by).select("query_id", "vector", F.explode(others).alias("r")).select("query_id", "r.vec_id", cosine(F.col("vector"), F.col("r.embedding")).alias("cos"))
    return near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id"))).where(F.col("place") <= most)


def semantic_rerank(results: DataFrame, top: int = 5, least: float = 0.2, none: float = 0.05, share: float = 0.5) -> DataFrame:
    """(query_id, place, ...) of (query_id, place, vector, embedding, ...), or of ``cos`` in place of the vectors: by cosine, those of at least ``least`` and half the best.

    A query whose best is under ``none``, or with a single result, keeps its order; the best stays in any case.
    """
    every = Window.partitionBy("query_id")
    cos = F.col("cos") if "cos" in results.columns else cosine(F.col("vector"), F.col("embedding"))
    rows = results.withColumn("cos", cos).withColumns({"best": F.max("cos").over(every), "n": F.count("*").over(every)})
    as_is = (F.col("n") == 1) | (F.col("best") < none)
    order = every.orderBy(F.when(as_is, F.lit(0.0)).otherwise(-F.col("cos")), "place")
    ranked = rows.withColumn("new", F.row_number().over(order))
    kept = ranked.where(as_is | (F.col("new") == 1) | (F.col("cos") >= F.greatest(F.lit(least), share * F.col("best"))))
    return kept.where(F.col("new") <= top).withColumn("place", F.col("new")).drop("cos", "best", "n", "new")


def formatted_results(ranked: DataFrame, most: int = 400) -> DataFrame:
    """(query_id, context): numbered titles with their URLs, and snippets below, cut at ``most`` characters."""
    cut = F.when(F.length("snippet") > most, F.concat(F.substring("snippet", 1, most), F.lit("…"))).otherwise(F.nullif("snippet", F.lit("")))
    head = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "title", F.when(F.col("url") != "", F.concat(F.lit(" - "), "url")).otherwise(""))
    entry = F.concat_ws("\n", head, cut)
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))).alias("e")).select("query_id", F.array_join("e.entry", "\n\n").alias("context"))
