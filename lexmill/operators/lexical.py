"""Lexical retrieval: postings, document frequencies and BM25 over many documents and queries at once."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.ranking import candidates, counted
from lexmill.operators.rows import per_row
from lexmill.stage import cut

K1, B = 1.5, 0.75
#: Most distinct terms of the queries that are sent to all executors (about 100 bytes each); beyond it a shuffle joins them.
MOST_TERMS = 200_000


def document_frequency(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, cf): documents that hold a term, and its occurrences.  Each row is one document; partial sums of tasks are shuffled by term."""
    return counted(corpus, text)


def term_hits(queries: DataFrame, corpus: DataFrame, query_key: str = "item_id", key: str = "doc_id", within: str | None = None, toks: str | None = None) -> DataFrame:
    """(query, document, terms, score): of all pairs that share a term how many they share, and their BM25 score.

    Query terms count as often as they occur.  The corpus is tokenised once, where every row keeps just its terms that some
    query has, and counted once for the mean length.  With ``within`` a query only meets the documents of its own group of that name, whose
    statistics alone count.
    """
    group = [within] if within else []
    asked = queries.select(query_key, *group, F.explode(T.tokens(F.col("text"))).alias("term")).groupBy(query_key, *group, "term").agg(F.count("*").alias("qf"))
    terms = asked.select("term").distinct()
    # counted up to the bound only, so that a large table of queries is not scanned for it
    terms = F.broadcast(terms) if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS else terms
    rows = corpus.select(key, *group, (F.col(toks) if toks else T.tokens(F.col("text"))).alias("toks")).select(key, *group, "toks", F.size("toks").alias("dl"))
    counted = corpus.select(*group, (F.size(toks) if toks else T.token_count(F.col("text"))).alias("dl"))
    stats = counted.groupBy(*group).agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    tf = rows.select(key, *group, "dl", F.explode("toks").alias("term")).join(terms, "term", "left_semi").groupBy("term", key, *group, "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term", *group).agg(F.count("*").alias("df"))
    hits = tf.join(df, ["term", *group]).join(asked, ["term", *group])
    hits = hits.join(stats, within) if within else hits.join(F.broadcast(stats))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(query_key, key).agg(F.count("*").alias("terms"), F.sum(F.col("qf") * idf * gain).alias("score"))


def bm25_scores(queries: DataFrame, corpus: DataFrame, query_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query, document, score) of all pairs that share a term."""
    return term_hits(queries, corpus, query_key, key).drop("terms")


def containing(passages: DataFrame, corpus: DataFrame, query_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query, document) where the passage (query_key, passage) stands in the text as it is.

    A passage's inner tokens are whole tokens of every text that holds it, so texts are first found by the rarest of
    these, an equi-join, and only then searched.  Passages of fewer than three tokens meet every text.
    """
    toks = T.tokens(F.col("passage"))
    asked = passages.select(query_key, F.array_distinct(F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0)))).alias("inner"))
    terms = asked.select(query_key, F.explode("inner").alias("term"))
    held = corpus.select(key, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rarest = terms.join(df, "term", "left").groupBy(query_key).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))["term"].alias("term"))
    near = held.join(rarest, "term").select(query_key, key)
    found = corpus.select(key, "text").join(near, key).join(passages.select(query_key, "passage"), query_key).where(F.contains("text", "passage"))
    short = passages.join(asked.where(F.size("inner") == 0).select(query_key), query_key).select(query_key, "passage")
    rest = corpus.select(key, "text").join(short, F.contains("text", "passage"))
    return found.select(query_key, key).unionByName(rest.select(query_key, key))


def top_k(scores: DataFrame, k: int, by: list[str], order: list, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order."""
    return scores.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, query_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """Each query's ``k`` best documents of positive score, rounded to six places, ties to the smaller key."""
    found = candidates(queries, corpus, k, query_key, key)
    scores = bm25_scores(queries, corpus, query_key, key) if found is None else found.select(query_key, key, F.col("value").alias("score"))
    return top_k(scores.withColumn("score", F.round("score", 6)).where("score > 0"), k, [query_key], [F.col("score").desc(), key])


def bm25_and_overlap(queries: DataFrame, corpus: DataFrame, k: int, query_key: str = "item_id", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Each query's ``k`` best documents by BM25, and by the number of terms that they share, from one pass; ties to the smaller key."""
    found = candidates(queries, corpus, k, query_key, key, True)
    if found is None:
        pairs = cut(term_hits(queries, corpus, query_key, key), "pairs")
        bm, shared = pairs.select(query_key, key, "score"), pairs.select(query_key, key, F.col("terms").alias("shared"))
    else:
        found = cut(found, "candidates")
        bm = found.where("kind = 0").select(query_key, key, F.col("value").alias("score"))
        shared = found.where("kind = 1").select(query_key, key, F.col("value").cast("long").alias("shared"))
    best = top_k(bm.withColumn("score", F.round("score", 6)).where("score > 0"), k, [query_key], [F.col("score").desc(), key])
    return best, top_k(shared, k, [query_key], [F.col("shared").desc(), key])


def positions(low: Column, term: str) -> Column:
    """1-based starts of a literal in a text, overlapping ones too, in one pass.

    Cutting before every occurrence leaves pieces whose running lengths are the starts.
    """
    pieces = F.split(low, "(?=" + re.escape(term) + ")")
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p)))
    inner = F.transform(F.slice(ends, 2, F.greatest(F.size(ends) - 2, F.lit(0))), lambda n: n + 1)
    return F.when(F.startswith(low, F.lit(term)), F.concat(F.array(F.lit(1)), inner)).otherwise(inner)


#: Characters that end a sentence, to which contexts are widened.
STOPS = "。\n.！？!?；;"


def widened(text: str, start: int, stop: int, most: int = 100) -> tuple[int, int]:
    """A span moved back to just after the last stop, and on to just after the next one, within ``most`` characters."""
    back = next((i + 1 for i in range(start, max(0, start - most), -1) if i < len(text) and text[i] in STOPS), start)
    on = next((i + 1 for i in range(stop, min(len(text), stop + most)) if text[i] in STOPS), stop)
    return back, on


def grep_hits(text: str, literals: list[str], context: int, limit: int) -> list[tuple[str, int, str]]:
    """(match, offset, context) of up to ``limit`` hits; one nearer than ``context // 4`` to the one taken before is passed over."""
    out: list[tuple[str, int, str]] = []
    last = -1 << 62
    for m in re.finditer("|".join(map(re.escape, literals)), text, re.IGNORECASE):
        if len(out) == limit:
            break
        if m.start() - last >= context // 4:
            last = m.start()
            a, b = widened(text, max(0, m.start() - context), min(len(text), m.end() + context))
            out.append((m.group(), last, text[a:b]))
    return out


def grep(corpus: DataFrame, pattern: str, context: int = 2000, limit: int = 20, key: str = "doc_id") -> DataFrame:
    """(key, hit, match, offset, context): literal search, ``|`` between alternatives, letter case ignored.

    Contexts reach ``context`` characters to either side and on to the nearest stop.  Only documents that hold a
    literal go to Python.
    """
    literals = [p.strip() for p in pattern.split("|") if p.strip()]
    found = corpus.where(T.contains_any(F.lower("text"), [p.lower() for p in literals]) if literals else F.lit(False))
    return per_row(found, [key], ["text"], "match string, offset long, context string", lambda t: grep_hits(t, literals, context, limit), "hit")


def regex_hits(corpus: DataFrame, pattern: str, limit: int = 20, context: int = 200, key: str = "doc_id") -> DataFrame:
    """(key, hit, match, offset, context): the first ``limit`` non-empty matches, letter case ignored, ^ and $ at every line.  A bad pattern is an error at once."""
    compiled = re.compile(pattern, re.IGNORECASE | re.MULTILINE)

    def make(text: str) -> Iterator[tuple[str, int, str]]:
        matches = (m for m in compiled.finditer(text) if m.end() > m.start())
        return ((m.group(), m.start(), text[max(0, m.start() - context) : m.end() + context]) for m in islice(matches, limit))

    return per_row(corpus, [key], ["text"], "match string, offset long, context string", make, "hit")


def parse_boolean(query: str) -> tuple[list[str], list[str], list[str]]:
    """Must, should and must-not terms; an upper-case AND, OR or NOT says how what follows up to the next one counts, AND otherwise."""
    terms: dict[str, list[str]] = {"AND": [], "OR": [], "NOT": []}
    mode = "AND"
    for part in re.split(r"\b(AND|OR|NOT)\b", query):
        part = part.strip()
        if part in terms:
            mode = part
        elif part:
            terms[mode].append(part)
            mode = "AND"
    return terms["AND"], terms["OR"], terms["NOT"]


def _nearest(places: list[int], at: int, window: int) -> int | None:
    """The place nearest to ``at`` within the window, the first of equals; places ascend."""
    i = bisect_left(places, at)
    near = [p for p in places[max(i - 1, 0) : i + 1] if abs(p - at) <= window]
    return min(near, key=lambda p: (abs(p - at), p), default=None)


def boolean_hits(text: str, must: list[str], should: list[str], excluded: list[str], window: int, limit: int, context: int) -> list[tuple[str, int, str, float]]:
    """(match, offset, context, score) of the anchors that all terms allow, best first."""
    low = text.lower()
    places: dict[str, list[int]] = {}
    for term in {*must, *should, *excluded}:
        literal = term.lower()
        places[term] = [m.start() for m in re.finditer(f"(?={re.escape(literal)})", low)]
    (anchor, *rest), extra = (must, should) if must else (should[:1], should[1:])
    found: dict[tuple[int, int], float] = {}
    for at in places[anchor]:
        spans, score = [(at, at + len(anchor))], 1.0
        for terms, gain in ((rest, 1.0), (extra, 0.5)):
            for term in terms:
                p = _nearest(places[term], at, window)
                if p is not None:
                    spans.append((p, p + len(term)))
                    score += gain
                elif gain == 1.0:
                    score = 0.0
                    break
            if not score:
                break
        if score and all(_nearest(places[x], at, window) is None for x in excluded):
            found.setdefault((min(a for a, _ in spans), max(b for _, b in spans)), score)
    best = sorted(found.items(), key=lambda f: -f[1])[:limit]
    return [(text[a:b], a, text[max(0, a - context) : b + context], score) for (a, b), score in best]


def boolean_search(corpus: DataFrame, query: str, window: int = 500, limit: int = 20, context: int = 200, key: str = "doc_id") -> DataFrame:
    """(key, hit, match, offset, context, score): places where all must terms stand within ``window`` characters of the first and no excluded one does.

    Without a must term the first should term is the anchor.  The score is 1 for the anchor, 1 for each further
    must term and a half for each should term in reach; equal spans count once, by the first anchor.
    """
    must, should, excluded = parse_boolean(query)
    some = corpus if must or should else corpus.limit(0)
    for term in must or should[:1]:
        some = some.where(F.lower("text").contains(term.lower()))
    return per_row(some, [key], ["text"], "match string, offset long, context string, score double", lambda t: boolean_hits(t, must, should, excluded, window, limit, context), "hit")


def highlighted(text: str, query: str, window: int = 100) -> tuple[str, list[dict]]:
    """A snippet around the first place where the query stands, or else the first of its words, and what to highlight in it."""
    text = " ".join(text.split())
    low, query = text.lower(), query.lower().strip()
    find = lambda term: [(m.start(), m.end()) for m in re.finditer(re.escape(term), low)]
    spans = find(query) if query else []
    if not spans:
        spans = sorted((s for t in re.split(r"[\s,;，。；、]+", query) if t for s in find(t)), key=lambda s: s[0])
    a, b = (max(0, spans[0][0] - window), min(len(text), spans[0][1] + window)) if spans else (0, min(len(text), 2 * window))
    return text[a:b], [{"start": max(x, a) - a, "end": min(y, b) - a, "text": text[x:y]} for x, y in spans if y > a and x < b]


def snippets(hits: DataFrame, keys: list[str], window: int = 100) -> DataFrame:
    """``keys`` of (keys, query, text) with snippet and highlights array<struct<start, end, text>>, by white space squeezed text."""
    return per_row(hits, keys, ["text", "query"], "snippet string, highlights array<struct<start:int,end:int,text:string>>", lambda t, q: [highlighted(t, q, window)])


def nearest_position(corpus: DataFrame, anchor: str, term: str, window: int = 500, key: str = "doc_id") -> DataFrame:
    """For the first occurrence of ``anchor`` the nearest one of ``term`` within the window, the first of equals."""
    low = F.lower(F.col("text"))
    at = F.locate(anchor, low)
    places = positions(low, term)
    near = F.array_sort(F.transform(F.filter(places, lambda p: F.abs(p - at) <= window), lambda p: F.struct(F.abs(p - at).alias("far"), p.alias("at"))))
    rows = corpus.where(low.contains(anchor) & low.contains(term)).select(key, (at - 1).alias("anchor_at"), F.get(near, F.lit(0)).alias("best"))
    return rows.where("best is not null").select(key, "anchor_at", (F.col("best.at") - 1).alias("term_at"))
