"""Queries from hits to contexts and citations, over layouts, glossaries and prompts, each with its DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import models as O
from lexmill.functions import text as T
from lexmill.operators import chunking as K
from lexmill.operators import context as X
from lexmill.operators import glossary as H
from lexmill.operators import groups as G
from lexmill.operators import layout as Y
from lexmill.operators import lexical as L
from lexmill.operators import prompts as P
from lexmill.operators import retrieval as R
from lexmill.operators import vector as V
from lexmill.plans.memory_queries import hashed_embedding
from lexmill.plans.retrieval_queries import CHUNKS, chunks
from lexmill.plans.retrieval_queries import hits as ranked_hits
from lexmill.plans.text_queries import Q as TEXT
from lexmill.sources import tables as S
from lexmill.sources.tables import table
from lexmill.stage import cut

C = F.col
Q: dict = {}


def add(name, sql):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


#: Passages as queries, within the document that each finds first.
PARAMS = R.Settings(top=5)


def corpus(s, d):
    """Chunks of the documents with a page each and stand-ins for embeddings."""
    return chunks(s, d).withColumn("embedding", hashed_embedding(C("chunk")))


def questions(s, d):
    first = L.bm25_topk(table(s, d, "benchmark").select("item_id", "text"), table(s, d, "documents").select("doc_id", "text"), 1)
    q = first.join(table(s, d, "benchmark").select("item_id", C("text").alias("query")), "item_id")
    return q.select(C("item_id").alias("query_id"), "doc_id", "query", F.lit(None).cast("string").alias("selected"), hashed_embedding(C("query")).alias("vector"))


def groups(s, d):
    g = G.digests(G.aggregate_chunks(chunks(s, d))).withColumn("keywords", F.array(F.lit("word")))
    return g.withColumn("embedding", hashed_embedding(C("digest")))


@add("retrieve", None)
def _(s, d):
    found = R.retrieve(questions(s, d), corpus(s, d), cut(groups(s, d), "groups"), PARAMS)
    return found.select("query_id", "doc_id", F.md5("chunk").alias("chunk"), F.round("similarity", 6).alias("similarity"), "rank", "page", "table_augmented", F.md5("expanded").alias("expanded"), F.md5("snippet").alias("snippet"), F.size("highlights").alias("highlights"))


@add("retrieve_reranked", None)
def _(s, d):
    scored = lambda h: h.withColumn("score", F.round(T.char_jaccard(F.lower("query"), F.lower("chunk")), 6))
    return R.retrieve(questions(s, d), corpus(s, d), None, R.Settings(top=5, rerank=scored)).select("query_id", "doc_id", F.md5("chunk").alias("chunk"), F.round("similarity", 6).alias("similarity"), "rank")


@add("relevant_context", None)
def _(s, d):
    q, c, g = cut(questions(s, d), "questions"), cut(corpus(s, d), "corpus"), cut(groups(s, d), "groups")
    made, trace = R.contexts(R.retrieve(q, c, g, PARAMS), q, c, g, 2000)
    return made.join(trace, "query_id").select("query_id", F.md5("context").alias("context"), F.size("citations").alias("n"), "granularities", "token_used", "fallback")


@add("plain_context", f"""SELECT item_id AS query_id, md5(string_agg(text, chr(10) || chr(10) || '...' || chr(10) || chr(10) ORDER BY rank) || CASE WHEN max(s) < 0.6 THEN '{X.LOW_RELEVANCE.replace(chr(10), "' || chr(10) || '")}' ELSE '' END) AS context, max(s) < 0.6 AS low_relevance FROM (SELECT *, 1 / (1 + exp(-score / 50)) AS s FROM ({TEXT['bm25_topk'][1]}) JOIN documents USING (doc_id)) GROUP BY item_id""")
def _(s, d):
    return X.plain_context(ranked_hits(s, d), 0.6).withColumn("context", F.md5("context"))


@add("build_context", f"""SELECT item_id AS query_id, md5(string_agg('[' || ref || ']【' || source || ' - digest | 页码: ' || rank || '-' || rank + 1 || '】' || chr(10) || CASE WHEN rank % 2 = 0 THEN '关键词: ' || lang || ', x' || chr(10) ELSE '' END || '内容:' || chr(10) || substr(text, 1, 100), chr(10) || chr(10) ORDER BY ref)) AS context FROM (
SELECT *, CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE count(*) OVER (PARTITION BY item_id) - 1 - (rank - 2) // 2 END + 1 AS ref FROM ({TEXT['bm25_topk'][1]}) JOIN documents USING (doc_id)) GROUP BY item_id""")
def _(s, d):
    h = ranked_hits(s, d).join(table(s, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    keywords = F.when(C("rank") % 2 == 0, F.array("lang", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = h.select("query_id", (C("rank") - 1).alias("rank"), C("source").alias("group_id"), F.lit("digest").alias("granularity"), C("rank").alias("page_start"), (C("rank") + 1).alias("page_end"), keywords.alias("keywords"), F.substring("chunk", 1, 100).alias("text"), F.lit("").alias("highlight"))
    return X.build_context(rows, True).select("query_id", F.md5("context").alias("context"))


@add("relevant_snippets", None)
def _(s, d):
    h = ranked_hits(s, d).select("query_id", "doc_id", "query", C("chunk").alias("text"))
    return X.relevant_snippets(h, ["query_id", "doc_id"]).withColumn("snippet", F.md5("snippet"))


@add("snippets", None)
def _(s, d):
    h = ranked_hits(s, d).select("query_id", "doc_id", F.substring("query", 1, 24).alias("query"), C("chunk").alias("text"))
    return L.snippets(h, ["query_id", "doc_id"]).select("query_id", "doc_id", F.md5("snippet").alias("snippet"), F.size("highlights").alias("highlights"))


#: Replies with two cited passages, taken from the document of the same number as the conversation.
def replies(s, d):
    t = table(s, d, "conversations").join(table(s, d, "documents").select(C("doc_id").alias("conv_id"), C("text").alias("source")), "conv_id")
    body = F.concat(F.lit("CITATION LIST\n\nCITATION【1】\nSTART_PHRASE: "), F.substring("source", 11, 30), F.lit("\nEND_PHRASE: "), F.substring("source", 101, 30), F.lit("\ncitation[7]\nstart_phrase: nowhere at all\n\nFINAL ANSWER\n  "), "text", F.lit("\nCITATION LIST again"))
    return t.select((C("conv_id") * 100 + C("turn")).alias("answer_id"), "source", F.when(C("turn") % 3 == 2, C("text")).otherwise(body).alias("text"))


REPLIES = "SELECT conv_id * 100 + turn AS answer_id, d.text AS source, c.text AS answer, turn FROM conversations c JOIN documents d ON d.doc_id = c.conv_id"


def _line(x: str) -> str:
    return f"trim(string_split({x}, chr(10))[1])"


@add("citation_list", None)
def _(s, d):
    return X.citation_list(replies(s, d))


@add("final_answer", f"SELECT answer_id, md5(CASE WHEN turn % 3 = 2 THEN answer ELSE regexp_replace(regexp_replace(answer, '^\\s+', ''), '\\s+$', '') END) AS answer FROM ({REPLIES})")
def _(s, d):
    return replies(s, d).select("answer_id", F.md5(X.final_answer(C("text"))).alias("answer"))


@add("match_citations", None)
def _(s, d):
    r = replies(s, d)
    seg = r.select("answer_id", F.lit(1).alias("ref"), C("source").alias("text"), F.lit(3).alias("page"), F.lit("g").alias("group_id"))
    more = r.select("answer_id", F.lit(0).alias("chunk_idx"), F.reverse("source").alias("text"), F.lit(9).alias("page"), F.lit("c").alias("group_id"))
    return X.match_citations(X.citation_list(r), seg, more).select("answer_id", "place", "ref", F.md5("highlight").alias("highlight"), "page", "group_id")


SELECTIONS = "SELECT doc_id AS selection_id, doc_id, CASE doc_id % 4 WHEN 0 THEN substr(text, 950, 60) WHEN 1 THEN substr(text, 100, 90) || ' not there' WHEN 2 THEN ' ' ELSE 'nowhere to be found' END AS selected FROM documents"


@add("locate_selection", f"""WITH p AS ({CHUNKS}), a AS ({SELECTIONS}) SELECT selection_id, CASE WHEN trim(selected) = '' THEN 1 ELSE coalesce((SELECT min(chunk_idx) FROM p WHERE p.doc_id = a.doc_id AND contains(chunk, selected)), (SELECT min(chunk_idx) FROM p WHERE p.doc_id = a.doc_id AND contains(chunk, substr(selected, 1, 80))), 1) END::INTEGER AS page_start,
CASE WHEN trim(selected) = '' THEN 1 ELSE coalesce((SELECT max(chunk_idx) FROM p WHERE p.doc_id = a.doc_id AND contains(chunk, selected)), (SELECT max(chunk_idx) FROM p WHERE p.doc_id = a.doc_id AND contains(chunk, substr(selected, 1, 80))), 1) END::INTEGER AS page_end FROM a""")
def _(s, d):
    pages = chunks(s, d).select("doc_id", C("chunk_idx").alias("page"), C("chunk").alias("content"))
    k = C("doc_id") % 4
    text = F.when(k == 0, F.substring("text", 950, 60)).when(k == 1, F.concat(F.substring("text", 100, 90), F.lit(" not there"))).when(k == 2, " ").otherwise("nowhere to be found")
    return X.locate_selection(table(s, d, "documents").select(C("doc_id").alias("selection_id"), "doc_id", text.alias("selected")), pages)


@add("selected_context", """SELECT conv_id, turn, md5(text || chr(10) || chr(10) || '[1]用户选中的文本' || CASE WHEN turn % 3 = 0 THEN '（页码: 4）' ELSE '（页码: 4-' || 4 + turn % 3 || '）' END || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || chr(10) || '相关文档片段：' || chr(10) || chr(10) || role ELSE '' END) AS context, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 30 THEN md5(regexp_replace(substr(text, 1, 200), '^\\s+|\\s+$', '', 'g')) END AS citation FROM conversations""")
def _(s, d):
    first, last = F.lit(4), 4 + (C("turn") % 3)
    made = X.selected_block(C("text"), F.when(C("turn") % 2 == 0, C("role")), first, last, 1)
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(made).alias("context"), F.md5(X.selected_citation(C("text"), first, last)["highlight"]).alias("citation"))


TERMS = [("the", "le", False, True), ("ING", "ant", False, False), ("Thing", "chose", True, True), ("of the", "du", False, True), ("hidden", "caché", False, True)]


def glossary(s):
    return s.createDataFrame([(*t, t[0] != "hidden") for t in TERMS], "term string, translation string, case_sensitive boolean, whole_word boolean, enabled boolean")


def _found(term: str, case: bool, whole: bool) -> str:
    """Whether a text holds a term, with a word's edges where they are asked for."""
    edge = "[^\\p{L}\\p{N}_]"
    pattern = f"(^|{edge}){term}($|{edge})" if whole else term
    return f"regexp_matches(text, '{'' if case else '(?i)'}{pattern}')"


GLOSSED = "SELECT doc_id, term, translation FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term, '{x}' AS translation FROM documents WHERE {_found(t, c, w)}" for t, x, c, w in TERMS[:4]) + ")"


@add("glossary_matches", GLOSSED)
def _(s, d):
    return H.matches(table(s, d, "documents"), glossary(s)).select("doc_id", "term", "translation")


def _placed(term: str, case: bool, whole: bool) -> str:
    """Where a text first holds a term, from 0."""
    edge = "[^\\p{L}\\p{N}_]"
    before = f"(?:^|{edge})" if whole else ""
    after = f"(?:$|{edge})" if whole else ""
    shape = f"{'' if case else '(?i)'}^((?s:.*?){before}){term}{after}"
    return f"length(regexp_extract(text, '{shape}', 1))"


PLACED = "SELECT doc_id, term, translation, spot, case_ FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term, '{x}' AS translation, {_placed(t, c, w)} AS spot, {int(not c)} AS case_ FROM documents WHERE {_found(t, c, w)}" for t, x, c, w in TERMS[:4]) + ")"


@add("glossary_instruction", f"""SELECT doc_id, md5('{H.INSTRUCTION[0].replace(chr(10), "' || chr(10) || '")}' || string_agg('- ' || term || ' → ' || translation, chr(10) ORDER BY spot, case_, length(term)) || '{H.INSTRUCTION[1].replace(chr(10), "' || chr(10) || '")}') AS instruction FROM ({PLACED}) GROUP BY doc_id""")
def _(s, d):
    return H.instruction(H.matches(table(s, d, "documents"), glossary(s))).withColumn("instruction", F.md5("instruction"))


def uses(s, d):
    return table(s, d, "events").select(C("event_type").alias("prompt_id"), C("ts").cast("timestamp").alias("at"), "event_id", (C("value") >= 10).alias("success"), (C("value") / 100).alias("seconds"))


#: A prompt's health as a fold over its log.
HEALTH = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS p, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, ts, value >= 10 AS ok, value / 100 AS sec FROM events),
f(p, i, status, bad, out_at) AS (SELECT DISTINCT p, 0::BIGINT, 'healthy', 0, NULL::TIMESTAMP FROM e UNION ALL
 SELECT p, i, CASE WHEN ok THEN CASE WHEN st = 'degraded' THEN 'healthy' ELSE st END WHEN b + 1 >= 2 THEN 'deactivated' ELSE 'degraded' END, CASE WHEN ok THEN 0 ELSE b + 1 END, CASE WHEN NOT ok AND b + 1 >= 2 THEN ts ELSE out_at END
 FROM (SELECT e.p, e.i, e.ts, e.ok, f.out_at, CASE WHEN f.status = 'deactivated' AND e.ts - f.out_at >= INTERVAL 15 MINUTE THEN 'degraded' ELSE f.status END AS st, CASE WHEN f.status = 'deactivated' AND e.ts - f.out_at >= INTERVAL 15 MINUTE THEN 0 ELSE f.bad END AS b FROM f JOIN e ON e.p = f.p AND e.i = f.i + 1)),
l AS (SELECT p, max(i) AS i, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS failed, max(i) FILTER (ok AND sec > 0) AS last_ok FROM e GROUP BY p)
SELECT p AS prompt_id, status, i AS total_requests, good AS success_count, failed AS failure_count, f.bad::BIGINT AS consecutive_failures, round((SELECT avg(sec) FROM e WHERE e.p = l.p AND e.ok AND e.sec > 0 AND e.i <= l.last_ok AND e.i > l.last_ok - 20), 6) AS average_response_time FROM l JOIN f USING (p, i)"""


@add("prompt_states", HEALTH)
def _(s, d):
    return P.health(uses(s, d)).withColumn("average_response_time", F.round("average_response_time", 6))


@add("prompt_selection", """WITH u AS (SELECT user_id, event_type AS prompt_id, count(*) AS total, count(*) FILTER (value >= 30) AS good, min(event_id) AS place, user_id % 3 = 0 AND event_type > 'm' AS chosen, CASE WHEN sum(value) % 7 < 2 THEN 'deactivated' WHEN sum(value) % 7 < 4 THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY ALL),
k AS (SELECT *, max(chosen::INT) OVER (PARTITION BY user_id) AS any_ FROM u WHERE status <> 'deactivated')
SELECT user_id, prompt_id FROM k WHERE any_ = 0 OR chosen QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY status = 'healthy' DESC, CASE WHEN status = 'healthy' THEN good / total ELSE good END DESC, place) = 1""")
def _(s, d):
    # sums are made in the order of the events: which side of a bound a sum of floats falls on hangs on that
    e = P.running(table(s, d, "events"), "value", ["user_id", "event_type"], ["event_id", "ts", "value"])
    rest = F.max_by("sum", "nth") % 7
    u = e.groupBy("user_id", C("event_type").alias("prompt_id")).agg(F.count("*").alias("total_requests"), F.count_if(C("value") >= 30).alias("success_count"), F.min("event_id").alias("place"), F.when(rest < 2, "deactivated").when(rest < 4, "degraded").otherwise("healthy").alias("status"))
    return P.selected(u.withColumn("user_selected", (C("user_id") % 3 == 0) & (C("prompt_id") > "m")))


#: The boxes of a document's pages: forty words each, in two columns on even documents, three to a line.
def boxes(s, d):
    rows = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("n", "text"))
    rows = rows.select("doc_id", (F.floor(C("n") / 40).cast("int") + 1).alias("page"), (C("n") % 40).alias("item"), "text")
    i = C("item")
    left = F.when((C("doc_id") % 2 == 0) & (i >= 20), 320).otherwise(0)
    x0, y0 = (left + (i % 3) * 60.0).alias("x0"), (F.floor((i % 20) / 3) * 12.0 + (i % 3)).alias("y0")
    return rows.select("doc_id", "page", "item", "text", x0, y0).withColumns({"x1": C("x0") + F.when(C("item") % 5 == 0, 55.0).otherwise(30.0), "y1": C("y0") + 10.0})


BOXES = """SELECT doc_id, (n // 40 + 1)::INTEGER AS page, i AS item, w[n + 1] AS text, x0, x0 + CASE WHEN i % 5 = 0 THEN 55.0 ELSE 30.0 END AS x1, y0, y0 + 10.0 AS y1 FROM (SELECT *, CASE WHEN doc_id % 2 = 0 AND i >= 20 THEN 320 ELSE 0 END + (i % 3) * 60.0 AS x0, (i % 20) // 3 * 12.0 + i % 3 AS y0 FROM (
SELECT *, n % 40 AS i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS w FROM documents))))"""


@add("glyph_lines", f"""WITH g AS (SELECT *, round_even(y0 / 5, 0) * 5 AS line FROM ({BOXES}) WHERE text <> ''), b AS (SELECT *, lag(y0) OVER w AS py, lag(x1) OVER w AS px, row_number() OVER w AS n FROM g WINDOW w AS (PARTITION BY doc_id, page ORDER BY line, x0, item))
SELECT doc_id, page, md5(regexp_replace(string_agg(CASE WHEN py IS NULL THEN '' WHEN abs(y0 - py) > 5 THEN chr(10) WHEN x0 - px > CASE WHEN x1 > x0 THEN (x1 - x0) * 0.3 ELSE 3 END THEN ' ' ELSE '' END || text, '' ORDER BY n), '^\\s+|\\s+$', '', 'g')) AS text FROM b GROUP BY doc_id, page""")
def _(s, d):
    return Y.lines(boxes(s, d)).withColumn("text", F.md5("text"))


COLUMNS = f"""SELECT doc_id, page, before + gap * 0.1 AS left_end, x - gap * 0.1 AS right_start FROM (SELECT *, x - before AS gap FROM (SELECT doc_id, page, x, lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS before FROM (SELECT doc_id, page, unnest([x0, x1]) AS x FROM ({BOXES})))) WHERE gap > 60 AND abs((before + x) / 2 - 300) < 90 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY before) = 1"""


def widths(s, d):
    return boxes(s, d).select("doc_id", "page").distinct().withColumn("width", F.lit(600.0))


@add("page_columns", f"SELECT doc_id, page, round(left_end, 6)::DOUBLE AS left_end, round(right_start, 6)::DOUBLE AS right_start FROM ({COLUMNS})")
def _(s, d):
    return Y.columns(boxes(s, d), widths(s, d)).select("doc_id", "page", F.round("left_end", 6).alias("left_end"), F.round("right_start", 6).alias("right_start"))


@add("layout_thresholds", f"SELECT doc_id, page, median(y1 - y0)::DOUBLE AS line_height, (median(x1 - x0) / 10)::DOUBLE AS char_width, (median(x1 - x0) * 0.3)::DOUBLE AS column_gap, (median(y1 - y0) * 0.5)::DOUBLE AS line_tolerance FROM ({BOXES}) GROUP BY doc_id, page")
def _(s, d):
    return Y.thresholds(boxes(s, d))


@add("reading_order", f"""SELECT doc_id, page, item, (row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN left_end IS NULL OR (x0 + x1) / 2 <= left_end OR (x0 + x1) / 2 < right_start THEN 0 ELSE 1 END, round_even(y0 / 5, 0) * 5, x0, item))::INTEGER AS place FROM ({BOXES}) LEFT JOIN ({COLUMNS}) USING (doc_id, page)""")
def _(s, d):
    return Y.in_reading_order(boxes(s, d), widths(s, d)).select("doc_id", "page", "item", "place")


def drawn(s, d):
    """Captions and images of the pages that each document stands for."""
    docs = table(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"), C("text").alias("t"))
    lead = F.when(C("page") == 1, "Figure 3a ").when((C("page") == 2) & (C("doc_id") % 2 == 0), "图 7").when(C("page") == 3, "see Fig. 1 ").otherwise("  fig. 12: ")
    lines = docs.select("doc_id", "page", F.concat(lead, F.regexp_replace("t", "^[0-9a-zA-Z]+", "-")).alias("text"), (C("page") * 100.0).alias("y1"))
    images = docs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("doc_id", "page", F.concat_ws("-", "page", "k").alias("image_id"), (C("k") * 260.0 + C("doc_id") % 90).alias("y0"))
    return Y.captions(lines), images


FIGURES = """SELECT doc_id, page, CASE WHEN page = 1 THEN '3a' WHEN doc_id % 2 = 0 THEN '7' ELSE '12' END AS number, list_transform(list_filter(range(0, 3), lambda k: k * 260.0 + doc_id % 90 > page * 100 - 10 AND k * 260.0 + doc_id % 90 < page * 100 + 400), lambda k: page || '-' || k) AS ids FROM documents, (SELECT unnest([1, 2]) AS page)"""


@add("figure_images", f"SELECT doc_id, page, number, 'fig-' || number AS figure_id, array_to_string(ids, ',') AS images FROM ({FIGURES})")
def _(s, d):
    caps, images = drawn(s, d)
    return Y.figures(caps, images).select("doc_id", "page", "number", "figure_id", F.array_join("image_ids", ",").alias("images"))


@add("overview_figures", f"""WITH f AS (SELECT doc_id, 'fig-' || number AS figure_id, page, ids, row_number() OVER (PARTITION BY doc_id ORDER BY page, number) AS place FROM ({FIGURES}) WHERE doc_id % 3 > 0), k AS (SELECT * FROM f WHERE place <= 3 AND len(ids) > 0)
SELECT doc_id, place::INTEGER AS place, figure_id, page::INTEGER AS page, array_to_string(ids, ',') AS images FROM k UNION ALL SELECT doc_id, k + 1, '1-' || k, 1, '1-' || k FROM documents, (SELECT unnest([0, 1, 2])::INTEGER AS k) WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def _(s, d):
    caps, images = drawn(s, d)
    found = Y.figures(caps, images).where("doc_id % 3 > 0")
    return Y.overview_figures(found, images).select("doc_id", "place", "figure_id", "page", F.array_join("image_ids", ",").alias("images"))


@add("embedding_batches", None)
def _(s, d):
    return V.embedding_batches(table(s, d, "conversations").select("conv_id", "turn", "text"), 100, "conv_id", "turn").select("conv_id", "turn", "tokens", "batch")


@add("graph_new_chunks", "SELECT 'chunk-' || md5(text) AS id, min(doc_id) AS doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 5 = 0) GROUP BY 1")
def _(s, d):
    rows = table(s, d, "documents").select("doc_id", T.mdhash(C("text"), "chunk-").alias("id"))
    known = rows.where("doc_id % 5 = 0").select("id")
    return rows.join(known, "id", "left_anti").groupBy("id").agg(F.min("doc_id").alias("doc_id"))


@add("contextual_prefix", "SELECT doc_id, md5(CASE WHEN source <> 'src1' AND source IS NOT NULL THEN '[章节: ' || source || ']' || chr(10) || text ELSE text END) AS chunk FROM documents")
def _(s, d):
    heading = F.when(C("source") != "src1", C("source"))
    return table(s, d, "documents").select("doc_id", F.md5(K.with_heading(C("text"), heading)).alias("chunk"))


#: A text of two tables around a document's beginning: one with a title, one of two parts with a note between, one of two rows only.
def tabled(begin):
    return F.concat(F.lit("Table 1: x\n| a | b |\n|---|---|\n| 1 | 2 |\n"), begin, F.lit("\n| p |\n| q |\n\n| c | d | e |\n| 1 |\n| 3 | 4 | 5 | 6 |\n\n| f |\n| g |\n| h |"))


BEGIN = "replace(replace(substr(text, 1, 50), '|', '/'), chr(10), ' ')"


def begin():
    return F.translate(F.substring("text", 1, 50), "|\n", "/ ")


@add("protect_tables", f"SELECT doc_id, md5('__TABLE_PLACEHOLDER_1__' || chr(10) || {BEGIN} || chr(10) || '| p |' || chr(10) || '| q |' || chr(10) || chr(10) || '__TABLE_PLACEHOLDER_0__') AS text, true AS restored FROM documents")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", tabled(begin()).alias("text"))
    made = K.protect_tables(docs).join(docs.withColumnRenamed("text", "whole"), "doc_id")
    return made.select("doc_id", F.md5("text").alias("text"), (K.restored(C("text"), C("tables")) == C("whole")).alias("restored"))


@add("mended_tables", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 |  |' || chr(10) || '| 1 | ' || doc_id || ' |' WHEN 1 THEN '|a|b|' || chr(10) || '| --- | --- |' || chr(10) || '|x|y|' ELSE 'a | b' END AS fixed FROM documents")
def _(s, d):
    text = F.when(C("doc_id") % 3 == 0, F.concat(F.lit(" | a | b |\n| --- | --- |\n\n| 1 |\n| 1 | "), C("doc_id").cast("string"), F.lit(" | 3 |"))).when(C("doc_id") % 3 == 1, "|a|b|\n|one|\n|x|y|").otherwise("a | b")
    return table(s, d, "documents").select("doc_id", K.mended_table(text).alias("fixed"))


@add("glossary_has_any", f"SELECT DISTINCT doc_id FROM ({GLOSSED})")
def _(s, d):
    return H.holds_any(table(s, d, "documents"), glossary(s))


@add("dedup_by_prefix", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY doc_id) = 1")
def _(s, d):
    return table(s, d, "documents").groupBy(F.substring("text", 1, 100)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@add("key_pool", "SELECT n_nationkey AS k, array_to_string(list_filter(list_transform(string_split(' ' || n_name || ' ,, b' || n_nationkey || ', ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS keys FROM nation")
def _(s, d):
    pool = F.concat(F.lit(" "), "n_name", F.lit(" ,, b"), C("n_nationkey").cast("string"), F.lit(", "))
    return table(s, d, "nation").select(C("n_nationkey").alias("k"), F.array_join(O.key_pool(pool), "|").alias("keys"))


@add("supported_formats", "SELECT n_nationkey AS k, n_nationkey % 3 > 0 AS supported FROM nation")
def _(s, d):
    k = C("n_nationkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("dir.md/"), "n_name", F.lit(".pdf"))).when(k % 3 == 1, F.concat(F.lit("a/b."), "n_name", F.lit(".MD"))).otherwise("x.csv")
    return table(s, d, "nation").select(k.alias("k"), S.is_supported(name).alias("supported"))


@add("model_metadata", "SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'host' END AS base_url FROM nation")
def _(s, d):
    k = C("n_nationkey")
    return table(s, d, "nation").select(k.alias("k"), O.first_filled(F.when(k % 3 == 0, C("n_name")), F.lit("  "), F.when(k % 3 == 1, " host ")).alias("base_url"))


@add("model_fallback", """WITH a AS (SELECT c_custkey AS u, c_custkey % 7 AS k FROM customer), m AS (SELECT u, k, unnest(CASE WHEN k < 5 THEN ['gpt-x', 'Pro/BAAI/bge-m3', 'text-embedding-3-large', 'text-embedding-3-small', 'my-embed'] ELSE ['gpt-x', 'a-rerank', 'my-embed'] END) AS model FROM a)
SELECT u AS "user", CASE WHEN k >= 5 THEN 'my-embed' WHEN k = 0 THEN 'text-embedding-3-small' WHEN k = 1 THEN 'Pro/BAAI/bge-m3' ELSE 'text-embedding-3-small' END AS model FROM a""")
def _(s, d):
    c = table(s, d, "customer").select(C("c_custkey").alias("user"), (C("c_custkey") % 7).alias("k"))
    many, few = ["gpt-x", "Pro/BAAI/bge-m3", "text-embedding-3-large", "text-embedding-3-small", "my-embed"], ["gpt-x", "a-rerank", "my-embed"]
    models = F.when(C("k") < 5, F.array(*map(F.lit, many))).otherwise(F.array(*map(F.lit, few)))
    wanted = F.when(C("k") == 0, "text-embedding-ada-002").when(C("k") == 1, "baai/BGE-m3").otherwise("unknown")
    return O.fallback_model(c.select("user", F.posexplode(models).alias("place", "model")), c.select("user", wanted.alias("preferred")))


@add("group_store_version", "SELECT doc_id FROM documents WHERE doc_id % 3 = 2")
def _(s, d):
    return S.versioned(table(s, d, "documents").withColumn("schema_version", (C("doc_id") % 3).cast("int")), 2).select("doc_id")


@add("section_clamp", "SELECT doc_id, md5(substr(text, 1, 8000)) AS context FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.substring("text", 1, 8000)).alias("context"))


@add("task_states", "SELECT user_id, event_type, CASE WHEN min(value) < 5 THEN 'failed' WHEN max(rank) = 3 THEN 'completed' WHEN max(rank) = 2 THEN 'processing' ELSE 'pending' END AS status FROM (SELECT *, CASE WHEN value < 20 THEN 1 WHEN value < 60 THEN 2 ELSE 3 END AS rank FROM events) GROUP BY ALL")
def _(s, d):
    e = table(s, d, "events").withColumn("status", F.when(C("value") < 20, "pending").when(C("value") < 60, "processing").otherwise("completed"))
    return S.task_states(e.withColumn("failed", C("value") < 5), ["user_id", "event_type"])
