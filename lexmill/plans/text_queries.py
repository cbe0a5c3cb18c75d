"""Queries over single texts, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.latex import dollars
from lexmill.operators import fusion as U
from lexmill.operators import lexical as L
from lexmill.operators.rows import per_row
from lexmill.sources.tables import table

C = F.col
Q: dict = {}


def add(name: str, sql: str | None):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _places(term: str) -> str:
    """Starts of a literal that cannot overlap itself: running lengths of the pieces between."""
    return f"SELECT doc_id, sum(length(piece) + {len(term)}) OVER (PARTITION BY doc_id ORDER BY n) - {len(term)} + 1 AS i FROM (SELECT doc_id, unnest(list_slice(string_split(t, '{term}'), 1, -2)) AS piece, unnest(range(1, len(string_split(t, '{term}')))) AS n FROM p)"


TOKENS = "list_filter(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9]+'), lambda t: length(t) > 1)"
KIND = f"CASE WHEN {_any('lower(text)', T.OVERVIEW_WORDS)} THEN 'overview' WHEN {_any('lower(text)', T.ANALYTICAL_WORDS)} THEN 'analytical' WHEN {_any('lower(text)', T.EXTRACTION_WORDS)} THEN 'extraction' ELSE 'specific' END"


@add("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


@add("filter_project_docs", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
def _(s, d):
    return table(s, d, "documents").where("lang = 'en' and n_chars > 1000").select("doc_id", "n_chars")


@add("document_ids", "SELECT doc_id, md5(text) AS text_id, 'chunk-' || md5(text) AS chunk_id FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5("text").alias("text_id"), T.mdhash(C("text"), "chunk-").alias("chunk_id"))


@add("token_counts", f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_terms FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.tokens(C("text"))).alias("n_tokens"), F.size(F.array_distinct(T.tokens(C("text")))).alias("n_terms"))


@add("term_document_frequency", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def _(s, d):
    return L.document_frequency(table(s, d, "documents"))


@add("bm25_topk", f"""
WITH t AS (SELECT doc_id, {TOKENS} AS toks FROM documents), l AS (SELECT doc_id, len(toks) AS dl FROM t),
st AS (SELECT count(*) AS n, greatest(avg(dl), 1.0) AS avgdl FROM l),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term) JOIN l USING (doc_id), st GROUP BY ALL)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10""")
def _(s, d):
    return L.bm25_topk(table(s, d, "benchmark").select("item_id", "text"), table(s, d, "documents").select("doc_id", "text"))


@add("preprocess_text", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)),
  lambda x: NOT contains(lower(x), 'authorized licensed use limited to') AND NOT contains(lower(x), 'all rights reserved') AND regexp_matches(x, '\S')), chr(10)),
  '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS cleaned FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.preprocess(C("text"))).alias("cleaned"))


@add("clean_text", r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\x{FFFD}{2,}', '', 'g')) AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.length(T.clean_text(C("text"))).cast("long").alias("n"))


# The documents hold no damaged lines: two frequent letters are damaged, so that lines of either kind occur.
@add("garbage_lines", rf"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(translate(text, 'ea', chr(1) || chr(65533)), chr(10))) AS t FROM documents)
WHERE length(t) >= 2 AND NOT ({" OR ".join(f"regexp_matches(t, '{w}')" for w in T.WHITELIST)})
AND (len(regexp_extract_all(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) + len(regexp_extract_all(t, '[\x{{FFFD}}\x{{E000}}-\x{{F8FF}}]')) + len(regexp_extract_all(t, '\x00'))) / length(t) > 0.3 GROUP BY doc_id""")
def _(s, d):
    damaged = F.translate("text", "ea", "\x01\ufffd")
    lines = table(s, d, "documents").select("doc_id", F.explode(F.split(damaged, "\n")).alias("t"))
    return lines.where(T.is_garbage_line(C("t"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@add("detect_language", r"SELECT doc_id, CASE WHEN length(text) > 0 AND (length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) / length(text) > 0.1 THEN 'cjk' ELSE 'en' END AS kind FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.language(C("text")).alias("kind"))


SCORE = r"""greatest(0.0, least(100.0, 100.0 - 50 * (1.0 - (length(text) - length(regexp_replace(text, '[\p{L}\p{N} \t\n.,;:!?()\[\]{}"''-]', '', 'g'))) / length(text)) - CASE WHEN length(text) < 10 THEN 20 ELSE 0 END))"""


@add("page_quality", f"SELECT doc_id, round({SCORE}, 1) AS score, {SCORE} < 60 AS needs_ocr, CASE WHEN {SCORE} >= 80 THEN 'good' WHEN {SCORE} >= 60 THEN 'acceptable' ELSE 'poor_quality' END AS reason FROM documents")
def _(s, d):
    # the score is a column of its own first, so that it is made once
    rows = table(s, d, "documents").select("doc_id", T.page_score(C("text"), F.lit(1)).alias("s"))
    return rows.select("doc_id", F.round("s", 1).alias("score"), (C("s") < 60).alias("needs_ocr"), T.page_reason(C("s")).alias("reason"))


@add("quality_rollup", f"SELECT source, round(avg(s), 4) AS mean, CASE WHEN avg(s) >= 80 THEN 'good' WHEN avg(s) >= 60 THEN 'acceptable' ELSE 'poor' END AS verdict, count(*) FILTER (s < 60) AS n_ocr FROM (SELECT source, {SCORE} AS s FROM documents) GROUP BY source")
def _(s, d):
    rows = table(s, d, "documents").select("source", T.page_score(C("text"), F.lit(1)).alias("s")).groupBy("source").agg(F.avg("s").alias("m"), F.count_if(C("s") < 60).alias("n_ocr"))
    return rows.select("source", F.round("m", 4).alias("mean"), F.when(C("m") >= 80, "good").when(C("m") >= 60, "acceptable").otherwise("poor").alias("verdict"), "n_ocr")


@add("ocr_merge", "SELECT doc_id, CASE WHEN length(o) > 0.8 * length(text) THEN md5(o) ELSE md5(text) END AS kept FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, (length(text) // 2)::INT) ELSE text || '.' END AS o FROM documents)")
def _(s, d):
    n = F.floor(F.length("text") / 2).cast("int")
    docs = table(s, d, "documents").withColumn("o", F.when(C("doc_id") % 3 == 0, F.substring(C("text"), F.lit(1), n)).otherwise(F.concat("text", F.lit("."))))
    return docs.select("doc_id", F.when(F.length("o") > 0.8 * F.length("text"), F.md5("o")).otherwise(F.md5("text")).alias("kept"))


@add("table_flags", r"""
SELECT doc_id, len(l) >= 2 AND (length(text) - length(replace(text, '|', '')) >= 4 OR length(text) - length(replace(text, chr(9), '')) >= 4 OR (len(l) >= 3 AND len(list_filter(l, lambda x: len(regexp_extract_all(x, '[0-9]')) >= 3)) >= 0.5 * len(l))) AS likely_table
FROM (SELECT doc_id, text, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM documents)""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.is_likely_table(C("text")).alias("likely_table"))


@add("table_fragment_flags", r"""
SELECT doc_id, length(text) >= 20 AND len(w) >= 3 AND ((n / len(w) > 0.25 AND NOT long_) OR n / len(w) > 0.5) AS fragment FROM (
SELECT doc_id, text, w, len(list_filter(w, lambda t: regexp_matches(regexp_replace(t, '^[(),%↑↓·-]+|[(),%↑↓·-]+$', '', 'g'), '^-?[0-9]+\.?[0-9]*[a-zA-Z]?$'))) AS n,
  len(list_filter(regexp_split_to_array(text, '[.!?。！？]'), lambda x: length(trim(x)) > 30)) > 0 AS long_ FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM documents))""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.is_table_fragment(C("text")).alias("fragment"))


@add("reference_like_flags", r"""
SELECT doc_id, contains(low, 'references') OR contains(low, 'bibliography') OR contains(smp, '参考文献') OR
 (len(regexp_extract_all(smp, '\[[0-9]{1,3}\]')) >= 2)::INT + (y >= 2)::INT + (contains(low, 'et al') OR len(regexp_extract_all(smp, '\b[A-Z][a-z]+,\s*(?:[A-Z]\.|[A-Z][a-z]+)')) >= 2)::INT
 + regexp_matches(low, '\b(?:doi|arxiv)\b')::INT + (len(l) > 0 AND len(list_filter(l, lambda x: regexp_matches(x, '^\[?[0-9]{1,3}\]?[.)]?\s'))) / greatest(len(l), 1) >= 0.35 AND y >= 1)::INT >= 2 AS reference_like
FROM (SELECT doc_id, substr(text, 1, 1200) AS smp, lower(substr(text, 1, 1200)) AS low, len(regexp_extract_all(substr(text, 1, 1200), '\b(?:19|20)[0-9]{2}\b')) AS y, list_filter(list_transform(string_split(substr(text, 1, 1200), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.is_reference_like(C("text")).alias("reference_like"))


@add("query_type", f"SELECT conv_id, turn, kind, CASE kind WHEN 'overview' THEN 15 WHEN 'extraction' THEN 5 WHEN 'analytical' THEN 12 ELSE 10 END AS top_k, CASE kind WHEN 'extraction' THEN 0.35 WHEN 'overview' THEN 0.65 WHEN 'analytical' THEN 0.55 ELSE 0.5 END AS alpha FROM (SELECT conv_id, turn, {KIND} AS kind FROM conversations WHERE role = 'user')")
def _(s, d):
    rows = table(s, d, "conversations").where("role = 'user'").withColumn("kind", T.query_type(C("text")))
    return rows.select("conv_id", "turn", "kind", T.by_key(C("kind"), T.TOP_K, 10).alias("top_k"), T.by_key(C("kind"), T.ALPHA, 0.5).alias("alpha"))


@add("candidate_policy", f"SELECT item_id, kind, CASE kind WHEN 'extraction' THEN 50 WHEN 'overview' THEN 30 WHEN 'analytical' THEN 25 ELSE 20 END AS candidates, greatest(CASE kind WHEN 'extraction' THEN 50 WHEN 'overview' THEN 30 WHEN 'analytical' THEN 25 ELSE 20 END, 5 * CASE kind WHEN 'overview' THEN 15 WHEN 'extraction' THEN 5 WHEN 'analytical' THEN 12 ELSE 10 END) AS reranked FROM (SELECT item_id, {KIND} AS kind FROM benchmark)")
def _(s, d):
    rows = table(s, d, "benchmark").withColumn("kind", T.query_type(C("text")))
    n = T.by_key(C("kind"), T.CANDIDATES, 20)
    return rows.select("item_id", "kind", n.alias("candidates"), F.greatest(n, 5 * T.by_key(C("kind"), T.TOP_K, 10)).alias("reranked"))


@add("granularity", f"SELECT item_id, CASE kind WHEN 'overview' THEN 'summary' WHEN 'extraction' THEN 'full' ELSE 'digest' END AS granularity, CASE kind WHEN 'overview' THEN 10 WHEN 'extraction' THEN 3 ELSE 5 END AS groups FROM (SELECT item_id, {KIND} AS kind FROM benchmark)")
def _(s, d):
    rows = table(s, d, "benchmark").withColumn("kind", T.query_type(C("text")))
    return rows.select("item_id", T.by_key(C("kind"), {k: v[0] for k, v in T.GRANULARITY.items()}, "digest").alias("granularity"), T.by_key(C("kind"), {k: v[1] for k, v in T.GRANULARITY.items()}, 5).alias("groups"))


@add("reference_query", f"SELECT conv_id, turn, {_any('lower(text)', T.REFERENCE_WORDS)} AS about_references FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.is_reference_query(C("text")).alias("about_references"))


@add("token_estimate", r"SELECT doc_id, ceil((length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) / 1.5 + length(regexp_replace(text, '[一-鿿]', '', 'g')) / 4.0)::BIGINT AS n, floor(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 3.5 + (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) * 1.1)::BIGINT AS n_embedding FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.estimate_tokens(C("text")).alias("n"), T.estimate_embedding_tokens(C("text")).alias("n_embedding"))


TAGS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {_any('lower(text)', w)}" + (f" OR regexp_matches(text, '{T.FACT_PATTERN}')" if t == "fact" else "") + f" THEN '{t}' END" for t, w in T.TAG_WORDS.items()) + "], lambda x: x IS NOT NULL))"


@add("auto_tags", f"SELECT conv_id, turn, array_to_string({TAGS}, ',') AS tags FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(T.auto_tags(C("text")), ",").alias("tags"))


def _offsets(pattern: str) -> str:
    """doc_id, text, and of a pattern's matches the texts and the offsets: what lies between them adds up."""
    return f"""SELECT doc_id, text, m, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT) AS o
    FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM documents) WHERE len(m) > 0"""


def _snapped(context: int) -> str:
    """From (text, m, o): the context of a hit, widened to stops within 100 characters."""
    stops = "('。', chr(10), '.', '！', '？', '!', '?', '；', ';')"
    a, b = f"greatest(0, o - {context})", f"least(length(text), o + length(m) + {context})"
    back = f"coalesce(list_max(list_filter(range(greatest(0, {a} - 100) + 1, {a} + 1), lambda i: substr(text, i + 1, 1) IN {stops})) + 1, {a})"
    on = f"coalesce(list_min(list_filter(range({b}, least(length(text), {b} + 100)), lambda i: substr(text, i + 1, 1) IN {stops})) + 1, {b})"
    return f"substr(text, {back} + 1, {on} - {back})"


@add("grep_hits", f"""
WITH f AS ({_offsets('(?i)tion|ment')}),
k AS (SELECT doc_id, text, m, o, list_reduce(list_transform(o, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < 20 AND x[1] - acc[-1] >= 10 THEN list_concat(acc, x) ELSE acc END) AS kept FROM f)
SELECT doc_id, hit, m AS match, o AS "offset", md5({_snapped(40)}) AS context FROM (SELECT doc_id, text, unnest(range(0, len(kept)))::INTEGER AS hit, unnest(list_transform(kept, lambda x: m[list_position(o, x)])) AS m, unnest(kept) AS o FROM k)""")
def _(s, d):
    return L.grep(table(s, d, "documents"), "tion| ment |", 40).withColumn("context", F.md5("context"))


@add("regex_hits", f"""SELECT doc_id, hit, m AS match, o AS "offset", md5(substr(text, greatest(0, o - 200) + 1, o + length(m) + 200 - greatest(0, o - 200))) AS context
FROM (SELECT doc_id, text, unnest(range(0, least(20, len(m))))::INTEGER AS hit, unnest(m[1:20]) AS m, unnest(o[1:20]) AS o FROM ({_offsets('(?im)[0-9]+[.][0-9]+|^[a-z]{2,3} ')}))""")
def _(s, d):
    return L.regex_hits(table(s, d, "documents"), r"[0-9]+[.][0-9]+|^[a-z]{2,3} ").withColumn("context", F.md5("context"))


def _boolean(must: list[str], should: list[str], excluded: list[str], window: int) -> str:
    """Anchors of the first term, the nearest place of every other, spans once each by the first anchor, the best 20 a document."""
    terms = [*must, *should, *excluded]
    names = {t: f"p{i}" for i, t in enumerate(terms)}
    # no term can overlap itself: what lies between its occurrences adds up
    between = ", ".join(f"list_transform(string_split(t, '{x}'), lambda g: length(g)) AS g{names[x]}" for x in terms)
    places = ", ".join(f"list_transform(range(1, len(g{names[x]})), lambda i: list_sum(g{names[x]}[1:i])::BIGINT + (i - 1) * {len(x)}) AS {names[x]}" for x in terms)
    near = lambda x: f"list_sort(list_transform(list_filter({names[x]}, lambda p: abs(p - a) <= {window}), lambda p: [abs(p - a), p]))[1][2]"
    (anchor, *rest), extra = (must, should) if must else (should[:1], should[1:])
    found = ", ".join(f"{near(x)} AS n{names[x]}" for x in [*rest, *extra, *excluded])
    score = " + ".join([f"{1.0 + len(rest)}", *(f"CASE WHEN n{names[x]} IS NULL THEN 0 ELSE 0.5 END" for x in extra)])
    low = ", ".join(["a", *(f"n{names[x]}" for x in [*rest, *extra])])
    high = ", ".join([f"a + {len(anchor)}", *(f"n{names[x]} + {len(x)}" for x in [*rest, *extra])])
    fits = " AND ".join(["true", *(f"n{names[x]} IS NOT NULL" for x in rest), *(f"n{names[x]} IS NULL" for x in excluded)])
    return f"""WITH p AS (SELECT doc_id, text, {places} FROM (SELECT doc_id, text, {between} FROM (SELECT doc_id, text, lower(text) AS t FROM documents))), a AS (SELECT *, unnest({names[anchor]}) AS a FROM p), n AS (SELECT *, {found} FROM a),
    h AS (SELECT doc_id, text, a, least({low}) AS x, greatest({high}) AS y, {score} AS score FROM n WHERE {fits}),
    u AS (SELECT doc_id, any_value(text) AS text, x, y, min_by(score, a)::DOUBLE AS score, min(a) AS a FROM h GROUP BY doc_id, x, y), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, a) - 1 AS hit FROM u)
    SELECT doc_id, hit::INTEGER AS hit, x AS "offset", md5(substr(text, x + 1, y - x)) AS match, md5(substr(text, greatest(0, x - 200) + 1, y + 200 - greatest(0, x - 200))) AS context, score FROM r WHERE hit < 20"""


def _digests(rows):
    return rows.withColumns({"match": F.md5("match"), "context": F.md5("context")})


@add("boolean_search", _boolean(["thing", "and the"], ["with"], ["ble ing"], 100))
def _(s, d):
    return _digests(L.boolean_search(table(s, d, "documents"), "thing AND and the OR with NOT ble ing", 100))


@add("boolean_should_only", _boolean([], ["tionth", "of the"], ["shthe"], 500))
def _(s, d):
    return _digests(L.boolean_search(table(s, d, "documents"), "OR tionth OR of the NOT shthe"))


@add("nearest_position", f"""
WITH p AS (SELECT doc_id, lower(text) AS t FROM documents WHERE contains(lower(text), 'ing') AND contains(lower(text), 'for')), q AS ({_places('for')})
SELECT doc_id, any_value(strpos(t, 'ing')) - 1 AS anchor_at, min_by(i, abs(i - strpos(t, 'ing')) * 1000000 + i) - 1 AS term_at FROM q JOIN p USING (doc_id) WHERE abs(i - strpos(t, 'ing')) <= 500 GROUP BY doc_id""")
def _(s, d):
    return L.nearest_position(table(s, d, "documents"), "ing", "for")


BODY = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"""
TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@add("html_strip_title", f"SELECT page_id, {TITLE} AS title, md5({BODY}) AS body FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.html_title(C("html")).alias("title"), F.md5(T.html_text(C("html"))).alias("body"))


BLOCKED = ["example.net", "ththre.example.com"]


HOST = "lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1))"


@add("url_domain_filter", f"SELECT page_id, d AS domain FROM (SELECT page_id, {HOST} AS d FROM pages) WHERE NOT (" + " OR ".join(f"d = '{b}' OR ends_with(d, '.{b}')" for b in BLOCKED) + ")")
def _(s, d):
    pages = table(s, d, "pages").select("page_id", T.domain(C("url")).alias("domain"))
    blocked = s.createDataFrame([(b,) for b in BLOCKED], "b string")
    return pages.join(F.broadcast(blocked), T.is_blocked(C("domain"), C("b")), "left_anti")


@add("dedup_first", f"SELECT page_id, title, url FROM (SELECT *, row_number() OVER (PARTITION BY lower(title), lower(url) ORDER BY page_id) AS r FROM (SELECT page_id, trim({TITLE}) AS title, trim(regexp_replace(url, '[0-9]', '', 'g')) AS url FROM pages) WHERE title <> '' OR url <> '') WHERE r = 1")
def _(s, d):
    # numbers are left out of the URLs, so that some are equal
    rows = table(s, d, "pages").select(F.lit(0).alias("query_id"), C("page_id").alias("rank"), T.html_title(C("html")).alias("title"), F.regexp_replace("url", "[0-9]", "").alias("url"), F.lit("").alias("snippet"))
    return U.distinct_results(rows).select(C("rank").alias("page_id"), "title", "url")


SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？]|\n)', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@add("sentence_counts", f"SELECT doc_id, len({SENTENCES})::INTEGER AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.sentences(C("text"))).alias("n"))


@add("char_jaccard", "SELECT a.item_id, b.item_id AS other, round(len(list_intersect(list_distinct(string_split(a.text, '')), list_distinct(string_split(b.text, '')))) / len(list_distinct(list_concat(string_split(a.text, ''), string_split(b.text, '')))), 6) AS j FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def _(s, d):
    a = table(s, d, "benchmark")
    b = a.select((C("item_id") - 1).alias("item_id"), C("text").alias("t2"))
    return a.join(b, "item_id").select("item_id", (C("item_id") + 1).alias("other"), F.round(T.char_jaccard(C("text"), C("t2")), 6).alias("j"))


@add("latex_dollars", "SELECT doc_id, md5(text) AS text FROM documents")
def _(s, d):
    # formulas in dollars are put into brackets first, so that they come back as they were
    bracketed = F.regexp_replace("text", r"(?s)\$\$(.*?)\$\$", r"\\[$1\\]")
    rows = table(s, d, "documents").select("doc_id", bracketed.alias("text"))
    return per_row(rows, ["doc_id"], ["text"], "text string", lambda t: [(dollars(t),)]).withColumn("text", F.md5("text"))
