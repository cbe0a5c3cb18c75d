"""Queries over questions, models' replies, marked-up text and model ids, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import markup as P
from lexmill.functions import models as O
from lexmill.functions import questions as A
from lexmill.sources.tables import table

C = F.col
Q: dict = {}


def add(name, sql):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _each(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        quoted, into = pattern.replace("'", "''"), by.replace("$", "\\").replace("\n", "' || chr(10) || '")
        x = f"regexp_replace({x}, '{quoted}', '{into}', 'g')"
    return x


#: Phrases that the conversations lack are put around their texts, another for each row.
PHRASES = ["啥意思", "", "讲了啥", "是啥", "为啥要 ", "咋用 ", "怎么用", "这个", "它和那段", "啥", "咋 "]
#: Questions: half of them with the next turn as a selection.
ASKED = f"""SELECT conv_id, turn, CASE WHEN k % 2 = 0 THEN p || text ELSE text || p END AS query, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '  ' || text ELSE ' ' END AS selected
FROM (SELECT *, conv_id + turn AS k, {PHRASES}[(conv_id + turn) % {len(PHRASES)} + 1] AS p FROM conversations)"""


def asked(s, d):
    k = C("conv_id") + C("turn")
    rows = table(s, d, "conversations").withColumns({"k": k, "p": F.get(F.array(*map(F.lit, PHRASES)), (k % len(PHRASES)).cast("int"))})
    query = F.when(C("k") % 2 == 0, F.concat("p", "text")).otherwise(F.concat("text", "p"))
    return rows.select("conv_id", "turn", query.alias("query"), F.when(C("k") % 3 == 1, F.concat(F.lit("  "), "text")).when(C("k") % 3 == 2, " ").alias("selected"))


def _key(x: str, most: int) -> str:
    return f"substr(coalesce(list_filter(list_transform(regexp_split_to_array({_strip(x)}, '[。！？\\n；;!?]'), lambda p: {_strip('p')}), lambda p: p <> '')[1], {_strip(x)}, ''), 1, {most})"


def _rewritten() -> str:
    resolved, chosen = "query", f"coalesce({_strip('selected')}, '')"
    ctes = [f"a AS (SELECT *, {chosen} AS chosen, {_key('selected', 50)} AS key50, {_key('selected', 80)} AS key80 FROM ({ASKED}))"]
    for i, pronoun in enumerate(A.PRONOUNS):
        resolved = f"CASE WHEN strpos({'r' if i else 'query'}, '{pronoun}') > 0 THEN substr({'r' if i else 'query'}, 1, strpos({'r' if i else 'query'}, '{pronoun}') - 1) || key50 || substr({'r' if i else 'query'}, strpos({'r' if i else 'query'}, '{pronoun}') + {len(pronoun)}) ELSE {'r' if i else 'query'} END"
        ctes.append(f"p{i} AS (SELECT * {'EXCLUDE (r)' if i else ''}, {resolved} AS r FROM {f'p{i - 1}' if i else 'a'})")
    ctes.append(f"q AS (SELECT *, CASE WHEN chosen <> '' THEN r ELSE query END AS t FROM p{len(A.PRONOUNS) - 1})")
    plain = "coalesce(" + ", ".join(f"nullif(regexp_replace(t, '{p}', '{by.replace('$', chr(92))}', 'g'), t)" for p, by in A.COLLOQUIAL) + ", t)"
    return f"WITH {', '.join(ctes)} SELECT conv_id, turn, md5(CASE WHEN {_strip('query')} = '' THEN query WHEN chosen <> '' AND {plain} = query THEN query || ' ' || key80 ELSE {plain} END) AS query FROM q"


@add("query_rewrite", _rewritten())
def _(s, d):
    return asked(s, d).select("conv_id", "turn", F.md5(A.rewritten(C("query"), C("selected"))).alias("query"))


SQUEEZED = lambda x, n: f"substr({_strip(f'''regexp_replace(coalesce({x}, ''), '[ ' || chr(9) || '-' || chr(13) || ']+', ' ', 'g')''')}, 1, {n})"


@add("web_query", f"""WITH a AS (SELECT *, {SQUEEZED('query', 180)} AS base, regexp_replace({SQUEEZED("'Doc  ' || conv_id || '.PDF'", 80)}, '(?i)\\.(pdf|docx?|txt|md)$', '') AS name, {SQUEEZED('selected', 80)} AS part FROM ({ASKED}))
SELECT conv_id, turn, md5(CASE WHEN base = '' THEN '' ELSE {SQUEEZED("base || CASE WHEN name <> '' AND NOT contains(lower(base), lower(name)) THEN ' ' || name ELSE '' END || CASE WHEN " + _any('lower(query)', A.WEB_PRONOUNS) + " AND part <> '' THEN ' ' || part ELSE '' END", 260)} END) AS query FROM a""")
def _(s, d):
    title = F.concat(F.lit("Doc  "), C("conv_id").cast("string"), F.lit(".PDF"))
    return asked(s, d).select("conv_id", "turn", F.md5(A.web_query(C("query"), C("query"), title, C("selected"))).alias("query"))


@add("question_intents", f"""SELECT conv_id, turn, length(query) >= 10 AND regexp_matches(query, '{A.DECOMPOSE}') AS decompose, CASE WHEN {_any('q', A.SEARCH_WORDS)} THEN true WHEN {_any('q', A.NO_SEARCH_WORDS)} THEN false ELSE q <> '' END AS web,
CASE WHEN f IS NOT NULL AND (m IS NULL OR f <= m) THEN 'flowchart' WHEN m IS NOT NULL THEN 'mindmap' END AS preset
FROM (SELECT *, list_min(list_filter([{', '.join(f"strpos(q, '{w}')" for w in A.MINDMAP_WORDS)}], lambda i: i > 0)) AS m, list_min(list_filter([{', '.join(f"strpos(q, '{w}')" for w in A.FLOWCHART_WORDS)}], lambda i: i > 0)) AS f
 FROM (SELECT conv_id, turn, query, lower({_strip('query')}) AS q FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Draw a MindMap or a flow chart ' WHEN 1 THEN '流程图比较 ' WHEN 2 THEN 'mind map: 总结 ' ELSE '' END || query AS query FROM ({ASKED}))))""")
def _(s, d):
    lead = F.when(C("turn") % 4 == 0, "Draw a MindMap or a flow chart ").when(C("turn") % 4 == 1, "流程图比较 ").when(C("turn") % 4 == 2, "mind map: 总结 ").otherwise("")
    q = asked(s, d).withColumn("query", F.concat(lead, "query"))
    return q.select("conv_id", "turn", A.should_decompose(C("query")).alias("decompose"), A.needs_web(C("query")).alias("web"), A.preset(C("query")).alias("preset"))


DETAIL = "['concise', ' Detailed ', 'standard', 'long'][conv_id % 4 + 1]"


@add("answer_tokens", f"""SELECT conv_id, turn, kind, CASE kind WHEN 'detailed' THEN greatest(coalesce(most, 0), 8192) WHEN 'standard' THEN coalesce(most, 4096) ELSE most END + CASE WHEN turn % 2 = 0 THEN 1024 ELSE 0 END AS tokens FROM (
SELECT conv_id, turn, CASE WHEN lower(trim({DETAIL})) IN ('concise', 'detailed') THEN lower(trim({DETAIL})) ELSE 'standard' END AS kind, CASE WHEN turn % 3 > 0 THEN turn * 3000 END AS most FROM conversations)""")
def _(s, d):
    t = table(s, d, "conversations")
    detail = F.get(F.array(*map(F.lit, ["concise", " Detailed ", "standard", "long"])), (C("conv_id") % 4).cast("int"))
    most = F.when(C("turn") % 3 > 0, C("turn") * 3000)
    return t.select("conv_id", "turn", A.answer_detail(detail).alias("kind"), A.answer_tokens(most, detail, C("turn") % 2 == 0).alias("tokens"))


@add("expanded_queries", """WITH l AS (SELECT conv_id, turn, text, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT conv_id, turn, text, string_split('1. ' || text || chr(10) || '- ' || text || ' more' || chr(10) || '2) no' || chr(10) || chr(10) || turn || ') another ' || conv_id || chr(10) || 'last one', chr(10)) AS l FROM conversations)),
p AS (SELECT conv_id, turn, text, i, trim(regexp_replace(regexp_replace(trim(x), '^[0-9]+[.)]\\s*', ''), '^[-•]\\s*', '')) AS x FROM l)
SELECT conv_id, turn, md5(array_to_string(list(x ORDER BY i)[1:3], '|')) AS queries FROM p WHERE x <> text AND length(x) > 3 GROUP BY conv_id, turn""")
def _(s, d):
    reply = F.concat(F.lit("1. "), "text", F.lit("\n- "), "text", F.lit(" more\n2) no\n\n"), C("turn").cast("string"), F.lit(") another "), C("conv_id").cast("string"), F.lit("\nlast one"))
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(F.array_join(A.expanded_queries(reply, C("text")), "|")).alias("queries"))


@add("reply_scores", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN least(conv_id % 13, 10) / 10.0 WHEN 1 THEN CASE WHEN conv_id % 13 <= 10 THEN (conv_id % 13) / 10.0 END WHEN 2 THEN CASE WHEN conv_id % 13 <= 10 THEN (conv_id % 13) / 10.0 END END AS score FROM conversations")
def _(s, d):
    n = (C("conv_id") % 13).cast("string")
    reply = F.when(C("turn") % 4 == 0, F.concat(n, F.lit("/10"))).when(C("turn") % 4 == 1, F.concat(F.lit("评分："), n, F.lit("."))).when(C("turn") % 4 == 2, F.concat(F.lit("x1 "), n, F.lit(" of 100"))).otherwise("none 123")
    return table(s, d, "conversations").select("conv_id", "turn", A.reply_score(reply).alias("score"))


@add("distilled_facts", "SELECT conv_id, turn, array_to_string(list_filter(['likes ' || role, substr(text, 1, 2), 'turn ' || turn], lambda x: length(trim(x)) > 3), '|') AS facts FROM conversations")
def _(s, d):
    reply = F.concat(F.lit("- likes "), "role", F.lit("\n-no\n  - "), F.substring("text", 1, 2), F.lit("\nplain line\n- turn "), C("turn").cast("string"))
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(A.distilled_facts(reply), "|").alias("facts"))


#: Documents dressed as Markdown, scans and mind maps.
MARKED = "'# Title ' || doc_id || chr(10) || chr(10) || '> **' || substr(text, 1, 40) || '** and `code` with ~~gone~~ <b>tags</b>' || chr(10) || '---' || chr(10) || '- [link](http://x) ![img](y.png)' || chr(10) || chr(10) || chr(10) || chr(10) || '  3. third' || chr(10) || text"
SAFE = [r for r in P.MARKDOWN if "(?<" not in r[0]]


def marked():
    return F.concat(F.lit("# Title "), C("doc_id").cast("string"), F.lit("\n\n> **"), F.substring("text", 1, 40), F.lit("** and `code` with ~~gone~~ <b>tags</b>\n---\n- [link](http://x) ![img](y.png)\n\n\n\n  3. third\n"), C("text"))


@add("markdown_text", None)
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(P.markdown_text(marked())).alias("text"))


@add("ocr_text", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[|l]([a-z])', 'I\1', 'g'), '([a-z])[0O]([a-z])', '\1o\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\n[a-zA-Z]\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text
FROM (SELECT doc_id, 'g0od |ower  a' || chr(10) || 'x' || chr(10) || replace(replace(replace(text, 'l', 'L'), '0', '1'), 'O', 'o') || chr(9) || 'f0r' AS t FROM documents)""")
def _(s, d):
    calm = F.translate("text", "l0O", "L1o")
    return table(s, d, "documents").select("doc_id", F.md5(P.ocr_text(F.concat(F.lit("g0od |ower  a\nx\n"), calm, F.lit("\tf0r")))).alias("text"))


#: The repaired text's paragraphs as a fold over its lines.
REBUILT = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, i, {_strip('g[i]')} AS x, len(g) AS n FROM (SELECT doc_id, string_split({_each("replace(text, 'a', '- a')", P.REPAIRS)}, chr(10)) AS g, unnest(range(1, len(g) + 1)) AS i FROM documents)),
f(doc_id, i, now, done) AS (SELECT doc_id, 0, '', '' FROM (SELECT DISTINCT doc_id FROM p) UNION ALL SELECT doc_id, i, CASE WHEN begins OR x = '' THEN x ELSE now || ' ' || x END, CASE WHEN (begins OR x = '') AND now <> '' THEN CASE WHEN done = '' THEN now ELSE done || chr(10) || chr(10) || now END ELSE done END
 FROM (SELECT f.*, p.i AS i, p.x, f.now = '' OR regexp_matches(p.x, '{P.NEW_PARAGRAPH}') OR (regexp_matches(f.now, '{P.SENTENCE_END}') AND regexp_matches(p.x, '{P.SENTENCE_BEGIN}')) AS begins FROM (SELECT doc_id, i AS j, now, done FROM f) f JOIN p ON p.doc_id = f.doc_id AND p.i = f.j + 1))
SELECT doc_id, md5({_strip("CASE WHEN now = '' THEN done WHEN done = '' THEN now ELSE done || chr(10) || chr(10) || now END")}) AS text FROM f JOIN (SELECT doc_id, max(i) AS i FROM p GROUP BY doc_id) USING (doc_id, i)"""


@add("heuristic_rebuild", REBUILT)
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(P.rebuilt(F.replace("text", F.lit("a"), F.lit("- a")))).alias("text"))


@add("pdf_quality", r"""SELECT doc_id, CASE WHEN length(regexp_replace(t, '^\s+|\s+$', '', 'g')) < 100 THEN 'short' WHEN len(regexp_extract_all(t, '[\x{FFFD}□■◆●○◇△▽▲▼\x00-\x08\x0b\x0c\x0e-\x1f]')) / length(t) > 0.05 THEN 'garbled' WHEN length(t) / greatest(doc_id % 12, 1) < 200 THEN 'thin'
 WHEN length(regexp_replace(t, '[^\p{L}\p{M}\p{Nd}\p{Pc}]|\p{Nd}', '', 'g')) < length(t) * 0.3 THEN 'meaningless' ELSE 'fine' END AS reason FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(text, 'e', '■') WHEN 1 THEN translate(text, 'aeiourtnsh', '0123456789') ELSE text END AS t FROM documents)""")
def _(s, d):
    t = F.when(C("doc_id") % 5 == 0, F.replace("text", F.lit("e"), F.lit("■"))).when(C("doc_id") % 5 == 1, F.translate("text", "aeiourtnsh", "0123456789")).otherwise(C("text"))
    return table(s, d, "documents").select("doc_id", P.pdf_reason(t, C("doc_id") % 12).alias("reason"))


@add("mindmap_markdown", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '# Talk ' || conv_id || chr(10) || repeat('#', (turn + 1)::INTEGER) || ' ' || role || chr(10) || 'plain' ELSE '# only ' || role END AS map FROM conversations")
def _(s, d):
    whole = F.concat(F.lit("noise @startmindmap\n* Talk "), C("conv_id").cast("string"), F.lit("\n\n"), F.repeat(F.lit("*"), (C("turn") + 1).cast("int")), C("role"), F.lit("  \nplain\n@endmindmap tail"))
    text = F.when(C("turn") % 2 == 0, whole).otherwise(F.concat(F.lit("*only "), "role"))
    return table(s, d, "conversations").select("conv_id", "turn", P.mindmap_markdown(text).alias("map"))


#: Ids that stand for the kinds of models.
IDS = ["text-embedding-3-small", "bge-reranker-v2", "gpt-4o-mini", "claude-sonnet-4-x", "glm-4.6-free", "kimi-k2-thinking", "doubao-seed-1", "deepseek-r1", "qwen-vl-max", "gemini-2.0", "minimax-m2", "multilingual-e5-large", "o3", "whisper"]
MODEL = f"{IDS}[(n_nationkey % {len(IDS)}) + 1]"


@add("model_kinds", rf"""SELECT n_nationkey AS k, CASE WHEN n_nationkey >= 20 THEN 'chosen' WHEN n_nationkey % 3 <> 0 AND regexp_matches(m, '{O.RERANKING}') THEN 'rerank' WHEN regexp_matches(m, '{O.EMBEDDING}') AND NOT regexp_matches(m, '{O.RERANKING}') THEN 'embedding' ELSE 'chat' END AS kind,
array_to_string(list_filter([CASE WHEN contains(l, 'free') THEN 'free' END, CASE WHEN regexp_matches(l, '{O.VISION}') THEN 'vision' END, CASE WHEN regexp_matches(l, '{O.CHINESE}') THEN 'chinese_optimized' END, CASE WHEN regexp_matches(l, '{O.REASONING}') THEN 'reasoning' END], lambda x: x IS NOT NULL), ',') AS tags,
CASE WHEN contains(l, 'doubao') THEN 'doubao' WHEN contains(l, 'moonshot') OR contains(l, 'kimi') THEN 'moonshot' WHEN contains(l, 'zhipu') OR contains(l, 'glm') THEN 'zhipu' WHEN contains(l, 'minimax') THEN 'minimax' WHEN contains(l, 'qwen') OR contains(l, 'alibaba') THEN 'openai'
 WHEN starts_with(l, 'claude') THEN 'anthropic' WHEN starts_with(l, 'gemini') THEN 'gemini' ELSE 'openai' END AS provider FROM (SELECT n_nationkey, {MODEL} AS m, lower({MODEL}) AS l FROM nation)""")
def _(s, d):
    m = F.get(F.array(*map(F.lit, IDS)), C("n_nationkey") % len(IDS))
    chosen = F.when(C("n_nationkey") >= 20, "chosen")
    disabled = F.when(C("n_nationkey") % 3 == 0, F.array(F.lit("rerank")))
    return table(s, d, "nation").select(C("n_nationkey").alias("k"), O.model_type(m, chosen, disabled).alias("kind"), F.array_join(O.model_tags(m), ",").alias("tags"), O.provider_of(m).alias("provider"))


@add("model_resolution", """WITH a AS (SELECT DISTINCT 'NATION' || n_nationkey AS asked FROM nation WHERE n_nationkey < 3 UNION SELECT 'p' || n_regionkey || ':' || n_name FROM nation UNION SELECT 'p1:key4' UNION SELECT 'p0:absent' UNION SELECT 'key7')
SELECT asked, CASE WHEN asked = 'key7' THEN 'key7' WHEN asked = 'p1:key4' THEN 'key4' ELSE (SELECT min('key' || n_nationkey) FROM nation WHERE asked = 'p' || n_regionkey || ':' || n_name AND n_regionkey <> 2) END AS key FROM a""")
def _(s, d):
    n = table(s, d, "nation")
    text = lambda c: C(c).cast("string")
    registry = n.select(F.concat(F.lit("key"), text("n_nationkey")).alias("key"), C("n_name").alias("model_name"), F.concat(F.lit("prov"), text("n_regionkey")).alias("provider"), F.concat(F.lit("https://r"), text("n_regionkey")).alias("base_url"))
    aliases = table(s, d, "region").select(F.concat(F.lit("p"), text("r_regionkey")).alias("name"), F.concat(F.lit("prov"), text("r_regionkey")).alias("provider"), F.when(C("r_regionkey") == 2, "elsewhere").when(C("r_regionkey") > 2, F.concat(F.lit("//r"), text("r_regionkey"))).alias("url_hint"))
    asked_for = n.where("n_nationkey < 3").select(F.concat(F.lit("NATION"), text("n_nationkey")).alias("asked")).union(n.select(F.concat(F.lit("p"), text("n_regionkey"), F.lit(":"), "n_name")))
    return O.resolved(asked_for.union(s.createDataFrame([("p1:key4",), ("p0:absent",), ("key7",)], "asked string")), registry, aliases)
