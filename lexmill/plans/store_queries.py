"""Queries over stores and logs: rows written and read back, inserts, replacements and deletions, and citations' support."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import context as X
from lexmill.operators import evaluation as E
from lexmill.plans.retrieval_queries import TOKENS
from lexmill.plans.text_queries import SENTENCES
from lexmill.sources import tables as S
from lexmill.sources.tables import table
from lexmill.stage import scratch

C = F.col
Q: dict = {}


def add(name, sql):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


@add("csv_rows", "SELECT '| ' || s_suppkey || ' | ' || s_name || ' | ' || s_nationkey || ' |' AS row FROM supplier")
def _(s, d):
    path = scratch(s, "csv")
    table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(path)
    return S.markdown_csv(s, path)


@add("log_entries", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type || ' ' || event_id AS entry FROM events")
def _(s, d):
    path = scratch(s, "log")
    e = table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat_ws(" ", "event_type", "event_id").alias("entry"), "event_id")
    # two writers append to one log
    for k in range(2):
        S.write_log(e.where(C("event_id") % 2 == k), path)
    return s.read.schema("value string, day string").text(path).select("day", C("value").alias("entry"))


@add("feedback_log", "SELECT 'c' || conv_id AS doc_id, turn AS message_idx, CASE WHEN turn % 2 = 0 THEN 'up' ELSE 'down' END AS feedback_type, md5(substr(text, 1, 500)) AS answer FROM conversations")
def _(s, d):
    path = scratch(s, "feedback")
    t = table(s, d, "conversations").select(F.lit("2024-05-01T10:00:00").alias("timestamp"), F.concat(F.lit("c"), C("conv_id").cast("string")).alias("doc_id"), C("turn").cast("int").alias("message_idx"), F.when(C("turn") % 2 == 0, "up").otherwise("down").alias("feedback_type"), C("text").alias("answer"))
    S.write_feedback(t, path)
    return S.feedback_log(s, path).select("doc_id", C("message_idx").cast("long").alias("message_idx"), "feedback_type", F.md5("answer").alias("answer"))


@add("json_store", "SELECT doc_id, lang, md5(text) AS text FROM documents WHERE lang = 'en'")
def _(s, d):
    path = scratch(s, "documents")
    S.write_table(table(s, d, "documents"), path, "lang")
    return s.read.parquet(path).where("lang = 'en'").select("doc_id", "lang", F.md5("text").alias("text"))


@add("kv_replace", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' || lang ELSE md5(text) END AS v FROM documents")
def _(s, d):
    t = table(s, d, "documents")
    new = t.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("new "), "lang").alias("v"))
    return S.replace_rows(t.select("doc_id", F.md5("text").alias("v")), new, "doc_id")


@add("kv_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(s, d):
    return S.delete_rows(table(s, d, "documents").select("doc_id"), table(s, d, "labels").where("toxic = 1").select("doc_id"), "doc_id")


@add("keyword_lists", "SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,，、\\n]+'), lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^[0-9]+[.)、]\\s*', ''), '^[-•]\\s*', ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:6], '|')) AS keywords FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.array_join(T.keyword_list(C("text")), "|")).alias("keywords"))


@add("source_lines", "SELECT conv_id, turn, '[1] 来源: ' || role || '，页码: ' || turn || '-' || turn + 1 || chr(10) || '[2] 来源: c' || conv_id || '，页码: 1-1' AS lines FROM conversations")
def _(s, d):
    cited = lambda ref, group, a, b: F.struct(F.lit(ref).alias("ref"), group.alias("group_id"), a.cast("int").alias("page_start"), b.cast("int").alias("page_end"))
    both = F.array(cited(1, C("role"), C("turn"), C("turn") + 1), cited(2, F.concat(F.lit("c"), C("conv_id").cast("string")), F.lit(1), F.lit(1)))
    return table(s, d, "conversations").select("conv_id", "turn", X.sources_line(both).alias("lines"))


#: Every stop is a citation: of the row's own text on even turns, of its conversation's first turn on odd ones.
CITED = "regexp_replace(text, '([.!?])', CASE WHEN turn % 2 = 0 THEN ' [2]\\1' ELSE ' [1]\\1' END, 'g')"


def _toks(column: str) -> str:
    return f"list_distinct({TOKENS.replace('lower(text)', f'lower({column})')})"


@add("citation_support", f"""WITH a AS (SELECT conv_id * 100 + turn AS answer_id, conv_id, turn, text AS own, {CITED} AS text FROM conversations), s AS (SELECT answer_id, conv_id, turn, own, unnest(l) AS sentence, unnest(range(len(l)))::INTEGER AS idx FROM (SELECT *, {SENTENCES} AS l FROM a)),
h AS (SELECT answer_id, idx, sentence, CASE WHEN turn % 2 = 0 THEN own ELSE (SELECT min_by(c.text, c.turn) FROM conversations c WHERE c.conv_id = s.conv_id) END AS highlight FROM s WHERE regexp_matches(sentence, '\\[[12]\\]'))
SELECT answer_id, idx, round(len(list_intersect({_toks('sentence')}, {_toks('highlight')})) / greatest(len({_toks('sentence')}), 1), 6) AS overlap, len(list_intersect({_toks('sentence')}, {_toks('highlight')})) / greatest(len({_toks('sentence')}), 1) >= 0.08 AS supported FROM h""")
def _(s, d):
    t = table(s, d, "conversations")
    key = (C("conv_id") * 100 + C("turn")).alias("answer_id")
    answers = t.select(key, F.when(C("turn") % 2 == 0, F.regexp_replace("text", "([.!?])", " [2]$1")).otherwise(F.regexp_replace("text", "([.!?])", " [1]$1")).alias("answer"))
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("highlight"))
    cited = t.join(first, "conv_id").select(key, F.lit(1).alias("ref"), "highlight").unionByName(t.select(key, F.lit(2).alias("ref"), C("text").alias("highlight")))
    return E.citation_support(answers, cited)
