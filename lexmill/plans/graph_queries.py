"""Queries over an entity graph: words of the benchmark passages, linked where they stand side by side."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import graph as G
from lexmill.operators import leiden as N
from lexmill.sources.tables import table
from lexmill.stage import cut

C = F.col
Q: dict = {}


def add(name, sql):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


def triples(s, d):
    b = table(s, d, "benchmark").select(F.concat(F.lit("c"), C("item_id").cast("string")).alias("chunk_id"), T.tokens(C("text")).alias("t"))
    e = b.select("chunk_id", F.explode("t").alias("w")).select("chunk_id", F.upper("w").alias("name"), F.when(F.length("w") > 5, "LONG").otherwise("SHORT").alias("type"), F.concat(F.lit("word "), C("w")).alias("description"))
    pairs = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.struct(F.upper(a).alias("src"), F.upper(b).alias("tgt")))
    r = b.select("chunk_id", F.explode(pairs).alias("p")).select("chunk_id", "p.src", "p.tgt", F.lit("beside").alias("description"), F.lit(1.0).alias("weight"))
    return e, r


TOK = "list_filter(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9]+'), lambda t: length(t) > 1)"
BASE = f"""b AS (SELECT 'c' || item_id AS chunk_id, {TOK} AS t FROM benchmark),
e AS (SELECT chunk_id, upper(w) AS name, CASE WHEN length(w) > 5 THEN 'LONG' ELSE 'SHORT' END AS type, 'word ' || w AS description FROM (SELECT chunk_id, unnest(t) AS w FROM b)),
r AS (SELECT chunk_id, upper(t[i]) AS src, upper(t[i + 1]) AS tgt, 1.0 AS weight FROM (SELECT chunk_id, t, unnest(range(1, len(t))) AS i FROM b)),
nodes AS (SELECT name, min(type) AS type, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, string_agg(DISTINCT chunk_id, '<SEP>' ORDER BY chunk_id) AS source_id FROM e GROUP BY name),
edges AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, round(sum(weight), 6) AS weight, string_agg(DISTINCT chunk_id, '<SEP>' ORDER BY chunk_id) AS source_id FROM r GROUP BY ALL)"""


@add("entity_merge", f"WITH {BASE} SELECT name, type, description, source_id FROM nodes")
def _(s, d):
    return G.merge_entities(triples(s, d)[0])


@add("edge_merge", f"WITH {BASE} SELECT src, tgt, weight::DOUBLE AS weight, source_id FROM edges")
def _(s, d):
    return G.merge_edges(triples(s, d)[1]).drop("description")


@add("missing_nodes", f"WITH {BASE} SELECT name, type FROM (SELECT name, type FROM nodes WHERE type = 'LONG' UNION ALL SELECT DISTINCT name, 'UNKNOWN' FROM (SELECT src AS name FROM edges UNION SELECT tgt FROM edges) WHERE name NOT IN (SELECT name FROM nodes WHERE type = 'LONG'))")
def _(s, d):
    e, r = triples(s, d)
    return G.with_missing_nodes(G.merge_entities(e).where("type = 'LONG'"), G.merge_edges(r)).select("name", "type")


@add("node_degree", f"WITH {BASE} SELECT name, count(*) AS degree FROM (SELECT src AS name FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY name")
def _(s, d):
    return G.degrees(G.merge_edges(triples(s, d)[1]))


@add("edge_degree", f"WITH {BASE}, d AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY name) SELECT src, tgt, a.degree + b.degree AS degree FROM edges JOIN d a ON a.name = src JOIN d b ON b.name = tgt")
def _(s, d):
    return G.edge_degrees(G.merge_edges(triples(s, d)[1])).select("src", "tgt", "degree")


@add("components", f"""WITH RECURSIVE {BASE}, both_ AS (SELECT src, tgt FROM edges UNION SELECT tgt, src FROM edges),
reach(name, other) AS (SELECT src, src FROM both_ UNION SELECT reach.name, both_.tgt FROM reach JOIN both_ ON both_.src = reach.other)
SELECT name, min(other) AS component FROM reach GROUP BY name""")
def _(s, d):
    return G.components(G.merge_edges(triples(s, d)[1]))


def cooccurrence(s, d):
    """All words of the documents that stand side by side: one row an undirected pair, without a list of its documents."""
    t = table(s, d, "documents").select(T.tokens(C("text")).alias("t"))
    n = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("t", 1, n), F.slice("t", 2, n), lambda a, b: F.struct(F.upper(a).alias("a"), F.upper(b).alias("b")))
    r = t.select(F.explode(pairs).alias("p"))
    return r.groupBy(F.least("p.a", "p.b").alias("src"), F.greatest("p.a", "p.b").alias("tgt")).agg(F.count("*").cast("double").alias("weight"))


@add("document_components", None)
def _(s, d):
    return G.components(cooccurrence(s, d))


def flat(edges):
    return N.leiden(edges.select(F.lit("").alias("part"), "src", "tgt", "weight")).select("name", "cluster")


@add("document_communities", None)
def _(s, d):
    return flat(cooccurrence(s, d))


@add("communities", None)
def _(s, d):
    return flat(G.merge_edges(triples(s, d)[1]))


def levels(s, d):
    """Two levels of clusters: by first letter, and by the first two."""
    n = G.merge_entities(triples(s, d)[0]).select("name")
    return n.select("name", F.lit(0).alias("level"), F.substring("name", 1, 1).alias("cluster")).union(n.select("name", F.lit(1), F.substring("name", 1, 2)))


LEVELS = "lv AS (SELECT name, 0 AS level, substr(name, 1, 1) AS cluster FROM nodes UNION ALL SELECT name, 1, substr(name, 1, 2) FROM nodes)"


@add("community_schema", f"""WITH {BASE}, {LEVELS}, m AS (SELECT level, cluster, count(DISTINCT name) AS n_nodes, count(DISTINCT c) AS n_chunks FROM (SELECT level, cluster, name, unnest(string_split(source_id, '<SEP>')) AS c FROM lv JOIN nodes USING (name)) GROUP BY ALL),
i AS (SELECT level, cluster, count(DISTINCT src || '|' || tgt) AS n_edges FROM (SELECT src, tgt, src AS name FROM edges UNION SELECT src, tgt, tgt FROM edges) JOIN lv USING (name) GROUP BY ALL)
SELECT level, cluster, n_nodes::INT AS n_nodes, n_chunks::INT AS n_chunks, coalesce(n_edges, 0)::INT AS n_edges, round(n_chunks / max(n_chunks) OVER (), 6) AS occurrence FROM m LEFT JOIN i USING (level, cluster)""")
def _(s, d):
    e, r = triples(s, d)
    c = G.community_schema(levels(s, d), G.merge_entities(e), G.merge_edges(r))
    return c.select("level", "cluster", F.size("nodes").alias("n_nodes"), F.size("chunk_ids").alias("n_chunks"), F.coalesce(F.size("edges"), F.lit(0)).alias("n_edges"), "occurrence")


@add("sub_communities", f"WITH {BASE}, {LEVELS} SELECT DISTINCT 0 AS level, substr(name, 1, 1) AS cluster, substr(name, 1, 2) AS child FROM nodes")
def _(s, d):
    e, r = triples(s, d)
    return G.sub_communities(G.community_schema(levels(s, d), G.merge_entities(e), G.merge_edges(r)))


@add("community_vote", f"WITH {BASE}, {LEVELS}, v AS (SELECT q AS query_id, cluster, count(*) AS votes FROM (SELECT DISTINCT chunk_id AS q, name FROM e) JOIN lv USING (name) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, (ascii(cluster) % 5) DESC, cluster)::INTEGER AS rank FROM v")
def _(s, d):
    hits = triples(s, d)[0].select(C("chunk_id").alias("query_id"), "name").distinct()
    rated = levels(s, d).select("cluster").distinct().withColumn("rating", (F.ascii("cluster") % 5).cast("double"))
    return G.community_vote(hits, levels(s, d), 2, rated)


#: Entity hits: every passage's words by name.
HITS = "h AS (SELECT substr(chunk_id, 2)::BIGINT AS query_id, name, row_number() OVER (PARTITION BY chunk_id ORDER BY name) - 1 AS place FROM (SELECT DISTINCT chunk_id, name FROM e))"
ONE_HOP = f"""bo AS (SELECT src AS name, tgt AS other FROM edges UNION SELECT tgt, src FROM edges), ch AS (SELECT name, unnest(string_split(source_id, '<SEP>')) AS chunk_id FROM nodes),
w AS (SELECT query_id, chunk_id, min(place) AS "order", min_by(name, place) AS name FROM h JOIN ch USING (name) GROUP BY ALL),
n AS (SELECT query_id, w.chunk_id, count(*) AS relations FROM w JOIN bo USING (name) JOIN ch c ON c.name = bo.other AND c.chunk_id = w.chunk_id GROUP BY ALL),
units AS (SELECT query_id, chunk_id, "order", coalesce(relations, 0) AS relations, row_number() OVER (PARTITION BY query_id ORDER BY "order", coalesce(relations, 0) DESC, chunk_id) AS rank FROM w LEFT JOIN n USING (query_id, chunk_id))"""


def word_hits(s, d):
    names = triples(s, d)[0].select(F.substring("chunk_id", 2, 20).cast("long").alias("query_id"), "name").distinct()
    return names.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("name")) - 1)


@add("one_hop_units", f"""WITH {BASE}, {HITS}, {ONE_HOP} SELECT query_id, chunk_id, "order"::INTEGER AS "order", relations, rank::INTEGER AS rank FROM units""")
def _(s, d):
    e, r = triples(s, d)
    return G.one_hop(word_hits(s, d), G.merge_edges(r), G.merge_entities(e))


RELATED = """dg AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY name), ed AS (SELECT e.*, a.degree + b.degree AS degree FROM edges e JOIN dg a ON a.name = src JOIN dg b ON b.name = tgt),
rel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY degree DESC, weight DESC, src, tgt) - 1 AS place, sum(6) OVER (PARTITION BY query_id ORDER BY degree DESC, weight DESC, src, tgt ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT DISTINCT query_id, src, tgt, weight, degree FROM h JOIN ed ON name = src OR name = tgt))"""


@add("related_edges", f"WITH {BASE}, {HITS}, {RELATED} SELECT query_id, place::INTEGER AS place, src, tgt, weight::DOUBLE AS weight, degree FROM rel WHERE used <= 400")
def _(s, d):
    return G.related_edges(word_hits(s, d), G.merge_edges(triples(s, d)[1]), 400).select("query_id", "place", "src", "tgt", "weight", "degree")


def _lines(fields: str, order: str) -> str:
    return f"string_agg(concat_ws(',' || chr(9), {fields}), chr(10) ORDER BY {order})"


LOCAL = f"""WITH {BASE}, {LEVELS}, {HITS}, {ONE_HOP}, {RELATED},
vo AS (SELECT query_id, cluster, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, ascii(cluster) % 5 DESC, cluster) AS rank FROM (SELECT query_id, cluster, count(*) AS n FROM h JOIN lv USING (name) GROUP BY ALL)),
vu AS (SELECT *, 'report ' || cluster AS report, sum(length('report ' || cluster)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM vo),
su AS (SELECT units.*, b.text, sum(length(b.text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM units JOIN (SELECT 'c' || item_id AS chunk_id, text FROM benchmark) b USING (chunk_id)),
ta AS (SELECT query_id, 'id,' || chr(9) || 'content' || chr(10) || {_lines('(rank - 1)::VARCHAR, report', 'rank')} AS a FROM vu WHERE used <= 60 GROUP BY query_id),
tb AS (SELECT query_id, concat_ws(',' || chr(9), 'id', 'entity', 'type', 'description', 'rank') || chr(10) || {_lines('place::VARCHAR, name, nodes.type, nodes.description, coalesce(degree, 0)::VARCHAR', 'place')} AS b FROM h JOIN nodes USING (name) LEFT JOIN dg USING (name) GROUP BY query_id),
tc AS (SELECT query_id, concat_ws(',' || chr(9), 'id', 'source', 'target', 'description', 'weight', 'rank') || chr(10) || {_lines("place::VARCHAR, src, tgt, 'beside', weight::DOUBLE::VARCHAR, degree::VARCHAR", 'place')} AS c FROM rel WHERE used <= 400 GROUP BY query_id),
td AS (SELECT query_id, 'id,' || chr(9) || 'content' || chr(10) || {_lines('(rank - 1)::VARCHAR, text', 'rank')} AS d FROM su WHERE used <= 900 GROUP BY query_id)
SELECT query_id, concat_ws(chr(10), '-----Reports-----' || chr(10) || '```csv' || chr(10) || coalesce(a, '') || chr(10) || '```', '-----Entities-----' || chr(10) || '```csv' || chr(10) || b || chr(10) || '```', '-----Relationships-----' || chr(10) || '```csv' || chr(10) || coalesce(c, '') || chr(10) || '```', '-----Sources-----' || chr(10) || '```csv' || chr(10) || coalesce(d, '') || chr(10) || '```') AS context FROM tb LEFT JOIN ta USING (query_id) LEFT JOIN tc USING (query_id) LEFT JOIN td USING (query_id)"""


def local(s, d):
    e, r = triples(s, d)
    reports = levels(s, d).select("cluster").distinct().select("cluster", F.concat(F.lit("report "), "cluster").alias("report"), (F.ascii("cluster") % 5).cast("double").alias("rating"))
    sources = table(s, d, "benchmark").select(F.concat(F.lit("c"), C("item_id").cast("string")).alias("chunk_id"), "text")
    return G.local_query(word_hits(s, d), G.merge_entities(e), G.merge_edges(r), levels(s, d), reports, sources, 2, (60, 400, 900))


@add("local_query", f"SELECT query_id, md5(context) AS context FROM ({LOCAL})")
def _(s, d):
    return local(s, d).withColumn("context", F.md5("context"))


@add("hybrid_query", f"SELECT query_id, md5(context || chr(10) || chr(10) || 'world') AS context FROM ({LOCAL})")
def _(s, d):
    return G.hybrid_context(local(s, d), F.lit("world")).withColumn("context", F.md5("context"))


@add("community_packing", f"""WITH {BASE}, {LEVELS}, {RELATED.split(', rel AS')[0].split(',' + chr(10) + 'rel AS')[0]},
m AS (SELECT level, cluster, name, nodes.type, nodes.description, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY level, cluster ORDER BY name) - 1 AS id FROM lv JOIN nodes USING (name) LEFT JOIN dg USING (name)),
mu AS (SELECT *, sum(length(description)) OVER (PARTITION BY level, cluster ORDER BY degree DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM m),
l AS (SELECT *, row_number() OVER (PARTITION BY level, cluster ORDER BY src || tgt, src) - 1 AS id FROM (SELECT DISTINCT level, cluster, src, tgt, degree FROM lv JOIN ed ON name = src OR name = tgt)), lu AS (SELECT *, sum(6) OVER (PARTITION BY level, cluster ORDER BY degree DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM l),
pa AS (SELECT level, cluster, concat_ws(',' || chr(9), 'id', 'entity', 'type', 'description', 'degree') || chr(10) || {_lines('id::VARCHAR, name, type, description, degree::VARCHAR', 'degree DESC, id')} AS t FROM mu WHERE used <= 150 GROUP BY ALL),
pb AS (SELECT level, cluster, concat_ws(',' || chr(9), 'id', 'source', 'target', 'description', 'rank') || chr(10) || {_lines("id::VARCHAR, src, tgt, 'beside', degree::VARCHAR", 'degree DESC, id')} AS t FROM lu WHERE used <= 150 GROUP BY ALL)
SELECT level, cluster, md5('-----Reports-----' || chr(10) || '```csv' || chr(10) || chr(10) || '```' || chr(10) || '-----Entities-----' || chr(10) || '```csv' || chr(10) || coalesce(pa.t, '') || chr(10) || '```' || chr(10) || '-----Relationships-----' || chr(10) || '```csv' || chr(10) || coalesce(pb.t, '') || chr(10) || '```') AS description FROM (SELECT DISTINCT level, cluster FROM lv) LEFT JOIN pa USING (level, cluster) LEFT JOIN pb USING (level, cluster)""")
def _(s, d):
    e, r = triples(s, d)
    return G.packed_communities(levels(s, d), G.merge_entities(e), G.merge_edges(r), None, 300).withColumn("description", F.md5("description"))


@add("document_community_levels", None)
def _(s, d):
    return N.hierarchy(cooccurrence(s, d), 10)


@add("largest_component", f"""WITH RECURSIVE {BASE}, bo AS (SELECT src, tgt FROM edges UNION SELECT tgt, src FROM edges), reach(name) AS (SELECT min(name) FROM nodes UNION SELECT bo.tgt FROM reach JOIN bo ON bo.src = reach.name) SELECT name, name AS node FROM reach""")
def _(s, d):
    return G.largest_component(G.merge_edges(triples(s, d)[1]))


@add("entity_search", f"""WITH {BASE}, k AS (SELECT lower(name) AS key, count(*) AS mentions, min_by(lower(name), chunk_id) AS entity FROM e GROUP BY 1), q AS (SELECT conv_id * 100 + turn AS query_id, lower(substr(text, 1, 12)) AS q FROM conversations WHERE conv_id % 20 = 0),
s AS (SELECT query_id, key, entity, mentions, round(len(list_intersect(list_distinct(string_split(q, '')), list_distinct(string_split(key, '')))) / len(list_distinct(list_concat(string_split(q, ''), string_split(key, '')))) + CASE WHEN contains(q, key) OR contains(key, q) THEN 0.5 ELSE 0 END, 6) AS score FROM k, q)
SELECT query_id, entity, mentions, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INTEGER AS rank FROM s WHERE score >= 0.1 QUALIFY rank <= 5""")
def _(s, d):
    q = table(s, d, "conversations").where("conv_id % 20 = 0").select((C("conv_id") * 100 + C("turn")).alias("query_id"), F.substring("text", 1, 12).alias("query"))
    return G.entity_search(q, triples(s, d)[0].select(F.lower("name").alias("entity"), C("chunk_id").alias("place")))


@add("entity_context", f"""WITH {BASE}, k AS (SELECT lower(name) AS key, count(*) AS mentions FROM e GROUP BY 1), q AS (SELECT conv_id * 100 + turn AS query_id, lower(substr(text, 1, 12)) AS q FROM conversations WHERE conv_id % 20 = 0),
s AS (SELECT query_id, key, mentions, round(len(list_intersect(list_distinct(string_split(q, '')), list_distinct(string_split(key, '')))) / len(list_distinct(list_concat(string_split(q, ''), string_split(key, '')))) + CASE WHEN contains(q, key) OR contains(key, q) THEN 0.5 ELSE 0 END, 6) AS score FROM k, q),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s WHERE score >= 0.1 QUALIFY rank <= 5), x AS (SELECT lower(src) AS src, lower(tgt) AS tgt, src || ' ' || tgt AS place FROM edges WHERE src <> tgt),
l AS (SELECT query_id, rank, '  - ' || src || ' → beside → ' || tgt AS line, row_number() OVER (PARTITION BY query_id, rank ORDER BY place) AS n FROM f JOIN x ON src = key OR tgt = key QUALIFY n <= 5), g AS (SELECT query_id, rank, string_agg(line, chr(10) ORDER BY n) AS lines FROM l GROUP BY ALL)
SELECT query_id, md5('## 知识图谱关联信息' || chr(10) || chr(10) || string_agg('**' || key || '** (出现 ' || mentions || ' 次)' || coalesce(chr(10) || lines, ''), chr(10) ORDER BY rank)) AS context FROM f LEFT JOIN g USING (query_id, rank) GROUP BY query_id""")
def _(s, d):
    e, r = triples(s, d)
    q = table(s, d, "conversations").where("conv_id % 20 = 0").select((C("conv_id") * 100 + C("turn")).alias("query_id"), F.substring("text", 1, 12).alias("query"))
    found = G.entity_search(q, e.select(F.lower("name").alias("entity"), C("chunk_id").alias("place")))
    relations = G.merge_edges(r).select(F.lower("src").alias("src"), F.lower("tgt").alias("tgt"), F.lit("beside").alias("relation"), F.concat_ws(" ", "src", "tgt").alias("place"))
    return G.entity_context(found, relations).withColumn("context", F.md5("context"))


@add("graph_json", "SELECT 'c' || conv_id || ':' || turn AS chunk_id, role AS src, 'turn ' || turn AS tgt, 'in' AS relation FROM conversations WHERE turn % 3 > 0")
def _(s, d):
    body = F.to_json(F.struct(F.array("role").alias("entities"), F.array(F.struct(F.concat(F.lit(" "), "role").alias("source"), F.concat(F.lit("turn "), C("turn").cast("string")).alias("target"), F.lit("in").alias("relation")), F.struct(C("role").alias("source"), F.upper("role").alias("target"), F.lit("is").alias("relation"))).alias("relations")))
    output = F.when(C("turn") % 3 == 0, "{not json}").otherwise(F.concat(F.lit("Here: ```json\n"), body, F.lit("\n```")))
    rows = table(s, d, "conversations").select(F.concat(F.lit("c"), C("conv_id").cast("string"), F.lit(":"), C("turn").cast("string")).alias("chunk_id"), output.alias("output"))
    return G.parse_graph_json(rows)[1].drop("place")


@add("community_reports", f"WITH {BASE}, {LEVELS} SELECT level, cluster, md5('# Cluster ' || cluster || chr(10) || chr(10) || array_to_string(list(name ORDER BY name)[1:20], ', ')) AS report FROM lv GROUP BY level, cluster")
def _(s, d):
    e, r = triples(s, d)
    return G.report_fallback(G.community_schema(levels(s, d), G.merge_entities(e), G.merge_edges(r))).withColumn("report", F.md5("report"))


@add("short_descriptions", f"WITH {BASE} SELECT name, CASE WHEN length(source_id) >= 12 THEN substr(source_id, 1, 12) ELSE source_id END AS description FROM nodes")
def _(s, d):
    return G.merge_entities(triples(s, d)[0]).select("name", G.short_description(C("source_id"), 12).alias("description"))


@add("global_query", f"""WITH {BASE}, {LEVELS}, m AS (SELECT level, cluster, count(DISTINCT c) AS n FROM (SELECT level, cluster, unnest(string_split(source_id, '<SEP>')) AS c FROM lv JOIN nodes USING (name)) GROUP BY ALL),
o AS (SELECT level, cluster, round(n / max(n) OVER (), 6) AS occurrence, repeat(cluster, 9000) AS report FROM m)
SELECT level, cluster, used::BIGINT AS used FROM (SELECT *, sum(length(report) // 4) OVER (ORDER BY level, occurrence DESC, cluster ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT * FROM o ORDER BY level, occurrence DESC, cluster LIMIT 10)) WHERE used <= 12000""")
def _(s, d):
    e, r = triples(s, d)
    c = G.community_schema(levels(s, d), G.merge_entities(e), G.merge_edges(r)).withColumn("report", F.repeat(C("cluster"), 9000))
    return G.global_query(c).select("level", "cluster", "used")


@add("graph_stats", f"WITH {BASE} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM benchmark) AS n_chunks")
def _(s, d):
    e, r = triples(s, d)
    n = G.merge_entities(e).agg(F.count("*").alias("n_nodes"))
    return n.join(G.merge_edges(r).agg(F.count("*").alias("n_edges"))).join(table(s, d, "benchmark").agg(F.count("*").alias("n_chunks")))


@add("extraction_parse", """SELECT 'c' || conv_id || ':' || turn AS chunk_id, '"' || upper(role) || ' & CO"' AS name, '"ROLE"' AS type, '"a speaker"' AS description FROM conversations""")
def _(s, d):
    return G.parse_records(extracted(s, d))[0].select("chunk_id", "name", "type", "description")


@add("extraction_relations", """SELECT 'c' || conv_id || ':' || turn AS chunk_id, '"' || upper(role) || '"' AS src, '"TURN"' AS tgt, CASE WHEN turn % 2 = 0 THEN turn::DOUBLE ELSE 1.0 END AS weight FROM conversations""")
def _(s, d):
    return G.parse_records(extracted(s, d))[1].select("chunk_id", "src", "tgt", "weight")


def extracted(s, d):
    """A model's output for each turn: records of both kinds, one without its quotes, one cut short."""
    weight = F.when(C("turn") % 2 == 0, C("turn").cast("string")).otherwise("strong")
    parts = [F.lit('("entity"<|>"'), C("role"), F.lit(' &amp; co"<|>"role"<|>"a speaker")##(entity<|>"x"<|>"y"<|>"z")##("relationship"<|>"'), C("role"), F.lit('"<|>"turn"<|>"speaks"<|>'), weight, F.lit(')##("entity"<|>"short")<|COMPLETE|>')]
    return table(s, d, "conversations").select(F.concat(F.lit("c"), C("conv_id").cast("string"), F.lit(":"), C("turn").cast("string")).alias("chunk_id"), F.concat(*parts).alias("output"))


def leiden_levels(s, d):
    """The passages' words in communities of at most ten, where they come apart so far."""
    return cut(N.hierarchy(G.merge_edges(triples(s, d)[1]).select("src", "tgt", "weight"), 10), "levels")


@add("leiden_reports", None)
def _(s, d):
    e, r = triples(s, d)
    # a model's stand-in: what it was told, cut short, and its length as a rating
    write = lambda packed: packed.withColumns({"report": F.concat(F.lit("# "), "cluster", F.lit("\n\n"), F.substring("description", 1, 400)), "rating": (F.length("description") % 10).cast("double")})
    made = G.community_reports(leiden_levels(s, d), cut(G.merge_entities(e), "nodes"), cut(G.merge_edges(r), "edges"), write, 2000)
    return made.select("level", "cluster", F.md5("description").alias("description"), F.contains("description", F.lit("importance")).alias("from_below"), F.md5("report").alias("report"), "rating")


@add("report_text", """SELECT conv_id, turn, md5('# ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) || '## ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) || '## ' || text || chr(10) || chr(10)) AS report FROM conversations""")
def _(s, d):
    text = F.to_json(F.struct(C("role").alias("title"), C("text").alias("summary"), F.array(F.to_json(F.struct(C("role").alias("summary"), C("text").alias("explanation"))), C("text")).alias("findings")))
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(G.report_text(text)).alias("report"))
