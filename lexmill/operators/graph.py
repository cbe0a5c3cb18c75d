"""Entity graphs: parsing extraction records, merging, degrees, components, communities, local and global queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.stage import cut

SEP = "<SEP>"
#: What parts records, and fields.
RECORDS, FIELDS = r"##|<\|COMPLETE\|>", r"<\|>"


def clean_field(text: Column) -> Column:
    """HTML entities decoded, blanks at the ends and control characters left out; quotes stay.

    XML's five entities and numbers are decoded; the long list of named letters is not.
    """
    t = T.unescaped(text)
    return F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"[\x00-\x1f\x7f-\x9f]", "")


def parse_records(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (chunk_id, name, type, description) and relations (chunk_id, src, tgt, description, weight) of (chunk_id, output).

    A record stands in parentheses, on one line, and begins with its kind in quotes.  Fields keep their quotes;
    names and types are upper-cased; a weight that is no number is 1.
    """
    pieces = lambda c, by: F.filter(F.transform(F.split(c, by), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = chunks.select("chunk_id", F.explode(pieces(F.col("output"), RECORDS)).alias("record"))
    rows = rows.select("chunk_id", pieces(F.regexp_extract("record", r"\((.*)\)", 1), FIELDS).alias("f"))
    part = lambda i: F.get("f", F.lit(i))
    upper = lambda i: clean_field(F.upper(part(i)))
    entities = rows.where((F.size("f") >= 4) & (part(0) == '"entity"')).select("chunk_id", upper(1).alias("name"), upper(2).alias("type"), clean_field(part(3)).alias("description")).where(F.trim("name") != "")
    last = F.element_at("f", -1)
    weight = F.when(T.is_number(last), last.cast("double")).otherwise(1.0)
    relations = rows.where((F.size("f") >= 5) & (part(0) == '"relationship"')).select("chunk_id", upper(1).alias("src"), upper(2).alias("tgt"), clean_field(part(3)).alias("description"), weight.alias("weight"))
    return entities, relations


def joined_set(c: Column | str) -> Column:
    """Distinct values in order, with the separator between."""
    return F.array_join(F.array_sort(F.collect_set(c)), SEP)


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row a name: the commonest type (the least of equals), sorted distinct descriptions and sources."""
    types = entities.groupBy("name", "type").agg(F.count("*").alias("n")).groupBy("name").agg(F.min(F.struct(-F.col("n"), F.col("type").alias("type"))).alias("t"))
    merged = entities.groupBy("name").agg(joined_set("description").alias("description"), joined_set("chunk_id").alias("source_id"))
    return merged.join(types, "name").select("name", F.col("t.type").alias("type"), "description", "source_id")


def merge_edges(relations: DataFrame) -> DataFrame:
    """One row an undirected pair: summed weight, distinct descriptions and sources."""
    return relations.groupBy(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).agg(F.round(F.sum("weight"), 6).alias("weight"), joined_set("description").alias("description"), joined_set("chunk_id").alias("source_id"))


def with_missing_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with those that only edges name, of unknown type."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("name"), "description", "source_id").groupBy("name").agg(F.min("description").alias("description"), F.min("source_id").alias("source_id"))
    missing = ends.join(nodes.select("name"), "name", "left_anti").select("name", F.lit("UNKNOWN").alias("type"), "description", "source_id")
    return nodes.unionByName(missing)


def degrees(edges: DataFrame) -> DataFrame:
    """(name, degree); a loop counts twice."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    one, two = d.select(F.col("name").alias("src"), F.col("degree").alias("a")), d.select(F.col("name").alias("tgt"), F.col("degree").alias("b"))
    return edges.join(one, "src").join(two, "tgt").withColumn("degree", F.col("a") + F.col("b")).drop("a", "b")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(name, component): the least name reachable.  Labels spread along edges and jump to their label's label.

    Each round is written as a stage, so lineage stays short.  It is an error if the labels have not settled after
    ``rounds`` rounds.
    """
    both = cut(edges.select(F.col("src").alias("name"), F.col("tgt").alias("other")).union(edges.select("tgt", "src")).distinct(), "links")
    labels = both.groupBy("name").agg(F.least(F.min("other"), F.min("name")).alias("component"))
    for _ in range(rounds):
        least = both.join(labels.select(F.col("name").alias("other"), "component"), "other").groupBy("name").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("name").alias("component"), F.col("component").alias("far"))
        new = labels.join(least, "name").join(jump, "component", "left").select("name", F.least("component", "near", F.coalesce("far", "component")).alias("new"), "component")
        new = cut(new, "labels")
        changed = new.where("new <> component").count()
        labels = new.select("name", F.col("new").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"components: labels have not settled after {rounds} rounds")


def largest_component(edges: DataFrame) -> DataFrame:
    """(name, node): the nodes of the component with the most of them (the least label among equals), ``node`` upper-cased, decoded and trimmed."""
    labels = components(edges)
    best = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "component").limit(1)
    return labels.join(F.broadcast(best), "component").select("name", T.unescaped(F.trim(F.upper("name"))).alias("node"))


def community_schema(clusters: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per (level, cluster): sorted nodes, incident edges, chunks, and occurrence: its chunks over the most chunks of any."""
    members = clusters.join(nodes.select("name", "source_id"), "name")
    held = members.groupBy("level", "cluster").agg(F.array_sort(F.collect_set("name")).alias("nodes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("source_id", SEP))))).alias("chunk_ids"))
    ends = edges.select("src", "tgt", F.explode(F.array_distinct(F.array("src", "tgt"))).alias("name")).join(clusters, "name")
    incident = ends.groupBy("level", "cluster").agg(F.array_sort(F.collect_set(F.concat_ws("|", "src", "tgt"))).alias("edges"))
    most = held.agg(F.max(F.size("chunk_ids")).alias("most"))
    return held.join(incident, ["level", "cluster"], "left").join(F.broadcast(most)).withColumn("occurrence", F.round(F.size("chunk_ids") / F.col("most"), 6)).drop("most")


def sub_communities(schema: DataFrame) -> DataFrame:
    """(level, cluster, child): clusters of the next level whose nodes are all in the cluster.  Joined by a shared node."""
    up = schema.select("level", "cluster", "nodes", F.explode("nodes").alias("node"))
    down = schema.select((F.col("level") - 1).alias("level"), F.col("cluster").alias("child"), F.col("nodes").alias("inner"), F.col("nodes")[0].alias("node"))
    return up.join(down, ["level", "node"]).where(F.size(F.array_except("inner", "nodes")) == 0).select("level", "cluster", "child").distinct()


def community_vote(hits: DataFrame, clusters: DataFrame, level: int = 2, ratings: DataFrame | None = None) -> DataFrame:
    """(query_id, cluster, votes, rank): clusters of the hit nodes up to a level, by how many they hold, then by rating (cluster, rating), then by name."""
    votes = hits.join(clusters.where(F.col("level") <= level), "name").groupBy("query_id", "cluster").agg(F.count("*").alias("votes"))
    rated = votes.join(ratings.select("cluster", "rating"), "cluster", "left") if ratings is not None else votes.withColumn("rating", F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.col("votes").desc(), F.coalesce("rating", F.lit(-1.0)).desc(), "cluster")
    return rated.withColumn("rank", F.row_number().over(order)).select("query_id", "cluster", "votes", "rank")


def one_hop(hits: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, chunk_id, order, relations, rank): source chunks of hit nodes (query_id, name, place).

    ``order`` is the place of the first hit node that has the chunk; ``relations`` counts that node's edges whose
    other end has it too.  Rank by order, then more relations, then the chunk's id.
    """
    both = edges.select(F.col("src").alias("name"), F.col("tgt").alias("other")).union(edges.where("src <> tgt").select("tgt", "src"))
    chunks = nodes.select("name", F.explode(F.split("source_id", SEP)).alias("chunk_id")).where("chunk_id <> ''")
    own = hits.join(chunks, "name").groupBy("query_id", "chunk_id").agg(F.min(F.struct("place", "name")).alias("first"))
    own = own.select("query_id", "chunk_id", F.col("first.place").alias("order"), F.col("first.name").alias("name"))
    far = chunks.withColumnRenamed("name", "other")
    n = own.join(both, "name").join(far, ["other", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("relations"))
    rows = own.join(n, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "order", F.coalesce("relations", F.lit(0)).alias("relations"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("order", F.col("relations").desc(), "chunk_id")))


def global_query(schema: DataFrame, level: int = 2, most: int = 10, budget: int = 12_000) -> DataFrame:
    """Communities by level, then occurrence: the first ``most`` whose reports (length // 4) stay within the budget."""
    order = [F.col("level"), F.col("occurrence").desc(), F.col("cluster")]
    top = schema.where(F.col("level") <= level).orderBy(*order).limit(most)
    used = F.sum(F.floor(F.length("report") / 4)).over(Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("used", used).where(F.col("used") <= budget)


def csv_section(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, ",\t")), "\n")


def within(rows: DataFrame, by: list[str], order: list[Column | str], size: Column, budget: Column | int) -> DataFrame:
    """The first rows of each group whose sizes come to the budget at most, with their ``place`` from 0; what comes after one that does not fit is left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"place": F.row_number().over(w) - 1, "used": used}).where(F.col("used") <= budget).drop("used")


def _table(rows: DataFrame, by: list[str], header: list[str], fields: list[Column | str], out: str) -> DataFrame:
    """One CSV text a group of rows with a ``place``."""
    line = F.array_join(F.array(*[(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]), ",\t", "")
    made = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return made.select(*by, F.concat_ws("\n", F.lit(",\t".join(header)), F.array_join("l.line", "\n")).alias(out))


def packed_communities(clusters: DataFrame, nodes: DataFrame, edges: DataFrame, reports: DataFrame | None = None, budget: int = 12_000) -> DataFrame:
    """(level, cluster, description): a community's entities and relations as CSV, those of highest degree first, half the budget of characters each.

    Where that cuts something off and the community's sub-communities have ``reports`` (level, cluster, child, report,
    rating, occurrence, names array), these come first, most frequent first, as the budget allows; what they hold goes behind
    the rest.
    """
    by = ["level", "cluster"]
    inner = clusters.join(nodes, "name").join(degrees(edges), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    inner = inner.withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy("name")) - 1)
    ends = edge_degrees(edges).select("src", "tgt", "description", "degree", F.explode(F.array_distinct(F.array("src", "tgt"))).alias("name"))
    linked = ends.join(clusters, "name").select(*by, "src", "tgt", "description", "degree").distinct()
    linked = linked.withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy(F.concat("src", "tgt"), "src")) - 1)
    half = F.lit(budget // 2)
    size = F.length("description")
    total = lambda rows: rows.groupBy(*by).agg((F.sum(size) > half).alias("cut"))
    if reports is None:
        room, told = inner.select(*by).distinct().withColumns({"room": half, "held": F.array().cast("array<string>")}), None
    else:
        cut = total(inner).union(total(linked)).groupBy(*by).agg(F.max("cut").alias("cut")).where("cut")
        used = within(reports.join(cut.select(*by), by), by, [F.col("occurrence").desc(), "child"], F.length("report"), budget)
        told = _table(used, by, ["id", "report", "rating", "importance"], ["place", "report", F.coalesce("rating", F.lit(-1.0)), "occurrence"], "told")
        held = used.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("held")).join(told, by)
        room = inner.select(*by).distinct().join(held, by, "left").select(*by, F.coalesce(F.floor((budget - F.length("told")) / 2), half).alias("room"), F.coalesce("held", F.array().cast("array<string>")).alias("held"))
    last = [F.col("degree").desc(), "id"]
    some = inner.join(room, by).withColumn("again", F.array_contains("held", F.col("name")))
    entities = _table(within(some, by, ["again", *last], size, F.col("room")), by, ["id", "entity", "type", "description", "degree"], ["id", "name", "type", "description", "degree"], "entities")
    some = linked.join(room, by).withColumn("again", F.array_contains("held", F.col("src")) & F.array_contains("held", F.col("tgt")))
    relations = _table(within(some, by, ["again", *last], size, F.col("room")), by, ["id", "source", "target", "description", "rank"], ["id", "src", "tgt", "description", "degree"], "relations")
    rows = inner.select(*by).distinct().join(entities, by, "left").join(relations, by, "left")
    rows = rows.join(told, by, "left") if told is not None else rows.withColumn("told", F.lit(""))
    return rows.select(*by, sections({"Reports": F.col("told"), "Entities": F.col("entities"), "Relationships": F.col("relations")}).alias("description"))


def sections(parts: dict[str, Column]) -> Column:
    """Named CSV blocks one after the other."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"-----{name}-----\n```csv\n"), F.coalesce(text, F.lit("")), F.lit("\n```")) for name, text in parts.items()])


def related_edges(hits: DataFrame, edges: DataFrame, budget: int = 4800) -> DataFrame:
    """(query_id, place, src, tgt, description, weight, degree): edges of the hit nodes by degree and weight, as the budget of characters allows."""
    ends = edge_degrees(edges).withColumn("name", F.explode(F.array_distinct(F.array("src", "tgt"))))
    near = hits.select("query_id", "name").join(ends, "name").select("query_id", "src", "tgt", "description", "weight", "degree").distinct()
    return within(near, ["query_id"], [F.col("degree").desc(), F.col("weight").desc(), "src", "tgt"], F.length("description"), budget)


def local_query(hits: DataFrame, nodes: DataFrame, edges: DataFrame, clusters: DataFrame, reports: DataFrame, chunks: DataFrame, level: int = 2, budgets: tuple[int, int, int] = (3200, 4800, 4000)) -> DataFrame:
    """(query_id, context) of entity hits (query_id, name, place): community reports (cluster, report, rating), entities, relations, and source chunks (chunk_id, text).

    ``budgets`` are characters of reports, relations and chunks.
    """
    by = ["query_id"]
    known = hits.join(nodes, "name").join(degrees(edges), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    entities = _table(known, by, ["id", "entity", "type", "description", "rank"], ["place", "name", "type", "description", "degree"], "entities")
    votes = community_vote(known.select("query_id", "name"), clusters, level, reports).join(reports, "cluster")
    told = _table(within(votes, by, ["rank"], F.length("report"), budgets[0]), by, ["id", "content"], ["place", "report"], "told")
    linked = _table(related_edges(known, edges, budgets[1]), by, ["id", "source", "target", "description", "weight", "rank"], ["place", "src", "tgt", "description", "weight", "degree"], "linked")
    units = one_hop(known.select("query_id", "name", "place"), edges, nodes).join(chunks.select("chunk_id", "text"), "chunk_id")
    sources = _table(within(units, by, ["rank"], F.length("text"), budgets[2]), by, ["id", "content"], ["place", "text"], "sources")
    rows = known.select(*by).distinct()
    for t in (told, entities, linked, sources):
        rows = rows.join(t, by, "left")
    return rows.select(*by, sections({"Reports": F.col("told"), "Entities": F.col("entities"), "Relationships": F.col("linked"), "Sources": F.col("sources")}).alias("context"))


def hybrid_context(local: DataFrame, world: Column) -> DataFrame:
    """Contexts of both kinds for each query, the local one first."""
    return local.withColumn("context", F.concat_ws("\n\n", "context", world))


#: Entities of a block, and queries of a block; a task holds one of each.
ENTITIES, ASKED = 2048, 512


def _shared_letters(names: list[str], asked: list[str]) -> np.ndarray:
    """Jaccard similarity of the characters of each question (rows) and name (columns), half a point more where one holds the other."""
    number: dict[str, int] = {}
    sets = [[number.setdefault(c, len(number)) for c in set(t)] for t in (*asked, *names)]
    held = np.zeros((len(sets), max(len(number), 1)), np.float32)
    for i, s in enumerate(sets):
        held[i, s] = 1
    q, n = held[: len(asked)], held[len(asked) :]
    both = q @ n.T
    sizes_q, sizes_n = q.sum(axis=1)[:, None], n.sum(axis=1)
    either = sizes_q + sizes_n - both
    out = np.divide(both, either, out=np.zeros(both.shape), where=either > 0)
    # what holds another has all its characters
    for i, j in zip(*np.nonzero((both == sizes_q) | (both == sizes_n))):
        if names[j] in asked[i] or asked[i] in names[j]:
            out[i, j] += 0.5
    return out


def entity_search(queries: DataFrame, mentions: DataFrame, top: int = 5, least: float = 0.1) -> DataFrame:
    """(query_id, entity, mentions, score, rank) for (query_id, query): entities by the likeness of their letters to the query's, half a point more if one holds the other.

    ``mentions`` has one row (entity, place) for each mention; letter case is ignored and the first spelling stands.
    Blocks of queries meet blocks of entities, and each pair of blocks passes on the best of its queries alone.
    """
    key = F.lower(F.trim("entity"))
    known = mentions.where(key != "").groupBy(key.alias("key")).agg(F.count("*").alias("mentions"), F.min_by(F.trim("entity"), "place").alias("entity"))
    asked = cut(queries.select("query_id", F.lower("query").alias("q")).where("q is not null"), "asked")
    kind = queries.schema["query_id"].dataType.simpleString()
    parts = max(1, -(-asked.count() // ASKED))
    blocks = asked.groupBy(F.pmod(F.xxhash64("query_id", "q"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
    names = cut(known, "entities")
    count = max(1, -(-names.count() // ENTITIES))
    held = names.groupBy(F.pmod(F.xxhash64("key"), F.lit(count)).alias("block")).agg(F.collect_list("key").alias("keys"))
    pairs = held.select("keys", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).join(blocks, "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, some in zip(pdf["keys"], pdf["asked"]):
                keys = list(keys)
                score = _shared_letters(keys, [r["q"] for r in some])
                rows = []
                for i, r in enumerate(some):
                    # scores are rounded later, so what is as good as equal stays
                    kth = np.partition(score[i], -top)[-top] if len(keys) > top else 0.0
                    near = np.flatnonzero((score[i] >= least - 1e-6) & (score[i] >= kth - 1e-6))
                    rows += [(r["query_id"], keys[j], float(score[i, j])) for j in near.tolist()]
                yield pd.DataFrame(rows, columns=["query_id", "key", "score"])

    scored = pairs.mapInPandas(run, f"query_id {kind}, key string, score double").withColumn("score", F.round("score", 6)).where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(names, "key").select("query_id", "entity", "mentions", "score", "rank")


def entity_context(found: DataFrame, relations: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, context) of ``entity_search`` rows: each entity with its first relations (src, tgt, relation, place), those of either end."""
    key = lambda c: F.lower(F.trim(c))
    ends = relations.where(key("src") != key("tgt")).select("src", "tgt", "relation", "place", F.explode(F.array_distinct(F.array(key("src"), key("tgt")))).alias("key"))
    near = found.select("query_id", "rank", key("entity").alias("key")).join(ends, "key")
    n = F.row_number().over(Window.partitionBy("query_id", "rank").orderBy("place"))
    line = F.concat(F.lit("  - "), F.trim("src"), F.lit(" → "), "relation", F.lit(" → "), F.trim("tgt"))
    lines = near.withColumn("n", n).where(F.col("n") <= most).groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    head = F.format_string("**%s** (出现 %d 次)", "entity", "mentions")
    block = F.concat_ws("\n", head, F.nullif(F.array_join("l.line", "\n"), F.lit("")))
    made = found.join(lines, ["query_id", "rank"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return made.select("query_id", F.concat(F.lit("## 知识图谱关联信息\n\n"), F.array_join("b.block", "\n")).alias("context"))


def parse_graph_json(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (chunk_id, name, place) and relations (chunk_id, src, tgt, relation, place) of (chunk_id, output), where the output holds a JSON object of both.

    What does not parse gives none; names are trimmed, blank ones and relations to oneself left out.
    """
    schema = "entities array<string>, relations array<struct<source:string,target:string,relation:string>>"
    body = F.from_json(F.regexp_extract("output", r"(?s)(\{.*\})", 1), schema)
    rows = replies.select("chunk_id", body.alias("j"))
    names = rows.select("chunk_id", F.posexplode("j.entities").alias("place", "name")).select("chunk_id", F.trim("name").alias("name"), "place").where("name <> ''")
    found = rows.select("chunk_id", F.posexplode("j.relations").alias("place", "r")).select("chunk_id", F.trim("r.source").alias("src"), F.trim("r.target").alias("tgt"), "r.relation", "place")
    return names, found.where("src <> '' and tgt <> '' and lower(src) <> lower(tgt)")


def short_description(description: Column, most: int = 500) -> Column:
    """Where no model sums up: the first ``most`` characters of merged descriptions."""
    return F.when(F.length(description) >= most, F.substring(description, 1, most)).otherwise(description)


def report_fallback(schema: DataFrame, most: int = 20) -> DataFrame:
    """(level, cluster, report): where no model writes one, a community's title and its first members by name."""
    names = F.array_join(F.slice("nodes", 1, most), ", ")
    return schema.select("level", "cluster", F.concat(F.lit("# Cluster "), "cluster", F.lit("\n\n"), names).alias("report"))


def report_text(reply: Column) -> Column:
    """Markdown of a model's report (JSON of title, summary and findings, these texts or pairs of summary and explanation); null where it does not parse."""
    outer = F.from_json(reply, "title string, summary string, findings array<string>")
    finding = lambda f: F.from_json(f, "summary string, explanation string")
    told = lambda f: F.when(F.startswith(F.ltrim(f), F.lit("{")), F.concat(F.lit("## "), F.coalesce(finding(f)["summary"], F.lit("")), F.lit("\n\n"), F.coalesce(finding(f)["explanation"], F.lit("")))).otherwise(F.concat(F.lit("## "), f, F.lit("\n\n")))
    findings = F.array_join(F.transform(F.coalesce(outer["findings"], F.array().cast("array<string>")), told), "\n\n")
    return F.when(outer.isNotNull(), F.concat(F.lit("# "), F.coalesce(outer["title"], F.lit("Report")), F.lit("\n\n"), F.coalesce(outer["summary"], F.lit("")), F.lit("\n\n"), findings))


def community_reports(clusters: DataFrame, nodes: DataFrame, edges: DataFrame, write: Callable[[DataFrame], DataFrame] | None = None, budget: int = 12_000) -> DataFrame:
    """(level, cluster, description, report, rating): reports level by level from the deepest, each level told with the reports of the communities below it.

    ``write`` gives (level, cluster, description) a ``report`` and a ``rating``, as from a model; without it a report is a
    title and the first names.  ``clusters`` has name, level, cluster; levels are few, and each is written as a stage.
    """
    schema = cut(community_schema(clusters, nodes, edges), "schema")
    below = cut(sub_communities(schema), "below")
    out = told = None
    for level in sorted((r["level"] for r in schema.select("level").distinct().collect()), reverse=True):
        reports = None
        if told is not None:
            pairs = below.where(F.col("level") == level)
            reports = pairs.join(told.select(F.col("cluster").alias("child"), "report", "rating", "occurrence", "names"), "child").select("level", "cluster", "child", "report", "rating", "occurrence", "names")
        packed = packed_communities(clusters.where(F.col("level") == level), nodes, edges, reports, budget)
        if write is None:
            made = packed.join(report_fallback(schema), ["level", "cluster"]).withColumn("rating", F.lit(None).cast("double"))
        else:
            made = write(packed)
        told = cut(made.select("level", "cluster", "description", "report", "rating").join(schema.select("level", "cluster", "occurrence", F.col("nodes").alias("names")), ["level", "cluster"]), "reports")
        out = told if out is None else out.unionByName(told)
    return out.drop("occurrence", "names") if out is not None else clusters.sparkSession.createDataFrame([], "level int, cluster string, description string, report string, rating double")
