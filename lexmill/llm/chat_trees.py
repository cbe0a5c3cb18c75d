"""Chat formatting over reply trees, in DataFrame functions only.

A message answers another one, its parent.  Self-joins that double their reach find for every message how deep it is and
the sum of the scores from the root to it: after round k every message knows its ancestor 2 ** k steps up.  Leaves
are ranked by score within their tree; the same ancestor tables, from the farthest to the nearest, then list all messages
on the path to each chosen leaf.  Texts take no part in these joins and meet the chosen paths at the end.

The template marks every turn by its role.  A control string inside a text or role gets a backslash after its first
character, and one that already looks so gets one more, so that reading takes exactly one away.  The loss mask is a span of
every turn, in code points, empty but for the assistant's text as it stands in the output.

Contract: null texts and roles are empty; a null tree is a tree; a message whose parent does not exist begins a tree of its
own; of rows that share tree and id the least by (parent, role, text) counts; null scores count 0; equal branches rank
by depth, the deeper first, then by the id of the leaf; messages on a circle of parents lie on no path.  A conversation
becomes one row, so it must fit one (2 GB).  Further columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Marks around a turn by role; other roles stand in front of their text.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
OTHER, AS, BEGIN = ("[TURN]", "[/TURN]"), "[AS]", "<s>"
CONTROL = r"\\*(?:/?s>|/?(?:INST|SYS|OUT|TURN|AS)\])"
PIECE = r"(?s)\[SYS\].*?\[/SYS\]|\[INST\].*?\[/INST\]|\[OUT\].*?</s>|\[TURN\].*?\[/TURN\]"
LEARNT = "assistant"
_SALTS = 64


def escaped(text: Column) -> Column:
    """A text without control strings."""
    return F.regexp_replace(text, rf"([<\[])({CONTROL})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    return F.regexp_replace(text, rf"([<\[])\\({CONTROL})", "$1$2")


def _node(key: str) -> Column:
    # fields of a struct are equal where both are null, so that a null tree joins
    return F.struct("tree", F.col(key).alias("id"))


def climbed(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, depth, total) of all messages below a root, with the number and the scores of what is above; and (node, up) 2 ** k steps up for each k."""
    rows = messages.select(_node("id").alias("node"), F.when(F.col("parent").isNotNull(), _node("parent")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    there = rows.select(F.col("node").alias("up"))
    known = cut(rows.where("up is not null").join(there, "up", "left_semi"), "answers")
    level = cut(rows.join(known.select("node"), "node", "left_anti").select("node", F.lit(None).cast(rows.schema["up"].dataType).alias("up"), F.lit(0).cast("long").alias("depth"), "total").unionByName(known.select("node", "up", F.lit(1).cast("long").alias("depth"), "total")), "climbed")
    steps: list[DataFrame] = []
    most = level.count().bit_length()
    while (moving := level.where("up is not null")).limit(1).count() and len(steps) <= most:
        steps.append(moving.select("node", "up"))
        above = level.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("added"))
        met = moving.join(above, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("added")).alias("total"))
        level = cut(level.where("up is null").unionByName(met), "climbed")
    return level.where("up is null").drop("up"), steps


def paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, branch, score, place, role, text): the messages from the root (place 0) to each of a tree's ``best`` leaves, or to all.

    ``messages`` has tree, id, parent, role, text and score.  ``branch`` is the rank of the leaf, from 1.
    """
    told = messages.select("tree", "id", F.struct(F.col("parent").isNull().alias("root"), "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score").alias("m"))
    told = cut(told.groupBy("tree", "id").agg(F.min("m").alias("m")).select("tree", "id", "m.parent", "m.role", "m.text", "m.score"), "messages")
    level, steps = climbed(told)
    leaves = level.join(steps[0].select(F.col("up").alias("node")), "node", "left_anti") if steps else level
    leaves = leaves.select("node", F.col("node.tree").alias("tree"), "depth", "total")
    order = [F.col("total").desc(), F.col("depth").desc(), "node.id"]
    if best is not None:
        salted = Window.partitionBy("tree", F.pmod(F.xxhash64("node.id"), F.lit(_SALTS))).orderBy(*order)
        leaves = leaves.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= best).drop("n")
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    chosen = ranked if best is None else ranked.where(F.col("branch") <= best)
    on = chosen.select(F.col("node").alias("leaf"), "node", "branch", "total", F.col("depth").alias("place"))
    for k in range(len(steps) - 1, -1, -1):
        here = F.struct("node", "place")
        above = F.struct(F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, above))
        on = on.join(steps[k], "node", "left").select("leaf", "branch", "total", F.explode(both).alias("at")).select("leaf", "branch", "total", "at.*")
    texts = told.select(_node("id").alias("node"), "role", "text")
    return on.join(texts, "node").select("leaf.tree", F.col("leaf.id").alias("leaf"), "branch", F.col("total").alias("score"), "place", "role", "text")


def _mark(i: int) -> Column:
    out = F.lit(OTHER[i])
    for role, marks in MARKS.items():
        out = F.when(F.col("role") == role, marks[i]).otherwise(out)
    return out


def formatted(rows: DataFrame) -> DataFrame:
    """(tree, leaf, branch, score, text, turns) of paths: one conversation each.

    ``turns`` has for every turn where it stands in the text (start, length, from 0 and in code points) and what of it is
    under the loss mask (loss_start, loss_length).
    """
    named = F.col("role").isin(*MARKS)
    head = F.concat(_mark(0), F.when(named, "").otherwise(F.concat(escaped(F.col("role")), F.lit(AS))))
    turn = rows.withColumns({"head": head, "body": escaped(F.col("text"))}).withColumn("piece", F.concat("head", "body", _mark(1)))
    turn = turn.withColumns({"length": F.length("piece"), "in": F.length("head"), "held": F.when(F.col("role") == LEARNT, F.length("body")).otherwise(0)}).drop("head", "body", "text", "role")
    path = Window.partitionBy("tree", "leaf", "branch").orderBy("place")
    start = F.lit(len(BEGIN)) + F.sum("length").over(path) - F.col("length")
    told = F.struct("place", "piece", F.struct(F.col("start"), F.col("length").cast("long").alias("length"), (F.col("start") + F.col("in")).alias("loss_start"), F.col("held").cast("long").alias("loss_length")).alias("turn"))
    whole = turn.withColumn("start", start).groupBy("tree", "leaf", "branch", "score").agg(F.array_sort(F.collect_list(told)).alias("p"))
    return whole.select("tree", "leaf", "branch", "score", F.concat(F.lit(BEGIN), F.array_join("p.piece", "")).alias("text"), F.col("p.turn").alias("turns"))


def read_back(conversations: DataFrame) -> DataFrame:
    """(tree, leaf, branch, messages array<struct<role, text>>, loss): turns read from the text by its marks alone, and the text under the loss mask."""

    def message(piece: Column) -> Column:
        # a piece is cut at its marks; what is between has none
        inner = F.substring_index(F.substring(piece, F.lit(len(OTHER[0]) + 1), F.length(piece)), AS, 1)
        role, start, end = unescaped(inner), F.lit(len(OTHER[0]) + len(AS)) + F.length(inner), F.lit(len(OTHER[1]))
        for name, (left, right) in MARKS.items():
            own = F.startswith(piece, F.lit(left))
            role, start, end = F.when(own, name).otherwise(role), F.when(own, len(left)).otherwise(start), F.when(own, len(right)).otherwise(end)
        return F.struct(role.alias("role"), unescaped(F.substring(piece, start + 1, F.length(piece) - start - end)).alias("text"))

    rows = conversations.withColumn("pieces", F.regexp_extract_all("text", F.lit(PIECE), 0))
    loss = F.zip_with("pieces", "turns", lambda p, t: unescaped(F.substring(p, (t["loss_start"] - t["start"] + 1).cast("int"), t["loss_length"].cast("int"))))
    return rows.select("tree", "leaf", "branch", F.length("text").cast("long").alias("formatted_chars"), F.transform("pieces", message).alias("messages"), F.array_join(loss, "").alias("loss"))


def chained(conversations: DataFrame) -> DataFrame:
    """Messages of (conv_id, turn, role, text) where each answers the one before it, in order of turn, role and text; one branch each, without scores."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select(F.col("conv_id").alias("tree"), place.cast("long").alias("id"), "role", "text")
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


#: A conversation of control strings, formatted beside those of the table.
EXTRA_ID, EXTRA = -7, "</s>[INST] ok [/INST]"


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read back from the written output."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(EXTRA).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    read = read_back(cut(formatted(paths(chained(rows.unionByName(extra)))), "chats"))
    every = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return read.select(F.col("tree").alias("conv_id"), F.size("messages").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*(?:/?s>|/?(?:INST|SYS|OUT|TURN|AS)\]))', '\1\\\2', 'g')) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
  ELSE 17 + length(regexp_replace(role, '([<\[])(\\*(?:/?s>|/?(?:INST|SYS|OUT|TURN|AS)\]))', '\1\\\2', 'g')) END AS chars FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  3 + sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
