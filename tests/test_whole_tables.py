"""Queries without SQL, over whole tables, against plain versions."""

import hashlib
import re

from lexmill import registry
from lexmill.functions import markup as M
from lexmill.plans import context_queries, question_queries
from lexmill.sources.tables import table

DIR = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_markdown_text(spark):
    got = {r["doc_id"]: r["text"] for r in registry.queries()["markdown_text"](spark, DIR).collect()}
    rows = table(spark, DIR, "documents").select("doc_id", question_queries.marked().alias("t")).collect()
    assert any(re.search("[*_]", r["t"].split("third\n", 1)[1]) for r in rows)
    for r in rows:
        text = r["t"]
        for pattern, by in M.MARKDOWN:
            text = re.sub(pattern, by.replace("$1", r"\1"), text, flags=re.ASCII)
        assert got[r["doc_id"]] == md5(re.sub(r"^\s+|\s+$", "", text)), r["doc_id"]


def tokens(text):
    text = text.strip()
    plain = sum(c < "\x80" for c in text)
    return max(1, int(plain / 3.5 + (len(text) - plain) * 1.1))


def test_embedding_batches(spark):
    want, by = {}, {}
    for r in table(spark, DIR, "conversations").orderBy("conv_id", "turn").collect():
        n, text = tokens(r["text"]), r["text"]
        if n > 100:  # the longest beginning that fits, found the slow way
            n = max(tokens(text[:i]) for i in range(1, len(text) + 1) if tokens(text[:i]) <= 100)
        batch, used = by.get(r["conv_id"], (0, 0))
        if used and used + n > 100:
            batch, used = batch + 1, 0
        by[r["conv_id"]] = (batch, used + n)
        want[r["conv_id"], r["turn"]] = (n, batch)
    got = {(r["conv_id"], r["turn"]): (r["tokens"], r["batch"]) for r in registry.queries()["embedding_batches"](spark, DIR).collect()}
    assert got == want and any(n == 100 for n, _ in want.values())


def plain_citations(reply):
    """Blocks begin at their number; a block ends after its second phrase, and phrases outside of any block make one without a number."""
    events = []
    for line in (x.strip() for x in reply.split("\n")):
        m = re.match(r"(?i)citation[【\[](\d+)[】\]]", line)
        if m:
            events.append(("n", int(m[1])))
        for i, mark in enumerate(("start_phrase:", "end_phrase:")):
            if not m and line.lower().startswith(mark):
                events.append((i, line[len(mark) :].strip()))
    out, block = [], None
    for kind, value in [*events, ("n", None)]:
        if kind == "n":
            if block:
                out.append(tuple(block))
            block = [value, None, None] if value is not None else None
        else:
            block = block or [None, None, None]
            block[kind + 1] = value
            if block[1] and block[2]:
                out.append(tuple(block))
                block = None
    return out


def test_citation_list(spark):
    got = {}
    for r in registry.queries()["citation_list"](spark, DIR).orderBy("answer_id", "place").collect():
        got.setdefault(r["answer_id"], []).append((r["ref"], r["start_phrase"], r["end_phrase"]))
    for r in context_queries.replies(spark, DIR).collect():
        assert got.get(r["answer_id"], []) == plain_citations(r["text"]), r["text"][:200]


def test_components_of_all_passages(spark):
    rows = registry.queries()["components"](spark, DIR).collect()
    assert min(len(r["name"]) for r in rows) <= 6
