"""Splitting texts: structure-aware chunks, sentence windows, pseudo pages, neighbours, parents, token windows.

Sequential packing has state that a window cannot reset, so it runs per document in Arrow batches; a document
is one row, so no group is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.rows import per_row

#: Chunk size and overlap, and the bounds that a model's input sets them.
DEFAULT_SIZE, DEFAULT_OVERLAP = 1200, 200
LEAST_ROOM, MOST_SIZE = 128, 2500
#: What a heading looks like, and spans that are never cut.
MARKED_HEADING = re.compile(r"#{1,6}\s+\S|\d+(?:\.\d+)*\.?\s+\S")
PROTECTED = [re.compile(r"(?m)(?:^[ \t]*\|.+\|[ \t]*$\n?){2,}"), re.compile(r"\$\$[\s\S]+?\$\$"), re.compile(r"\\\[[\s\S]+?\\\]")]


def chunk_params(max_tokens: Column, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> tuple[Column, Column]:
    """Chunk size and overlap for a model's input of so many tokens (null: not known).

    The size is at most three fifths of the input, but 128 at least; a fifth of the input, from 200 to 1000, is
    its floor as far as that room allows.  The overlap is 15 % of the size at least and 25 % at most.
    """
    room = F.greatest(F.lit(LEAST_ROOM), F.floor(max_tokens * 0.6))
    floor = F.least(F.lit(1000), F.greatest(F.lit(200), F.floor(max_tokens * 0.2)))
    chunk = F.when(max_tokens.isNull() | (max_tokens == 0), F.lit(size)).otherwise(F.least(F.greatest(floor, F.least(F.lit(size), room, F.lit(MOST_SIZE))), room))
    share = lambda x: F.floor(chunk * x)
    return chunk.cast("int"), F.least(F.greatest(F.lit(overlap), share(0.15)), share(0.25)).cast("int")


def is_heading(line: str) -> bool:
    """A Markdown or numbered heading of any length, or a line of under 100 characters whose ASCII letters (two at least) are capitals."""
    line = line.strip()
    letters = "".join(c for c in line if c.isascii() and c.isalpha())
    return bool(line) and (bool(MARKED_HEADING.match(line)) or (len(letters) >= 2 and letters.isupper() and len(line) < 100))


def protected_regions(text: str) -> list[tuple[int, int]]:
    """Spans that are never cut: two or more lines that begin and end with a pipe, $$ formulas and bracketed formulas; those that overlap or touch merged."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted((m.span() for p in PROTECTED for m in p.finditer(text)), key=lambda s: s[0]):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def headed(text: str) -> list[tuple[str, bool, str]]:
    """Pieces of plain text, each begun by a heading and named by it; without headings its paragraphs, unnamed."""
    cuts: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        found = is_heading(line)
        if found and cuts[-1][1]:
            cuts.append((line.strip(), []))
        elif found and not cuts[-1][0]:
            cuts[-1] = (line.strip(), cuts[-1][1])
        cuts[-1][1].append(line)
    out = [(piece, False, name) for name, lines in cuts if (piece := "\n".join(lines).strip())]
    if len(out) > 1:
        return out
    return [(p.strip(), False, "") for p in re.split(r"\n\n+", text) if p.strip()]


def segments(text: str) -> list[tuple[str, bool, str]]:
    """(text, protected, heading) pieces in order: protected spans as they are, the rest cut at headings or blank lines."""
    out: list[tuple[str, bool, str]] = []
    at = 0
    for a, b in [*protected_regions(text), (len(text), len(text))]:
        out += headed(text[at:a])
        if text[a:b].strip():
            out.append((text[a:b].strip(), True, ""))
        at = b
    return out


def overlap_tail(parts: list[str], size: int) -> list[str]:
    """The last pieces, the last one whatever its length, the others while they come to ``size`` characters at most."""
    out: list[str] = []
    for piece in reversed(parts) if size > 0 else []:
        if out and sum(map(len, out)) + len(piece) > size:
            break
        out.insert(0, piece)
    return out


def packed(parts: list[tuple[str, bool, str]], size: int, overlap: int = 0) -> list[tuple[str, str]]:
    """(chunk, heading): pieces joined by blank lines while they fit.

    Every piece is taken to need two characters more.  A plain piece longer than ``size`` stays whole; a protected one
    is a chunk of its own.  A protected piece that joins a chunk adds two characters even to an empty one; a chunk closed
    by overflow carries the heading of the piece that closed it.  ``overlap`` takes ``overlap_tail`` of the chunk before
    where plain text overflows (0: none, the default of the pipelines).
    """
    chunks: list[tuple[str, str]] = []
    held: list[str] = []
    length, heading = 0, ""

    def close() -> list[str]:
        nonlocal held, length
        before, held, length = held, [], 0
        if before:
            chunks.append(("\n\n".join(before), heading))
        return before

    for piece, protected, name in parts:
        heading = name or heading
        if protected and len(piece) > size:
            close()
            chunks.append((piece, heading))
            continue
        if length + len(piece) + 2 > size and (held or protected):
            before = close()
            if protected:
                held, length = [piece], len(piece)
                continue
            held = overlap_tail(before, overlap)
            length = sum(map(len, held)) + 2 * max(len(held) - 1, 0)
        held.append(piece)
        length += len(piece) + (2 if protected or len(held) > 1 else 0)
    close()
    return [c for c in chunks if c[0].strip()]


def _per_text(df: DataFrame, key: str, fields: str, make: Callable[[str], Iterable[tuple]]) -> DataFrame:
    return per_row(df, [key], ["text"], fields, make, "chunk_idx")


def structure_split(docs: DataFrame, size: int = DEFAULT_SIZE, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    """(key, chunk_idx, chunk, heading) of each document."""
    return _per_text(docs, key, "chunk string, heading string", lambda t: packed(segments(t), size, overlap))


def pages_of(text: str, size: int = 3000) -> list[str]:
    """Paragraphs packed greedily into pages of about ``size`` characters, two more for each; an empty text is one empty page."""
    pages, page = [], ""
    for paragraph in text.split("\n\n"):
        if page and len(page) + len(paragraph) > size:
            pages.append(page.strip())
            page = ""
        page += paragraph + "\n\n"
    if page.strip():
        pages.append(page.strip())
    return pages or [text]


def pseudo_pages(docs: DataFrame, size: int = 3000, key: str = "doc_id") -> DataFrame:
    """(key, page, content): paragraphs, between blank lines, packed greedily into pages of about ``size`` characters."""
    return _per_text(docs, key, "content string", lambda t: [(p,) for p in pages_of(t, size)]).select(key, (F.col("chunk_idx") + 1).alias("page"), "content")


def sentence_windows(docs: DataFrame, around: int = 3, least: int = 5, key: str = "doc_id") -> DataFrame:
    """(key, idx, sentence, window): each sentence with those up to ``around`` before and after it; short ones are dropped afterwards."""
    rows = docs.select(key, T.sentences(F.col("text")).alias("all")).select(key, "all", F.posexplode("all").alias("idx", "sentence"))
    first = F.greatest(F.col("idx") + 1 - around, F.lit(1))
    window = F.array_join(F.slice("all", first, F.col("idx") + 2 + around - first), " ")
    return rows.select(key, "idx", "sentence", window.alias("window")).where(F.length("sentence") >= least)


def neighbours(chunks: DataFrame, n: int = 1, key: str = "doc_id") -> DataFrame:
    """Each chunk with those up to ``n`` before and after it in its document, joined by line feeds."""
    w = Window.partitionBy(key).orderBy("chunk_idx").rowsBetween(-n, n)
    return chunks.withColumn("expanded", F.array_join(F.collect_list("chunk").over(w), "\n"))


def token_windows(docs: DataFrame, size: int = 2000, overlap: int = 100, key: str = "doc_id") -> DataFrame:
    """(key, chunk_idx, chunk): overlapping windows of characters, as where no tokenizer is at hand."""
    step = size - overlap
    n = F.length("text")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: i < n)
    return docs.select(key, F.col("text"), F.posexplode(starts).alias("chunk_idx", "at")).select(key, "chunk_idx", F.trim(F.substring(F.col("text"), F.col("at") + 1, F.lit(size))).alias("chunk"))


def parents(chunks: DataFrame, size: int = DEFAULT_SIZE * 3, key: str = "doc_id") -> DataFrame:
    """Chunks with the number of the parent they are packed into: running lengths (two more a chunk) that start anew beyond ``size``."""
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_idx", F.length("chunk").alias("n")))).alias("c"))
    start = F.struct(F.lit(0).alias("parent"), F.lit(0).alias("used"), F.array().cast("array<struct<chunk_idx:int,parent_idx:int>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + c["n"] + 2 > size)
        parent = acc["parent"] + full.cast("int")
        return F.struct(parent.alias("parent"), (F.when(full, 0).otherwise(acc["used"]) + c["n"] + 2).alias("used"), F.array_append(acc["out"], F.struct(c["chunk_idx"].cast("int").alias("chunk_idx"), parent.alias("parent_idx"))).alias("out"))

    placed = rows.select(key, F.explode(F.aggregate("c", start, step, lambda a: a["out"])).alias("p"))
    return placed.select(key, "p.chunk_idx", "p.parent_idx").join(chunks, [key, "chunk_idx"])


def expand_to_parents(hits: DataFrame, placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits (query_id, key, chunk_idx, rank) with the parent in the chunk's place; the first hit of a parent stands."""
    rows = hits.join(placed.select(key, "chunk_idx", "parent_idx"), [key, "chunk_idx"])
    first = F.row_number().over(Window.partitionBy("query_id", key, "parent_idx").orderBy("rank"))
    return rows.withColumn("n", first).where("n = 1").drop("n")


def page_of_chunk(chunks: DataFrame, pages: DataFrame, window: int = 80, step: int = 40, loose: int = 60, key: str = "doc_id") -> DataFrame:
    """The page each chunk is on: the first of these that finds one.

    1. The page whose window of 80 characters, taken every 40, is just the chunk's beginning.
    2. The first window, by page and place, that holds the chunk's first 60 characters, letter case ignored.
    3. The first page that holds the chunk's first 80 characters, or its first 60 with case ignored.
    4. The document's first page.

    The first tier is an equi-join on the window's text; only chunks that it leaves meet their own document's
    windows and pages.
    """
    last = F.greatest(F.length("content") - (window - 1), F.lit(1)) - 1
    starts = F.sequence(F.lit(0), F.floor(last / step).cast("int") * step, F.lit(step))
    full = pages.where(F.length("content") > 0)
    windows = full.select(key, "page", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("content"), i + 1, F.lit(window)))).alias("place", "key"))
    begins = chunks.select(key, "chunk_idx", F.substring("chunk", 1, window).alias("prefix"), F.lower(F.substring("chunk", 1, loose)).alias("probe"))
    exact = windows.groupBy(key, "key").agg(F.min(F.struct("page", "place")).alias("first"))
    sure = begins.join(exact, (begins[key] == exact[key]) & (F.col("prefix") == F.col("key")), "left").select(begins[key], "chunk_idx", "prefix", "probe", F.col("first.page").alias("sure"))
    left = sure.where("sure is null").select(F.col(key).alias("__d"), F.col("chunk_idx").alias("__c"), "prefix", "probe")
    of_document = left["__d"] == F.col(key)
    near = windows.join(left, of_document & F.contains(F.lower("key"), F.col("probe"))).groupBy("__d", "__c").agg(F.min(F.struct("page", "place"))["page"].alias("near"))
    whole = full.join(left, of_document & (F.contains("content", F.col("prefix")) | F.contains(F.lower("content"), F.col("probe")))).groupBy("__d", "__c").agg(F.min("page").alias("whole"))
    first = pages.groupBy(key).agg(F.min("page").alias("first_page"))
    found = sure.join(near, (sure[key] == near["__d"]) & (F.col("chunk_idx") == near["__c"]), "left").drop("__d", "__c")
    found = found.join(whole, (F.col(key) == whole["__d"]) & (F.col("chunk_idx") == whole["__c"]), "left").join(first, key, "left")
    found = found.select(key, "chunk_idx", F.coalesce("sure", "near", "whole", "first_page", F.lit(1)).alias("page"))
    return chunks.drop("page").join(found, [key, "chunk_idx"])


def with_heading(chunk: Column, heading: Column) -> Column:
    """What is embedded in a chunk's place: its section's heading before it, if it has one."""
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("[章节: "), heading, F.lit("]\n"), chunk)).otherwise(chunk)


#: Rows of tables, beginnings of their titles, lines that may stand between parts of one, and rows that make one.
TABLE_ROW = re.compile(r"^\s*\|.*\|\s*$")
TABLE_TITLES, TABLE_NOTES, TABLE_ROWS, TABLE_GAP = ("TABLE", "Table", "表"), ("^", "*", "[^"), 3, 2


def table_spans(lines: list[str]) -> list[tuple[int, int]]:
    """(first, last) lines of tables: three rows or more, with a title right before; those at most two blank or note lines apart as one."""
    is_row = [bool(TABLE_ROW.match(x)) for x in lines]
    runs = [(a, b) for a in range(len(lines)) if is_row[a] and (a == 0 or not is_row[a - 1]) for b in [next((i for i in range(a, len(lines)) if not is_row[i]), len(lines)) - 1]]
    spans: list[tuple[int, int]] = []
    for a, b in runs:
        if b - a + 1 < TABLE_ROWS:
            continue
        a = a - 1 if a and lines[a - 1].strip().startswith(TABLE_TITLES) else a
        before = spans[-1][1] if spans else -TABLE_GAP - 2
        between = (x.strip() for x in lines[before + 1 : a])
        if a - before <= TABLE_GAP and all(not x or x.startswith(TABLE_NOTES) for x in between):
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return spans


def protect_tables(docs: DataFrame, key: str = "doc_id", mark: str = "__TABLE_PLACEHOLDER_") -> DataFrame:
    """(key, text, tables): tables give way to marks, numbered from the last one; ``tables`` is the array of what they were."""

    def make(text: str) -> list[tuple[str, list[str]]]:
        lines, tables = text.replace("\r\n", "\n").split("\n"), []
        for a, b in reversed(table_spans(lines)):
            tables.append("\n".join(lines[a : b + 1]))
            lines[a : b + 1] = [f"{mark}{len(tables) - 1}__"]
        return [("\n".join(lines), tables)]

    return per_row(docs, [key], ["text"], "text string, tables array<string>", make)


def restored(text: Column, tables: Column, mark: str = "__TABLE_PLACEHOLDER_") -> Column:
    """The text with its tables where their marks are."""
    numbered = F.transform(tables, lambda t, i: F.struct(F.concat(F.lit(mark), i.cast("string"), F.lit("__")).alias("mark"), t.alias("table")))
    return F.aggregate(numbered, text, lambda acc, t: F.replace(acc, t["mark"], t["table"]))


def mended_table(table: Column) -> Column:
    """A Markdown table with a rule below its header and as many cells in every row as that has; under three lines as it is."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(table, "\n"), trim), lambda x: x != "")
    cells = lambda x: F.filter(F.transform(F.split(x, r"\|"), trim), lambda c: c != "")
    width = F.size(cells(F.get(lines, F.lit(0))))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    second = F.get(lines, F.lit(1))
    fits = F.contains(second, F.lit("-")) & F.contains(second, F.lit("|")) & (F.size(cells(second)) == width)
    row = lambda x: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(cells(x), F.array_repeat(F.lit(""), width)), F.lit(1), width), " | "), F.lit(" |"))
    rest = F.transform(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), lambda x: F.when(F.size(cells(x)) == width, x).otherwise(row(x)))
    return F.when(F.size(lines) < 3, table).otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(F.when(fits, second).otherwise(rule)), rest), "\n"))
