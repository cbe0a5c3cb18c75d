"""From hits and groups to a context with citations, and from a model's answer back to the passages that it cites."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.questions import stripped
from lexmill.operators.lexical import STOPS
from lexmill.operators.rows import per_row
from lexmill.stage import cut

#: What a reference list is told by.
_REFERENCES = {name: re.compile(p) for name, p in {"marker": r"\[[0-9]{1,3}\]", "year": r"\b(?:19|20)\d{2}\b", "id": r"\b(?:doi|arxiv)\b", "author": r"\b[A-Z][a-z]+,\s*(?:[A-Z]\.|[A-Z][a-z]+)"}.items()}
#: What parts a question into terms, and what an answer of two parts is marked by.
TERM_BREAKS = r'[\s,;，。；、？！?!：:""\'\']+'
ANSWER, CITATIONS = "FINAL ANSWER", "CITATION LIST"
CITATION = re.compile(r"citation[【\[](\d+)[】\]]", re.IGNORECASE)
PHRASES = {"start_phrase:": 0, "end_phrase:": 1}
#: What is added to a context whose best hit is not similar enough.
LOW_RELEVANCE = "\n\n⚠️ 注意：以上检索结果与用户问题的相关度较低，文档中可能不包含与该问题直接相关的内容。请基于已有信息谨慎回答，并明确告知用户信息可能不够充分。"
SEPARATOR = "\n\n...\n\n"


def reference_like(text: str, most: int = 1000) -> bool:
    """Whether a text reads like a list of references: a keyword, or two of four signals at its start."""
    sample = text[:most]
    low = sample.lower()
    if any(w in low for w in ("references", "bibliography", "参考文献")):
        return True
    n = {k: len(p.findall(low if k == "id" else sample)) for k, p in _REFERENCES.items()}
    return sum([n["marker"] >= 2, n["year"] >= 2, "et al" in low or n["author"] >= 2, n["id"] >= 1]) >= 2


def best_line(text: str, most: int) -> str:
    """A piece of ``most`` characters around the line that reads most like prose: long, with a stop, and no reference list."""
    if len(text) <= most:
        return text[:most].strip()

    def worth(line: str) -> float:
        return min(len(line), most) / most + (-0.8 if reference_like(line) else 1.0) + (0.2 if re.search(r"[。！？.!?]", line) else 0.0)

    lines = [(worth(m.group().strip()), -m.start()) for m in re.finditer(r"[^\n]+", text) if m.group().strip()]
    top = max(lines, default=(0.0, 0))
    start = max(0, -top[1] - most // 4)
    return text[start : start + most].strip() if top[0] > 0 else text[:most].strip()


def relevant_snippet(text: str, query: str, most: int = 200, selected: str = "") -> str:
    """The piece of ``most`` characters that holds most of the question's terms, begun just after a stop if one is near.

    Terms also come from the first 100 characters of a selection.  Without terms, hits or a piece that is no
    reference list, the best line.
    """
    source = f"{query} {selected[:100]}" if selected else query
    terms = [t for t in re.split(TERM_BREAKS, source.lower()) if len(t) >= 2]
    low = text.lower()
    if not text or not query or len(text) <= most:
        return best_line(text, most)
    at = sorted(m.start() for t in terms for m in re.finditer(re.escape(t), low))
    if not at:
        return best_line(text, most)
    begins = [max(0, p - most // 3) for p in at]
    # hits and windows both ascend: two pointers count what each window holds
    best, start, lo, hi = 0, 0, 0, 0
    for b in begins:
        while lo < len(at) and at[lo] < b:
            lo += 1
        while hi < len(at) and at[hi] < b + most:
            hi += 1
        if hi - lo > best:
            best, start = hi - lo, b
    start = next((i + 1 for i in range(start - 1, max(0, start - 30) - 1, -1) if text[i] in STOPS), start)
    piece = text[start : start + most].strip()
    return piece if piece and not reference_like(piece) else best_line(text, most)


def relevant_snippets(rows: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """``keys`` of (keys, query, text) with ``snippet``."""
    return per_row(rows, keys, ["text", "query"], "snippet string", lambda t, q: [(relevant_snippet(t, q, most),)])


def build_context(selected: DataFrame, reorder: bool = False) -> DataFrame:
    """(query_id, context, citations) of (query_id, rank from 0, group_id, granularity, page_start, page_end, keywords, text, highlight).

    Numbered blocks, each with its group, granularity and pages, its keywords if it has any, and its text.
    ``reorder`` puts the best at both ends.  Citations are structs of ref, group_id, page_start, page_end, highlight.
    """
    n, rank = F.count("*").over(Window.partitionBy("query_id")), F.col("rank")
    place = F.when((n > 2) & F.lit(reorder), F.when(rank % 2 == 0, rank / 2).otherwise(n - 1 - (rank - 1) / 2).cast("int")).otherwise(rank)
    rows = selected.withColumn("ref", place.cast("int") + 1)
    head = F.format_string("[%d]【%s - %s | 页码: %d-%d】", "ref", "group_id", "granularity", "page_start", "page_end")
    words = F.when(F.size("keywords") > 0, F.concat(F.lit("关键词: "), F.array_join("keywords", ", ")))
    block = F.concat_ws("\n", head, words, F.lit("内容:"), "text")
    cited = F.struct("ref", "group_id", "page_start", "page_end", "highlight")
    made = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ref", block.alias("block")))).alias("b"), F.array_sort(F.collect_list(cited)).alias("citations"))
    return made.select("query_id", F.array_join("b.block", "\n\n").alias("context"), "citations")


def plain_context(hits: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(query_id, context, low_relevance) of (query_id, rank, chunk, similarity) where there are no groups: chunks one after the other."""
    made = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("c"), (F.max("similarity") < threshold).alias("low_relevance"))
    text = F.array_join("c.chunk", SEPARATOR)
    return made.select("query_id", F.when(F.col("low_relevance"), F.concat(text, F.lit(LOW_RELEVANCE))).otherwise(text).alias("context"), "low_relevance")


def sources_line(citations: Column) -> Column:
    """A line for each citation: number, source and pages, for the instructions to a model."""
    return F.array_join(F.transform(citations, lambda c: F.format_string("[%d] 来源: %s，页码: %d-%d", c["ref"], c["group_id"], c["page_start"], c["page_end"])), "\n")


def selected_block(selected: Column, context: Column, first: Column, last: Column, ref: int | None = None) -> Column:
    """A selection with its pages before the context that was found for it."""
    pages = F.when(first.isNull(), "").when(first == last, F.concat(F.lit("（页码: "), first.cast("string"), F.lit("）"))).otherwise(F.format_string("（页码: %d-%d）", first, last))
    title = F.concat(F.lit(f"[{ref}]用户选中的文本" if ref is not None else "用户选中的文本"), pages)
    found = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\n\n\n相关文档片段：\n\n"), context)).otherwise("")
    return F.concat(selected, F.lit("\n\n"), title, found)


def selected_citation(selected: Column, first: Column, last: Column, least: int = 30) -> Column:
    """The citation that a selection of ``least`` characters or more stands for where retrieval gave none; else null."""
    page = F.coalesce(first, F.lit(1))
    made = F.struct(F.lit(1).alias("ref"), F.lit("selected-text").alias("group_id"), page.alias("page_start"), F.coalesce(last, page).alias("page_end"), stripped(F.substring(selected, 1, 200)).alias("highlight"))
    return F.when(F.length(stripped(F.coalesce(selected, F.lit("")))) >= least, made)


def locate_selection(selections: DataFrame, pages: DataFrame, prefix: int = 80, key: str = "doc_id") -> DataFrame:
    """(selection_id, page_start, page_end) of (selection_id, key, selected) among (key, page, content).

    The pages that hold the selection; if none, those that hold its first 80 characters; else page 1.
    """
    asked = selections.where(stripped(F.coalesce("selected", F.lit(""))) != "")
    beginning = F.substring("selected", 1, prefix)
    # a page that holds the whole holds its beginning, so one test by the beginning finds all candidates
    near = asked.join(pages.select(key, "page", "content"), key).where(F.contains("content", beginning))
    whole = F.when(F.contains("content", "selected"), F.col("page"))
    found = near.groupBy("selection_id").agg(F.min(whole).alias("a"), F.max(whole).alias("b"), F.min("page").alias("c"), F.max("page").alias("d"))
    rows = selections.select("selection_id").distinct().join(found, "selection_id", "left")
    return rows.select("selection_id", F.coalesce("a", "c", F.lit(1)).alias("page_start"), F.coalesce("b", "d", F.lit(1)).alias("page_end"))


def cited_phrases(reply: str) -> list[tuple[int | None, str | None, str | None]]:
    """(number, start phrase, end phrase) of each CITATION block; a block is closed by its second phrase or the next block."""
    out: list[tuple[int | None, str | None, str | None]] = []
    number: int | None = None
    phrases: list[str | None] = [None, None]
    held = False

    def close() -> None:
        nonlocal number, phrases, held
        if held:
            out.append((number, phrases[0], phrases[1]))
        number, phrases, held = None, [None, None], False

    for line in map(str.strip, reply.split("\n")):
        begun = CITATION.match(line)
        if begun:
            close()
            number, held = int(begun[1]), True
            continue
        for mark, i in PHRASES.items():
            if line.lower().startswith(mark):
                phrases[i], held = line[len(mark) :].strip(), True
        if all(phrases):
            close()
    close()
    return out


def citation_list(replies: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, place, ref, start_phrase, end_phrase) of (key, text)."""
    return per_row(replies, [key], ["text"], "ref int, start_phrase string, end_phrase string", cited_phrases, "place").replace(float("nan"), None)


def final_answer(reply: Column) -> Column:
    """What stands behind the answer's mark, up to a list of citations that comes after it; all where there is no mark."""
    at = F.locate(ANSWER, reply)
    rest = F.regexp_replace(F.substring(reply, at + len(ANSWER), F.length(reply)), r"^\s+", "")
    again = F.locate(CITATIONS, rest)
    return F.when(at == 0, reply).when(again > 0, F.regexp_replace(F.substring(rest, F.lit(1), again - 1), r"\s+$", "")).otherwise(rest)


class Runs:
    """All substrings of a phrase as an automaton; a text is read once to find the longest run that both share.

    Its states are classes of substrings with the same ends, twice as many as the phrase is long at most.
    """

    def __init__(self, phrase: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]
        last = 0
        for i, c in enumerate(phrase):
            state = self._state({}, self.length[last] + 1, i + 1)
            at = last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = state
                at = self.link[at]
            if at < 0:
                self.link[state] = 0
            else:
                to = self.next[at][c]
                if self.length[at] + 1 == self.length[to]:
                    self.link[state] = to
                else:
                    twin = self._state(dict(self.next[to]), self.length[at] + 1, self.first[to])
                    self.link[twin] = self.link[to]
                    while at >= 0 and self.next[at].get(c) == to:
                        self.next[at][c] = twin
                        at = self.link[at]
                    self.link[to] = self.link[state] = twin
            last = state

    def _state(self, steps: dict[str, int], length: int, first: int) -> int:
        self.next.append(steps)
        self.link.append(-1)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def longest(self, text: str) -> tuple[int, int, int]:
        """(place in the phrase, place in the text, length) of the longest run; of equals the first in the phrase, then in the text."""
        best = (0, 0, 0)
        state = n = 0
        for end, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                n += 1
            if n and (n > -best[0] or n == -best[0] and self.first[state] - n < best[1]):
                best = (-n, self.first[state] - n, end - n)
        return best[1], best[2], -best[0]


def phrase_span(start: str | None, end: str | None, source: str, share: float = 0.35, least: int = 5, most: int = 300) -> tuple[int, int, int] | None:
    """(begin, end, matched) of the two phrases in a source: from the first matched character to the last, ``most`` at most.

    A phrase is matched by its longest common run with the source where that is longer than ``share`` of it and ``least``.
    """
    source = source.lower().replace("\n", " ")
    found = []
    for phrase in filter(None, ((start or "").lower(), (end or "").lower())):
        _, at, n = Runs(phrase).longest(source)
        if n > max(len(phrase) * share, least):
            found.append((at, at + n))
    if not found:
        return None
    a, b = min(x for x, _ in found), max(y for _, y in found)
    return a, min(b, a + most), sum(y - x for x, y in found)


def match_citations(cited: DataFrame, segments: DataFrame, chunks: DataFrame, key: str = "answer_id") -> DataFrame:
    """``cited`` (key, place, ref, start_phrase, end_phrase) with highlight, page and group_id of the passage that each quotes.

    First the segment (key, ref, text, page, group_id) of the same number is tried, then, for what that leaves, all segments
    of the answer, then its chunks (key, chunk_idx, text, page, group_id); the longest match counts, the first of equals.
    Citations without a phrase are left out.
    """
    some = cut(cited.where((F.coalesce("start_phrase", F.lit("")) != "") | (F.coalesce("end_phrase", F.lit("")) != "")), "cited")
    seg = segments.where("ref is not null and text <> ''").select(key, F.col("ref").alias("n"), "text", "page", "group_id")
    parts = chunks.where("text <> ''").select(key, F.col("chunk_idx").alias("n"), "text", "page", "group_id")

    def make(start: str, end: str, text: str) -> list[tuple[str, int]]:
        span = phrase_span(start, end, text)
        return [(text.replace("\n", " ")[span[0] : span[1]], span[2])] if span else []

    found, left = None, some
    for pairs in (lambda x: x.join(seg, key).where(F.col("n") == F.col("ref")), lambda x: x.join(seg, key), lambda x: x.join(parts, key)):
        spans = per_row(pairs(left), [key, "place", "n", "page", "group_id"], ["start_phrase", "end_phrase", "text"], "highlight string, matched int", make)
        best = cut(spans.groupBy(key, "place").agg(F.min(F.struct((-F.col("matched")).alias("shorter"), "n", "highlight", "page", "group_id")).alias("b")), "matched")
        found = best if found is None else found.unionByName(best)
        left = left.join(best, [key, "place"], "left_anti")
    return some.join(found, [key, "place"], "left").select(*some.columns, "b.highlight", "b.page", "b.group_id")


def trace_meta(assigned: DataFrame, hits: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(query_id, granularities, token_used, max_relevance_score, fallback) of a retrieval: its granularities once each, in order of use."""
    used = assigned.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "granularity", "tokens"))).alias("a"))
    best = hits.groupBy("query_id").agg(F.max("similarity").alias("best"))
    total = F.aggregate(F.coalesce(F.col("a.tokens"), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = best.join(used, "query_id", "left")
    return rows.select("query_id", F.array_join(F.array_distinct("a.granularity"), ",").alias("granularities"), total.alias("token_used"), F.bround("best", 4).alias("max_relevance_score"), F.when(F.col("best") < threshold, "low_relevance").when(F.col("a").isNull(), "index_missing").alias("fallback"))


def highlight_text(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with the snippet that a citation of a hit highlights."""
    return relevant_snippets(hits.withColumn("text", F.col("chunk")), keys).withColumnRenamed("snippet", "highlight")

