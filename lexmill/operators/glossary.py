"""Glossary terms in texts: one automaton over all terms scans every text once."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.stage import cut

#: Terms of a part of the glossary, which is sent to all executors (about 1 KB each); a larger one is scanned part by part.
PART_TERMS = 50_000
#: The frame of the instruction to a translating model.
INSTRUCTION = ("【术语表】\n以下术语在翻译时请使用指定的译法，保持一致性：\n\n", "\n\n请在翻译过程中严格遵循上述术语表。")


class Automaton:
    """Words and where they end in a text, all of them in one pass.

    Nodes are the words' prefixes.  A failure link goes to the longest other prefix that ends alike, and a node's
    report link to the nearest one on that way that is a whole word.
    """

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        for i, word in enumerate(words):
            node = 0
            for c in word:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word.append(-1)
                node = self.next[node][c]
            self.word[node] = i
        self.fail = [0] * len(self.next)
        self.report = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            node = waiting.popleft()
            for c, child in self.next[node].items():
                back = self.fail[node]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                back = self.next[back].get(c, 0)
                self.fail[child] = back
                self.report[child] = back if self.word[back] >= 0 else self.report[back]
                waiting.append(child)

    def ends(self, text: str) -> Iterator[tuple[int, int]]:
        """(place behind it, word) of every occurrence."""
        node, steps, fail, word, report = 0, self.next, self.fail, self.word, self.report
        for at, c in enumerate(text, 1):
            while node and c not in steps[node]:
                node = fail[node]
            node = steps[node].get(c, 0)
            hit = node if word[node] >= 0 else report[node]
            while hit:
                yield at, word[hit]
                hit = report[hit]


class Terms:
    """The enabled entries (term, translation, case_sensitive, whole_word), one automaton for those told apart by case and one for the others."""

    def __init__(self, entries: list[tuple[str, str, bool, bool]]) -> None:
        self.entries = [e for e in entries if e[0] and e[1]]
        self.held: list[tuple[Automaton, list[list[int]], list[int]]] = []
        for case in (True, False):
            by: dict[str, list[int]] = {}
            for i, (term, _, own, _) in enumerate(self.entries):
                if bool(own) == case:
                    by.setdefault(term if case else term.lower(), []).append(i)
            self.held.append((Automaton(list(by)), list(by.values()), [len(w) for w in by]))

    def _hits(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(place, 0 if told apart by case, length, entry) of every occurrence that counts, by where it ends."""
        low = text.lower()
        low = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        edge = lambda i: not 0 <= i < len(text) or not (text[i].isalnum() or text[i] == "_")
        for folded, (source, (automaton, owners, lengths)) in enumerate(zip((text, low), self.held)):
            for end, word in automaton.ends(source):
                at = end - lengths[word]
                for i in owners[word]:
                    term, _, _, whole = self.entries[i]
                    if not whole or not re.search("[A-Za-z0-9_]", term) or (edge(at - 1) and edge(end)):
                        yield at, folded, lengths[word], i

    def found(self, text: str) -> list[tuple[int, int, str, str]]:
        """(place, length, term, translation) once each, in order of place, case-sensitive ones first, shorter ones first."""
        first: dict[tuple[str, str], tuple[int, int, int, int]] = {}
        for hit in self._hits(text):
            pair = self.entries[hit[3]][:2]
            if pair not in first or hit < first[pair]:
                first[pair] = hit
        return [(at, n, *pair) for (at, _, n, _), pair in sorted((h, p) for p, h in first.items())]

    def any(self, text: str) -> bool:
        """Whether a text holds a term; the scan ends at the first."""
        return next(self._hits(text), None) is not None


def _parts(glossary: DataFrame) -> Iterator[list[tuple]]:
    """The enabled entries in order, in parts of PART_TERMS; equal terms share a part."""
    rows = glossary.where("enabled and term <> '' and translation <> ''").select("term", "translation", "case_sensitive", "whole_word").orderBy("term", "translation")
    part: list[tuple] = []
    for r in rows.toLocalIterator():
        if len(part) >= PART_TERMS and r["term"] != part[-1][0]:
            yield part
            part = []
        part.append(tuple(r))
    if part:
        yield part


def matches(texts: DataFrame, glossary: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, place, term, translation): the glossary's entries (term, translation, case_sensitive, whole_word, enabled) in each text, once each, by first occurrence.

    Whole-word terms with an ASCII word character need a word's edge at both ends.  Equal terms are in the order of
    their translations.  A glossary of any size is taken part by part, each row carrying what it has found.
    """
    kind = texts.schema[key].dataType.simpleString()
    hits = "array<struct<at:int,folded:int,length:int,term:string,translation:string>>"
    rows = texts.select(key, F.coalesce("text", F.lit("")).alias("text"), F.array().cast(hits).alias("hits"))
    schema = f"{key} {kind}, text string, hits {hits}"
    for n, part in enumerate(_parts(glossary)):
        rows = _scanned(cut(rows, "scanned") if n else rows, part, schema)
    return rows.select(key, F.posexplode(F.array_sort("hits")).alias("place", "h")).select(key, "place", "h.term", "h.translation")


def _scanned(rows: DataFrame, part: list[tuple], schema: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms(sent.value)
        case = {e[:2]: e[2] for e in reversed(terms.entries)}
        for pdf in batches:
            more = [[{"at": at, "folded": int(not case[t, x]), "length": n, "term": t, "translation": x} for at, n, t, x in terms.found(text)] for text in pdf["text"]]
            pdf["hits"] = [[*(old if old is not None else []), *new] for old, new in zip(pdf["hits"], more)]
            yield pdf

    return rows.mapInPandas(run, schema)


def holds_any(texts: DataFrame, glossary: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of the texts that hold a term of the glossary; a text is read up to the first one."""
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(key, F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("held"))
    for n, part in enumerate(_parts(glossary)):
        sent = texts.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            terms = Terms(sent.value)
            for pdf in batches:
                pdf["held"] = [held or terms.any(t) for held, t in zip(pdf["held"], pdf["text"])]
                yield pdf

        rows = (cut(rows, "scanned") if n else rows).mapInPandas(run, f"{key} {kind}, text string, held boolean")
    return rows.where("held").select(key)


def instruction(found: DataFrame, key: str = "doc_id", most: int = 50) -> DataFrame:
    """(key, instruction): each text's first ``most`` terms and their translations, for a model."""
    line: Column = F.concat(F.lit("- "), "term", F.lit(" → "), "translation")
    made = found.where(F.col("place") < most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return made.select(key, F.concat(F.lit(INSTRUCTION[0]), F.array_join("l.line", "\n"), F.lit(INSTRUCTION[1])).alias("instruction"))
