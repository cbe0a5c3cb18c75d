"""Retrieval, contexts and citations against plain Python over small tables."""

import math
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from lexmill.functions import questions as A
from lexmill.functions import text as T
from lexmill.operators import context as X
from lexmill.operators import glossary as H
from lexmill.operators import retrieval as R
from lexmill.operators import vector as V
from tests.test_operators import plain_mmr

WORDS = "alpha beta gamma delta river stone lamp green seven of the and".split()


def tokens(t):
    return re.findall("[a-z0-9]{2,}", t.lower())


def plain_table(t):
    lines = t.strip().split("\n")
    return len(lines) >= 2 and (t.count("|") >= 4 or t.count("\t") >= 4 or (len(lines) >= 3 and sum(sum(c.isdigit() for c in x) >= 3 for x in lines) >= 0.5 * len(lines)))


def plain_fragment(t):
    words = t.split()
    if len(t) < 20 or len(words) < 3:
        return False
    share = sum(bool(re.fullmatch(r"-?[0-9]+\.?[0-9]*[a-zA-Z]?", w.strip("(),%↑↓·-") if not w.startswith("-") else w)) for w in words) / len(words)
    return share > 0.5 or (share > 0.25 and not any(len(s.strip()) > 30 for s in re.split("[.!?。！？]", t)))


def plain_retrieve(query, vector, chunks, top):
    """chunks: (text, page, embedding) of one document, in order."""
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    pool = 20
    near = sorted(((-round((float(unit(vector) @ unit(e)) + 1) / 2, 9), i) for i, (_, _, e) in enumerate(chunks)))[:pool]
    hits = [[chunks[i][0], -s] for s, i in near]
    low = query.lower().strip()
    if len(low) > 3 and " " in low:
        held = {c for c, _ in hits}
        more = []
        for t, _, _ in chunks:
            if low in t.lower() and t not in held and len(more) < 5:
                more.append([t, 0.95])
                held.add(t)
        hits += more
    terms = [t for t in re.split(r"[\s,;，。；、]+", low) if len(t) > 1]
    for h in hits:
        c = h[0].lower()
        cover = sum(t in c for t in terms) / max(len(terms), 1)
        if plain_fragment(h[0]):
            h[1] *= 0.5
        elif low in c:
            h[1] = min(h[1] * 1.2, 1)
        elif terms and cover >= 0.8:
            h[1] = min(h[1] * (1 + 0.2 * cover * 0.5), 1)
        h[1] = round(h[1], 6)
    hits.sort(key=lambda h: -h[1])
    order = plain_mmr(hits, top * 3)
    similarity = dict(map(tuple, hits))
    docs = [tokens(t) for t, _, _ in chunks]
    df, average = Counter(w for d in docs for w in set(d)), max(sum(map(len, docs)) / len(docs), 1)
    score = lambda d: sum(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / average)) for w in tokens(query) if w in d)
    words = [chunks[i][0] for s, i in sorted((-round(score(d), 6), i) for i, d in enumerate(docs)) if s < 0][:pool]
    if order and words:
        fused, first = defaultdict(float), {}
        for k, some in enumerate((order, words)):
            for r, c in enumerate(some):
                fused[c] += 0.5 / (61 + r)
                first.setdefault(c, (k, r))
        out = sorted(fused, key=lambda c: (-round(fused[c], 9), first[c], c))[:top]
    else:
        out = (order or words)[:top]
    page = {}
    for t, p, _ in chunks:
        page.setdefault(t, p)
    pages = {page[c] for c in out}
    extra = [t for t, p, _ in chunks if t not in out and plain_table(t) and p in pages][:3]
    return [(c, round(similarity.get(c, 0.5), 6)) for c in out] + [(t, 0.45) for t in extra]


def test_retrieve(spark):
    rng = np.random.default_rng(5)
    chunks, queries = [], []
    for d in range(4):
        for i in range(30 if d else 6):
            text = f"u{d}x{i} " + " ".join(rng.choice(WORDS, int(rng.integers(4, 14)))) + ". a plain sentence that goes on for a while"
            if i % 9 == 4:
                text = f"| {d} | {i} |\n| 1 | 2 |"
            if i % 9 == 7:
                text = f"{d} 12 3.5 {i} 77 8 9.1 {i + 3} table"
            chunks.append((d, i, text, i // 5 + 1, rng.integers(-5, 6, 6).astype(float).tolist()))
        for k in range(3):
            queries.append((d * 10 + k, d, " ".join(rng.choice(WORDS, 2 + k)), None, rng.integers(-5, 6, 6).astype(float).tolist()))
    queries.append((99, 1, "zzz", None, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]))
    c = spark.createDataFrame(chunks, "doc_id int, chunk_idx int, chunk string, page int, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id int, doc_id int, query string, selected string, vector array<double>")
    got = defaultdict(list)
    for r in R.retrieve(q, c, None, R.Settings(top=4)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["chunk"], round(r["similarity"], 6)))
    for i, d, text, _, v in queries:
        assert got[i] == plain_retrieve(text, v, [(t, p, e) for dd, _, t, p, e in chunks if dd == d], 4), i


def test_relevant_snippet():
    text = "Intro line here. " + "x " * 150 + "The red fox. jumps over red fences near the fox den. " + "y " * 150
    assert X.relevant_snippet(text, "red fox", 60).startswith("The red fox") or "red fences" in X.relevant_snippet(text, "red fox", 60)
    assert X.relevant_snippet("short", "q") == "short" and X.relevant_snippet("", "q") == ""
    # the densest window, counted the slow way
    low, most = text.lower(), 60
    at = sorted(m.start() for t in ("red", "fox") for m in re.finditer(t, low))
    starts = [max(0, p - most // 3) for p in at]
    best = max(starts, key=lambda s: (sum(s <= p < s + most for p in at), -s))
    begin = next((i + 1 for i in range(best - 1, max(0, best - 30) - 1, -1) if text[i] in "。\n.！？!?；;"), best)
    assert X.relevant_snippet(text, "red fox", most) == text[begin : begin + most].strip()
    references = "[1] A, B. 1999. doi x et al\n" * 20 + "A plain line about foxes, with an end."
    assert "plain line" in X.relevant_snippet(references, "nothing there", 60)


def test_citations(spark):
    reply = "CITATION LIST\n\nCITATION【2】\nSTART_PHRASE: the quick brown\nEND_PHRASE: lazy dog\ncitation[5]\nSTART_PHRASE: open end\nEND_PHRASE: \nFINAL ANSWER\nyes [2]"
    assert X.cited_phrases(reply) == [(2, "the quick brown", "lazy dog"), (5, "open end", "")]
    assert X.cited_phrases("START_PHRASE: a\nEND_PHRASE: b") == [(None, "a", "b")] and X.cited_phrases("none") == []
    source = "Intro. The QUICK brown\nfox jumps over the lazy dog today."
    a, b, n = X.phrase_span("the quick brown", "lazy dog", source)
    assert source.replace("\n", " ")[a:b] == "The QUICK brown fox jumps over the lazy dog" and n == 15 + 8
    m = SequenceMatcher(None, "abcdefgh", "zzabcdzz", autojunk=False).find_longest_match()
    assert m.size == 4 and X.phrase_span("abcdefgh", None, "zzabcdzz") is None  # not longer than five
    cited = spark.createDataFrame([(1, 0, 2, "the quick brown", "lazy dog"), (1, 1, 9, "completely absent", None), (1, 2, 9, "second passage", None)], "answer_id int, place int, ref int, start_phrase string, end_phrase string")
    seg = spark.createDataFrame([(1, 1, "the quick brown fox elsewhere", 7, "g1"), (1, 2, source, 3, "g2"), (1, 4, "a second passage here", 4, "g4")], "answer_id int, ref int, text string, page int, group_id string")
    out = {r["place"]: r for r in X.match_citations(cited, seg, seg.withColumnRenamed("ref", "chunk_idx")).collect()}
    assert out[0]["group_id"] == "g2" and out[0]["highlight"].startswith("The QUICK") and out[1]["highlight"] is None and out[2]["group_id"] == "g4"
    answers = spark.createDataFrame([(reply,), ("plain",), ("FINAL ANSWER \n x\nCITATION LIST\n y",)], "t string")
    assert [r[0] for r in answers.select(X.final_answer(F.col("t"))).collect()] == ["yes [2]", "plain", "x"]


def test_glossary(spark):
    terms = H.Terms([("AI", "IA", True, True), ("net", "réseau", False, True), ("neural net", "réseau neuronal", False, False), ("网络", "network", False, True)])
    found = [(t, at) for at, _, t, _ in terms.found("AI: Neural Nets, a NET; 神经网络 MAIN net")]
    assert found == [("AI", 0), ("neural net", 4), ("net", 19), ("网络", 26)]


def test_rewriting(spark):
    rows = [("这个是啥", "Attention. More text"), ("注意力机制啥意思", None), ("plain", "  First one! second"), ("", "x"), ("它和那段咋用", "key"), ("为啥 a\nb", " ")]
    out = spark.createDataFrame(rows, "q string, s string").select(A.rewritten(F.col("q"), F.col("s"))).collect()
    assert [r[0] for r in out] == ["Attention. More text的定义", "注意力机制的含义和解释", "plain First one", "", "key和key的使用方法", "a的原因和目的\nb"]


def test_embedding_batches(spark):
    rows = [("d", i, "a" * n) for i, n in enumerate([35, 35, 70, 400, 1, 350])]
    out = V.embedding_batches(spark.createDataFrame(rows, "doc string, i int, text string"), 20, "doc", "i").orderBy("i").collect()
    assert [r["batch"] for r in out] == [0, 0, 1, 2, 3, 4] and all(r["tokens"] <= 20 for r in out)
    assert len(out[3]["text"]) == 73 and V.fitted("a" * 73, 20) == ("a" * 73, 20) and V.fitted("a" * 74, 20)[0] == "a" * 73


def test_markdown_emphasis(spark):
    from lexmill.functions import markup as P

    df = spark.createDataFrame([("a *b* **c** _d_ __e__ `f`",), ("* item\n1. one",)], "t string")
    assert [r[0] for r in df.select(P.markdown_text(F.col("t"))).collect()] == ["a b c d e f", "item\none"]
    df = spark.createDataFrame([("see ![x](y.png) now\nand then-\nce. Next\n\n1.a",), ("",)], "t string")
    assert [r[0] for r in df.select(P.rebuilt(F.col("t"))).collect()][1] == ""


def test_tokens_of_both_kinds(spark):
    df = spark.createDataFrame([("Ab c de 数据库 x1",), ("État a bb",), ("",)], "t string")
    out = df.select(T.tokens(F.col("t")).alias("k"), T.token_count(F.col("t")).alias("n")).collect()
    assert all(len(r["k"]) == r["n"] for r in out) and out[1]["k"] == ["tat", "bb"]
