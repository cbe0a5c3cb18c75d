"""Reply trees, reordered search and phrases against plain versions, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import bisection_search as B
from lexmill.llm import chat_trees as C
from lexmill.llm import phrases as P

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_ranking(items, docs, k):
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    terms = defaultdict(set)
    for i, t in items:
        terms[i].update(TERM.findall((t or "").translate(LOWER)))
    for i, ts in terms.items():
        scores = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        for n, (s, null, d) in enumerate(sorted(scores)[:k], 1):
            out.add((i, n, None if null else d, -s))
    return out


def test_search_is_exact(spark, odd):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words[: rng.choice([20, 300])], k=rng.randint(1, 60))), "x") for i in range(400)]
    rows += [(None, "w1 w2 w3", "x"), (7, rows[7][1], "x"), (9, "W1,w2;w3", "x"), (401, None, "x"), (402, "", "x"), (403, "w5 " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    items = [(1, "w1 w2 w3"), (2, "w250 w5"), (3, None), (4, "none such"), (5, " ".join(words)), (None, "w9"), (6, "w1"), (6, "w2")]
    found = B.search(spark.createDataFrame(items, "item_id long, text string"), docs, k=7)
    assert {tuple(r) for r in found.collect()} == plain_ranking(items, [r[:2] for r in rows], 7)
    odd_rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = B.search(spark.createDataFrame([(1, "same text été 日本語 word")], "item_id long, text string"), odd.withColumn("term", F.lit(1)).withColumn("n", F.lit(2)), k=50)
    assert {tuple(r) for r in found.collect()} == plain_ranking([(1, "same text été 日本語 word")], odd_rows, 50)


def test_search_of_nothing(spark, none):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert B.search(items, none).count() == 0
    assert B.search(items.limit(0), items.select(F.col("item_id").alias("doc_id"), "text")).count() == 0


def test_bisection_parts_topics():
    rng = random.Random(3)
    import numpy as np

    docs = [np.unique([rng.randrange(100) + (i % 2) * 100 for _ in range(30)]) for i in range(200)]
    side, _, _ = B.bisect(docs)
    apart = abs(sum(side[i] for i in range(0, 200, 2)) - sum(side[i] for i in range(1, 200, 2)))
    assert apart > 90


def test_bounds_leave_blocks_out(spark):
    """Blocks of other topics lie under the k-th score and are not visited."""
    rows = [(i, " ".join(f"t{i // 100}x{j}" for j in random.Random(i).sample(range(60), 20)) + " all") for i in range(2000)]
    blocks, total, _ = B.index(spark.createDataFrame(rows, "doc_id long, text string"))
    held = [B.Block(r.asDict()) for r in blocks.collect()]
    weights = {b"t3x1": 2500, b"t3x2": 2500, b"all": 1}
    bounds = [b.bound(weights) for b in held]
    best = sorted((s for b in held for s in b.best(weights, 5, 1)[1].tolist()), reverse=True)[4]
    assert total == 2000 and len(held) >= 32 and sum(b >= best for b in bounds) <= len(held) // 4


def plain_collocations(rows, least, top):
    totals, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            n = totals[lang]
            score, k = min(((1000 * a * n) // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            longer = any(x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in f.items() if b >= least)
            if not longer:
                found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n))
    return {(lang, i, p.decode(), -a, x, y, n, -s) for lang, some in found.items() for i, (s, a, p, x, y, n) in enumerate(sorted(some)[:top], 1)}


@pytest.mark.parametrize("held", [1 << 20, 7])
def test_phrases_are_exact(spark, odd, held, monkeypatch):
    rng = random.Random(8)
    words = ["a", "B", "c", "d\x00", "é", "日本"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", ". ", "\n"]) for _ in range(rng.randint(0, 40)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), ("en", "x y z w v u. " * 9)] + [("de", "same text here now")] * 5
    monkeypatch.setattr(P, "HELD_WORDS", held)
    docs = spark.createDataFrame([(lang, t, "x", 3) for lang, t in rows], "lang string, text string, phrase string, m int")
    assert {tuple(r) for r in P.collocations(docs, least=4, top=25).collect()} == plain_collocations(rows, 4, 25)
    odd_rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in P.collocations(odd, least=2, top=50).collect()} == plain_collocations(odd_rows, 2, 50)


def test_phrases_of_nothing(spark, none):
    assert P.collocations(none).count() == 0


def test_products_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a", 10**12), ("en", "b", 10**12), ("en", "a b", 10**12)], "lang string, phrase string, m long")
    row = P.scored(spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long"), found).first()
    assert row["score"] == (1000 * 10**12 * 9 * 10**15) // 10**24


def test_reply_trees(spark):
    rng = random.Random(4)
    rows, parent = [], {}
    for tree in (1, 2, None):
        for i in range(60):
            up = None if i == 0 else rng.randrange(max(0, i - 5), i)
            parent[tree, i] = up
            rows.append((tree, i, up, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["x", None, "[INST] a", "</s>"]), float(rng.randint(0, 3))))
    rows.append((1, 900, 901, "user", "lost", 1.0))  # its parent does not exist
    rows += [(1, 950, 951, "user", "circle", 1.0), (1, 951, 950, "user", "circle", 1.0)]
    score = {(t, i): s for t, i, _, _, _, s in rows}
    text = {(t, i): (r or "", x or "") for t, i, _, r, x, _ in rows}
    parent[1, 900] = None
    inner = {(t, u) for (t, i), u in parent.items() if u is not None}
    want = {}
    for tree in (1, 2, None):
        branches = []
        for t, i in parent:
            if t == tree and (t, i) not in inner:
                path = [i]
                while parent[t, path[0]] is not None:
                    path.insert(0, parent[t, path[0]])
                branches.append((-sum(score[t, x] for x in path), -len(path), i, path))
        for n, (_, _, leaf, path) in enumerate(sorted(branches)[:3], 1):
            want[tree, leaf] = (n, [text[tree, x] for x in path])
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    twice = messages.union(messages.where("tree = 1")).withColumn("up", F.lit(1)).withColumn("place", F.lit("x"))
    read = C.read_back(C.formatted(C.paths(twice, best=3))).collect()
    assert {(r["tree"], r["leaf"]): (r["branch"], [tuple(m) for m in r["messages"]]) for r in read} == want
    assert all(r["loss"] == "".join(x for role, x in want[r["tree"], r["leaf"]][1] if role == "assistant") for r in read)
    assert C.paths(messages.limit(0)).count() == 0


def test_control_strings_come_back(spark):
    rng = random.Random(6)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", "[OUT]", "[AS]", "[\\OUT]", "<\\\\/s>", "x", "\n", "é"]
    rows = [(i % 9, i, rng.choice(["user", "assistant", "a[AS]b", ""]), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(300)]
    rows += [(20, 0, "assistant", "[OUT]" * 5000), (20, 1, "user", None), (20, 1, "user", None), (None, 0, "user", "no id")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.digests(frame.withColumn("tree", F.lit(1)).withColumn("id", F.lit("x"))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((t, role, x or "") for c, t, role, x in rows if c == conv)
        loss = "".join(x for _, role, x in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-7]["n_turns"] == 2 and len(got) == 12
    assert [r["conv_id"] for r in C.digests(frame.limit(0)).collect()] == [-7]


def test_deep_chain(spark):
    """A conversation of 3000 turns takes twelve rounds, not 3000."""
    frame = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    row = C.digests(frame).where("conv_id = 1").first()
    assert row["n_turns"] == 3000 and row["loss_sha256"] == hashlib.sha256("".join(f"t{i}" for i in range(1, 3000, 2)).encode()).hexdigest()
