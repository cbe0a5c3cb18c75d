"""Near duplicates, fingerprints, mixing, classifier, language model and pipeline against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import attention_lm, gam_quality, hyperminhash, imatch, mixing, neardup
from lexmill.llm.queries import oracle_sql, queries, tokenizer_file

DIR = "/root/testdata/sf0.001"


def shingles(text, width):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    return frozenset(zip(*[words[i:] for i in range(width)])) if len(words) >= width else frozenset([tuple(words)] if words else [])


def brute_classes(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_classes(docs, width):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(docs, width).collect()}
    assert out == brute_classes(rows, width, 80)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "PART", 20)
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[j] = f"x{i}_{j}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[0][1]) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(table, 2).collect()}
    assert out == brute_classes(rows, 2, 80)


def test_classes_of_odd_rows(odd, none):
    out = neardup.classes(odd, 2).collect()
    assert len(out) == odd.count()
    by_id = {r["doc_id"]: r for r in out}
    for i in (0, 1, 2):
        assert by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i and by_id[i]["kept"]
    assert by_id[13]["component_id"] == 12 and not by_id[13]["kept"]
    assert neardup.classes(none, 2).count() == 0
    kept = neardup.deduplicate(odd, 2)
    assert kept.columns == odd.columns and 13 not in {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_batches_of_few_words(width):
    for texts in (["a b"], ["", None], ["a", ""], ["a b c"], [], ["A b c d e f"]):
        got = hyperminhash.shingle_sets(pa.array(texts, pa.string()), width)
        assert [len(s) for s in got] == [len(shingles(t, width)) for t in texts]


def test_one_row_of_a_class_stays(spark):
    """Rows that repeat an id, with the same text or another, and rows without one."""
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "x30")
    rows = [(1, text, "a"), (1, text, "a"), (1, near, "b"), (1, "quite other words stand here " * 4, "c"), (2, near, "d"), (3, "quite other words stand here " * 4, "e"), (4, "alone and short", "f"), (5, "", "g"), (5, "", "g"), (6, None, "h"), (None, text, "i"), (None, "only rows without an id have this text here", "j"), (7, "", "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = [tuple(r) for r in neardup.deduplicate(table, 5).collect()]
    assert sorted(map(str, (r[0] for r in out))) == sorted(map(str, [1, 4, 5, 6, 7, None, None]))
    assert len([r for r in out if r[0] == 1]) == 1 and not {r[0] for r in out} & {2, 3}


def test_estimates():
    rng = np.random.default_rng(3)
    for n in (10, 100, 5000):
        both = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        a, b = both[: int(n * 0.9)], both[int(n * 0.1) :]
        got = hyperminhash.estimated(hyperminhash.registers(a)[None], hyperminhash.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - 0.8) < 0.15


def test_op5(odd, docs, none):
    for table in (odd, docs):
        rows = sorted(((-(r["doc_id"]) if r["doc_id"] is not None else 1 << 60, r["text"] or "", r["doc_id"]) for r in table.collect()))
        want = []
        for n, (_, t, i) in enumerate(rows):
            k, after = len(t) // 3, rows[(n + 1) % len(rows)][1]
            want.append((str(i), len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()))
        out = imatch.fingerprints(table).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == sorted(want)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {}
    for r in out:
        prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert max(map(len, prints.values())) == 1
    assert np.mean([r["near_edited"] for r in out]) > 5 * np.mean([r["near_next"] for r in out])
    assert imatch.fingerprints(none).count() == 0


def test_ranges_meet(docs):
    """Cut into many ranges of doc_id, every row still gets the document after it."""
    out = imatch.with_next(docs, rows=7).collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    after = {rows[n][0]: rows[(n + 1) % len(rows)][1] for n in range(len(rows))}
    assert {r["doc_id"]: r["next_text"] for r in out} == after and len({r["bucket"] for r in out}) > 10


def test_raking_meets_targets_under_the_bound():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 100, 60).astype(float)
    tokens[3] = 4000.0
    groups = [rng.integers(0, n, 60) for n in (6, 3)]
    total = 0.5 * tokens.sum()
    goals = [mixing.goals_of(np.bincount(g, tokens, n), e, total) for g, n, e in zip(groups, (6, 3), (0.5, 0.7))]
    assert all(math.isclose(g.sum(), total, rel_tol=1e-9) for g in goals)
    u = mixing.rake(tokens, groups, goals, 300)
    assert (u > 1).any() and max(mixing.gaps(tokens, groups, goals, u)) < 1e-6
    # one group's factor by bisection
    one = np.zeros(60, int)
    for goal in (10.0, 0.3 * tokens.sum(), 0.99 * tokens.sum()):
        rates = rng.random(60) + 0.01
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (tokens * np.minimum(1, rates * mid)).sum() < goal else (low, mid)
        assert np.allclose(np.minimum(mixing.filled(one, tokens, rates, np.array([goal])), 1), np.minimum(rates * low, 1), rtol=1e-6)
    assert (mixing.filled(one, tokens, rates, np.array([0.0])) == 0).all() and (mixing.filled(one, tokens, rates, np.array([tokens.sum() * 2])) >= 1).all()


def test_op6(spark, docs, odd, none):
    assert mixing.with_probabilities(odd).count() == odd.count() and mixing.with_probabilities(none).count() == 0
    assert mixing.sample(odd).columns == odd.columns
    big, _ = mixing.calibrated(docs, sweeps=12)
    by_frames, bounded = mixing.calibrated(docs, most_cells=1, sweeps=12)
    one = {tuple(r[m] for m in mixing.MARGINS): r["probability"] for r in big.collect()}
    two = {tuple(r[m] for m in mixing.MARGINS): r["probability"] for r in by_frames.collect()}
    assert not bounded and one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)
    # explicit targets: nothing of what has none, and the shares asked for
    aimed, _ = mixing.calibrated(docs, budget=0.2, sweeps=60, targets={"source": {"src0": 0.6, "src1": 0.4, "nowhere": 0.5}})
    tokens = {tuple(r[m] for m in mixing.MARGINS): r["tokens"] for r in mixing.cells(docs).collect()}
    by_source = Counter()
    for r in aimed.collect():
        by_source[r["source"]] += r["probability"] * tokens[tuple(r[m] for m in mixing.MARGINS)]
    assert {s for s, n in by_source.items() if n > 0} <= {"src0", "src1"}


def test_sample_comes_to_its_margins(spark):
    """On real cells the expected shares of the sample are the targets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(tuple(r[m] for m in mixing.MARGINS), r["tokens"]) for r in mixing.cells(docs).collect()]
    chance = {tuple(r[m] for m in mixing.MARGINS): r["probability"] for r in mixing.calibrated(docs)[0].collect()}
    total = sum(n for _, n in rows)
    for i, m in enumerate(mixing.MARGINS):
        sums, got = Counter(), Counter()
        for k, n in rows:
            sums[k[i]] += n
            got[k[i]] += n * chance[k]
        values = sorted(sums)
        want = mixing.goals_of(np.array([sums[v] for v in values]), mixing.TEMPER[m], mixing.BUDGET * total)
        assert np.abs(np.array([got[v] for v in values]) - want).max() / want.sum() < 0.005, m


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(name, spark):
    c = duckdb.connect()
    # on the smallest table raking has not settled after its sweeps, and rounding shows
    folder = DIR.replace("sf0.001", "sf0.01") if name == "op6_mixing" else DIR
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    theirs = c.execute(oracle_sql()[name]).df()
    ours = queries()[name](spark, folder).toPandas()
    plain = lambda df: sorted(tuple("" if str(x) in ("None", "nan", "<NA>") else f"{float(x):.6g}" if not isinstance(x, str) else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(ours) == plain(theirs)


def test_op4(spark, odd, none):
    labels, documents = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("labels", "documents"))
    out = {r["doc_id"]: r for r in gam_quality.predictions(documents, labels).collect()}
    held = [(out[r["doc_id"]], r["quality"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    good = [r["score"] for r, q in held if q == 1]
    bad = [r["score"] for r, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in out.items())
    model = gam_quality.fit(odd, labels.limit(0))
    scored = gam_quality.score(odd, model)
    assert {r["score"] for r in scored.collect()} == {0.5} and gam_quality.score(none, model).count() == 0


def test_op3(docs, odd, none, spark):
    path = tokenizer_file("byte_bpe_50k.json")
    for table in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() for _, t in rows]
        mod = [zlib.crc32(str(i).encode()) % 7 if i is not None else None for i, _ in rows]
        counts = Counter()
        for w, m in zip(words, mod):
            if m is not None and m != 2:
                counts.update(w)
                counts[None] += 1
        total, kinds = sum(counts.values()), len(counts)
        want = []
        for (i, _), w, m in zip(rows, words, mod):
            toks = [*w, None]
            want.append((str(i), m == 2, len(toks), sum(counts[t] > 0 for t in toks), total, round(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in toks), 3)))
        out = attention_lm.scores(table, path).collect()
        assert sorted((str(r["doc_id"]), bool(r["held_out"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in out) == sorted(want)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert attention_lm.scores(none, path).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 300).astype(float)
    starts = rng.random(300) < 0.5
    model = attention_lm.AttentionLm(counts, starts, 299)
    for n in model.w:
        model.w[n] = model.w[n].astype(np.float64)
    ids = rng.integers(0, 300, 90)
    at, low, high = attention_lm.windows(np.array([0, 50, 90]))
    grads, _ = model.gradients(ids, at, low, high)
    for n in attention_lm.SHAPES:
        i = np.unravel_index(np.abs(grads[n]).argmax(), grads[n].shape)
        was, losses = model.w[n][i], []
        for step in (1e-4, -1e-4):
            model.w[n][i] = was + step
            losses.append(model.gradients(ids, at, low, high)[1])
        model.w[n][i] = was
        assert math.isclose((losses[0] - losses[1]) / 2e-4, grads[n][i], rel_tol=2e-2, abs_tol=1e-5)


def test_windows_predict_each_id_once():
    bounds = np.array([0, 1, 18, 18 + 33, 200])
    at, low, high = attention_lm.windows(bounds)
    seen = np.concatenate([np.arange(a, min(a + attention_lm.SCORED, h)) for a, h in zip(at, high)])
    assert sorted(seen.tolist()) == list(range(200))


def test_pipeline(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{DIR}/documents.parquet")
    before, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DIR)
        assert after.columns == columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "near_duplicates":
            want = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert ids == {i for i, (_, c) in want.items() if i == c}
        before = spark.createDataFrame(after.collect(), documents.schema)
    out = corpus_pipeline.run(spark, DIR)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == ids


def test_pipeline_stages_take_odd_rows(spark, odd, none, tmp_path):
    """Nulls, empty and very long texts, repeats, an empty table and clashing names, stage by stage."""
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    clash = odd.selectExpr("*", "1 AS n_tokens", "'x' AS token_ids", "2 AS decoded_sha256", "3.5D AS __score", "4 AS score", "'t' AS topic", "true AS kept", "5 AS node", "6 AS weight")
    for table in (clash, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name == "subword_ids":
                added = ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
                assert out.columns == [c for c in table.columns if c not in added] + added
                got = sorted((str(r["doc_id"]), r["n_tokens"], hashlib.sha256(bytes(r["token_ids"])).hexdigest() == r["ids_sha256"]) for r in out.collect())
                assert len(got) == table.count() and all(fine for _, _, fine in got)
            else:
                assert out.columns == table.columns
                rows = sorted(map(str, out.collect()))
                assert set(rows) <= set(map(str, table.collect()))


def test_op6_topics_are_of_the_most_frequent_term(spark, docs, odd):
    """The topic of every document, by a plain count of its whole text's terms."""

    def plain(text):
        terms = Counter(t for t in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if len(t) >= 5)
        return f"topic-{int(hashlib.md5(min(terms, key=lambda t: (-terms[t], t.encode())).encode()).hexdigest()[:8], 16) % 8}" if terms else "none"

    for rows in (docs, odd):
        got = mixing.with_probabilities(rows).select("text", "topic").collect()
        assert len(got) == rows.count() and all(r["topic"] == plain(r["text"]) for r in got)
    wanted = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["topic"] for r in mixing.report(docs).collect()} == wanted
