"""The language model's score against a plain loop over ids, its independence of partitions, and held-out quality."""

import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lexmill.llm import attention_lm as A
from lexmill.llm.common import cut, keep_freed_memory
from lexmill.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


def ids_of(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    out = []
    for w in words:
        out += A.word_ids(PATH).tokenizer.encode(" " + w.decode(), add_special_tokens=False).ids
    return [*out, A.word_ids(PATH).end]


def plain_log_prob(model, ids, t):
    """Natural log probability of ``ids[t]``: one query, a loop over what it sees, two softmaxes."""
    w = {n: v.astype(np.float64) for n, v in model.w.items()}
    first = t // A.SCORED * A.SCORED - A.CONTEXT
    seen = range(max(first, 0), t + 1)
    x = {j: w["e"][model.slot[ids[j - 1]] if j else model.end_slot] + w["p"][j - first] for j in seen}
    q = x[t] @ w["q"] / math.sqrt(A.DIM)
    s = np.array([q @ x[j] + w["r"][t - j] for j in seen])
    s = np.exp(s - s.max())
    h = x[t] + sum(p * x[j] for p, j in zip(s / s.sum(), seen)) @ w["o"]
    c, m = divmod(int(model.slot[ids[t]]), A.MEMBERS)
    log_softmax = lambda z: z - z.max() - math.log(np.exp(z - z.max()).sum())
    return log_softmax(w["u"] @ h + w["b"])[c] + log_softmax(w["m"][c] @ h + w["c"][c])[m] + float(model.within[ids[t]])


def brute(rows, model):
    """(attention_score, score) of each (doc_id, text): stretch by stretch, with the memory counted over all other training documents."""
    documents = [(ids_of(t), i is not None and zlib.crc32(str(i).encode()) % 7 != 2) for i, t in rows]
    key = lambda ids, at: (tuple(ids[at - A.BEFORE : at]), tuple(ids[at : at + A.STRETCH]))
    places = lambda ids: range(A.STRETCH, len(ids), A.STRETCH)
    both = Counter(k for ids, learn in documents if learn for k in {key(ids, at) for at in places(ids)})
    before = Counter(b for ids, learn in documents if learn for b in {key(ids, at)[0] for at in places(ids)})
    out = []
    for ids, learn in documents:
        p = [plain_log_prob(model, ids, t) for t in range(len(ids))]
        score = sum(p)
        for at in places(ids):
            n, m, own = before[key(ids, at)[0]] - learn, both[key(ids, at)] - learn, sum(p[at : at + A.STRETCH])
            if n > 0:
                score += math.log((max(m, 0) + math.exp(own)) / (n + 1)) - own
        out.append((sum(p) / math.log(10), score / math.log(10)))
    return out


def model_of(table, **options):
    tokens = cut(A.encoded(table, PATH), "tokens")
    counts = np.zeros(A.word_ids(PATH).size)
    for r in tokens.where("id >= 0").groupBy("id").sum("n").collect():
        counts[r[0]] = r[1]
    return A.trained(tokens.where("ids is not null").select("doc_id", "learn", "ids"), PATH, counts, **options)


def test_score_is_that_of_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    words = ["red", "green", "river", "stone", "Été", "a", "of", "lamps", "naïve", "x1"]
    passage = " ".join(rng.choice(words, 120))
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40)))) + (" " + passage if i % 5 == 0 else "")) for i in range(30)]
    rows += [(100 + i, passage) for i in range(4)] + [(None, passage), (200, None), (201, ""), (300, "alone " * 400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    options = {"warm_documents": 5, "bucket_ids": 200}
    model = model_of(table, **options)
    got = sorted((str(r["doc_id"]), round(r["attention_score"], 3), round(r["score"], 3)) for r in A.scores(table, PATH, **options).collect())
    want = sorted((str(i), round(a, 3), round(s, 3)) for (i, _), (a, s) in zip(rows, brute(rows, model)))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in want], atol=5e-3)
    # a passage that occurs elsewhere is told by its score, a text of its own is not
    apart = {g[0]: g[2] - g[1] for g in got}
    assert apart["100"] > 20 and abs(apart["200"]) < 1e-9
    # what a document repeats in itself is not remembered
    assert abs(apart["300"]) < 1e-9


def test_partitions_do_not_count(spark, docs):
    one, eight = (model_of(docs.repartition(n).select("doc_id", "text"), bucket_ids=20_000).pack() for n in (1, 8))
    assert np.abs(one - eight).max() < 1e-5


def test_training_takes_all_windows(spark, docs):
    """Every window of the training documents is in the weights' average."""
    seen = []
    tokens = cut(A.encoded(docs.select("doc_id", "text"), PATH), "tokens")
    for r in tokens.where("learn and ids is not null").collect():
        seen.append(-(-(len(r["ids"]) // 2) // A.SCORED))
    counts = np.ones(A.word_ids(PATH).size)
    total = []
    real = A.cut
    A.cut = lambda df, name: (total.append(df) if name == "weights" else None, real(df, name))[1]
    try:
        A.trained(tokens.where("ids is not null").select("doc_id", "learn", "ids"), PATH, counts, 20)
    finally:
        A.cut = real
    assert total[0].agg({"seen": "sum"}).first()[0] == sum(seen)


def test_held_out_documents(spark):
    """On held-out documents the attention model's own score is near that of smoothed counts, which need not spell unknown words."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = [r for r in A.scores(table, PATH).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in out)
    base, own, score = (sum(r[c] for r in out) / tokens for c in ("base_score", "attention_score", "score"))
    print("held out: base", base, "attention", own, "score", score, "better", np.mean([r["score"] > r["base_score"] for r in out]))
    assert own > base - 0.5 and score > own


def test_counts_are_found():
    rng = np.random.default_rng(7)
    for n in (0, 1, 3, 5000):
        h = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64))
        numbers = np.arange(len(h)) + 5
        table = A.Counts(h, numbers)
        asked = np.concatenate([h, rng.integers(-(1 << 63), (1 << 63) - 1, 100, dtype=np.int64)])
        want = dict(zip(h.tolist(), numbers.tolist()))
        assert table.of(asked).tolist() == [want.get(x, -1) for x in asked.tolist()]


def test_words_are_encoded_by_the_model_alone():
    """op3's plain Latin-1 words do not go through the library's cutting; ids are the library's all the same."""
    words = A.WordIds(PATH)
    library, words.tokenizer = words.tokenizer, None
    rng = np.random.default_rng(9)
    letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x100)] if not 65 <= c <= 90] + list("aeiourstn,'12") * 20
    some = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 14, 9000)]
    ids, _ = words.documents(*words.rows_of(pa.array([" ".join(some)])))
    assert ids.tolist() == [i for w in some for i in library.encode(" " + w, add_special_tokens=False).ids] + [words.end]


def small_model(rng, vocabulary=3000):
    model = A.AttentionLm(rng.integers(0, 50, vocabulary) ** 2, rng.random(vocabulary) < 0.5, 7)
    for n in ("r", "b", "c"):
        model.w[n] += (rng.standard_normal(model.w[n].shape) * 0.3).astype(np.float32)
    return model


def test_slopes_are_those_of_the_loss():
    """op3's steps go through blocks with factors in place of biases: slopes are held against differences of the plain loss."""
    rng = np.random.default_rng(5)
    model = small_model(rng)
    bounds = np.cumsum([0, 1, 3, 28, 29, 200, *[56] * 80, 61, 17])  # more windows than a block has, some not whole
    ids = rng.integers(0, 3000, bounds[-1])
    at, low, high = A.windows(bounds)
    assert len(at) > 2 * A.BLOCK
    g, loss = model.gradients(model.framed(ids), at, low, high)
    share = model.within[ids]
    mean = lambda: float(-(model.log_probs_of(ids, bounds) - share).astype(np.float64).mean())
    assert math.isclose(loss, mean(), rel_tol=1e-5)
    plain = [plain_log_prob(model, ids[a:b].tolist(), t) for a, b in zip(bounds[:6], bounds[1:7]) for t in range(b - a)]
    assert np.allclose(plain, model.log_probs_of(ids, bounds)[: len(plain)], atol=1e-4)
    for n, slope in g.items():
        held, way = model.w[n], rng.standard_normal(A.SHAPES[n]).astype(np.float32)
        way += np.sign((slope * way).sum()) * slope / np.abs(slope).max() * 3  # a way on which the loss changes
        way *= 0.03 / np.abs(way).max()
        model.w[n] = held + way
        more = mean()
        model.w[n] = held - way
        change, model.w[n] = (more - mean()) / 2, held
        assert math.isclose(change, float((slope * way).sum()), rel_tol=0.02, abs_tol=2e-5), n


def test_large_logits_are_clipped():
    """Weights that allow powers beyond float32 are told by their rows' lengths."""
    model = small_model(np.random.default_rng(6))
    assert not model.prepared()["clip"]
    model.w["e"] *= 200
    assert model.prepared()["clip"]
    out = model.log_probs_of(np.arange(500), np.array([0, 200, 500]))
    assert np.isfinite(out).all()


def test_scoring_an_id_takes_little_time():
    """op3's layer takes at most 0.3 ms a thousand ids on a machine where a sum of 50,000 numbers takes 1 ms."""
    rng = np.random.default_rng(8)
    model, bounds = small_model(rng), np.arange(0, 150_001, 1000)
    ids = rng.integers(0, 3000, bounds[-1])

    def least(f):
        times = []
        for _ in range(7):
            t = time.thread_time()
            f()
            times.append(time.thread_time() - t)
        return min(times)

    keep_freed_memory()
    took = least(lambda: model.log_probs_of(ids, bounds)) / len(ids)
    assert took / (least(lambda: sum(range(50_000))) * 1000) < 0.3e-6


def test_packed_ids_are_read_in_place():
    values = [b"", b"\x01\x00\x02\x00", b"\x03\x00", b""]
    for column in (pa.array(values, pa.binary()), pa.array([b"\x09\x09", *values, b"\x07\x07"], pa.large_binary()).slice(1, 4)):
        ids, bounds = A._documents(column, np.dtype("<u2"))
        assert ids.tolist() == [1, 2, 3] and bounds.tolist() == [0, 0, 2, 3, 3] and not ids.flags.owndata
    assert A._documents(pa.array([], pa.binary()), np.dtype("<u2"))[1].tolist() == [0]


def test_words_are_dropped_after_encoding():
    """op3's later passes keep the vocabulary alone, and encoding begins anew after them."""
    words = A.word_ids(PATH)
    text = pa.array(["some words of a text", None])
    first = words.documents(*words.rows_of(text))
    assert A.without_words(PATH) is words and len(words.rows) == 1
    again = words.documents(*words.rows_of(text))
    assert all((a == b).all() for a, b in zip(first, again)) and len(words.rows) == 6
