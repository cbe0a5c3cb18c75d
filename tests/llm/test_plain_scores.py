"""Fingerprints and the classifier's scores against plain Python."""

import math
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lexmill.llm import gam_quality, imatch


def terms(text):
    return set(re.split(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~]+", (text or "").lower())) - {""}


def in_subset(term, k):
    h = xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(term.encode(), 42))
    return (h - (1 << 64) if h >> 63 else h) % imatch.RATES[k] == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_fingerprints(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    rows += [(-1, ""), (-2, "!!"), (-3, rows[0][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r["term"]: r for r in imatch.lexicon(table).collect()}
    df = Counter(t for _, x in rows for t in terms(x))
    low, high = max(2, math.ceil(0.001 * len(rows))), max(2, math.floor(0.15 * len(rows)))
    # copies count as one towards the upper end, for terms as for documents, so that end is not just at a fifth of the rows
    assert {t for t, n in df.items() if low <= n <= high} <= set(held) <= {t for t, n in df.items() if n >= low}
    assert all((r["mask"] >> k & 1) == in_subset(t, k) for t, r in held.items() for k in (0, 1, 7, 40))

    def subsets(text):
        own = sorted(held[t]["id"] for t in terms(text) if t in held)
        mask = {held[t]["id"]: held[t]["mask"] for t in terms(text) if t in held}
        return [tuple(i for i in own if mask[i] >> k & 1) for k in range(imatch.SUBSETS)] if own else [("text", text)] * imatch.SUBSETS

    def likeness(a, b):
        some = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in some) / len(some) if some else 0.0

    out = {r["doc_id"]: r for r in imatch.fingerprints(table).collect()}
    prints = {}
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        k = len(text) // 3
        own, edited = subsets(text), subsets(text[: len(text) - k] + after[:k])
        assert math.isclose(out[i]["near_edited"], likeness(own, edited), abs_tol=1e-12), i
        assert math.isclose(out[i]["near_next"], likeness(own, subsets(after)), abs_tol=1e-12), i
        prints.setdefault(tuple(own), set()).add(out[i]["fingerprint"])
        prints.setdefault(tuple(edited), set()).add(out[i]["edited_fingerprint"])
        if own[0] and own[0][0] != "text":
            assert [p == "-" for p in out[i]["fingerprint"].split(".")] == [not s for s in own]
    assert max(map(len, prints.values())) == 1 and len({f for s in prints.values() for f in s}) == len(prints)


def test_scores_are_sums_of_looked_up_bins():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, len(gam_quality.FEATURES)))
    y = (x[:, 3] + x[:, 5] * x[:, 7] > 0).astype(float)
    model = gam_quality.fit_gam(x, y, rounds=20, pair_rounds=10)
    got = model.score(x)
    for row, s in zip(x[:60], got):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert math.isclose(s, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_features_by_hand():
    text = "One two. TWO three!!!\nlast line, 42"
    names = dict(zip(gam_quality.FEATURES, gam_quality.features(pa.array([text, None, ""]))[0]))
    words, n = text.split(), len(text)
    assert math.isclose(names["log_bytes"], math.log1p(n)) and math.isclose(names["log_words"], math.log1p(len(words)))
    assert math.isclose(names["word_bytes"], sum(map(len, words)) / len(words)) and math.isclose(names["distinct_words"], 1.0)
    assert math.isclose(names["digit"], 2 / n) and math.isclose(names["upper"], sum(c.isupper() for c in text) / n) and math.isclose(names["shouts"], 3 / n)
    assert math.isclose(names["capitalised"], 2 / len(words)) and math.isclose(names["short_words"], sum(len(w) <= 3 for w in words) / len(words)) and math.isclose(names["tripled"], 1 / n)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    assert math.isclose(names["entropy"], entropy)
    blank = gam_quality.features(pa.array([None, ""]))
    assert (blank[0] == blank[1]).all() and np.isfinite(blank).all()
