"""Subword ids against the tokenizers library, ORC and WARC round trips, trie counts against a plain Viterbi."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmill.llm import bpe_trie, orc_tokens, pivot_search, subword, trie_counts, warc
from lexmill.llm.queries import tokenizer_file

PATH = tokenizer_file()
LIBRARY = Tokenizer.from_file(PATH)
ALPHABET = "abcdefgtheinorst'ABCéèÉñ0123 .,*$<|endoftext|>\x1c\x85\xa0　日本İßœ́ǅΣς½²ªﬁ😀"


@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), max_size=20))
@settings(max_examples=150, deadline=None)
def test_trie_encodes_as_the_library(texts):
    got = bpe_trie.trie_cache(PATH)[1].encode(pa.array(texts, pa.string()))
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in got] == want


def test_long_words():
    texts = ["a" * n for n in range(60)] + ["abab" * n for n in range(40)] + ["!" * n for n in range(40)]
    got = bpe_trie.trie_cache(PATH)[1].encode(pa.array(texts))
    assert [g.tolist() for g in got] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_op10(odd, docs, none):
    for table in (odd, docs):
        texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in table.collect())
        out = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_trie.digests(table, PATH).collect()))
        want = []
        for null, i, t in texts:
            ids, back = expected(t)
            want.append((null, i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert out == sorted(want)
    assert bpe_trie.digests(none, PATH).count() == 0


def test_extra_columns_stay(odd):
    out = bpe_trie.round_trip(odd, PATH)
    assert out.columns == [*odd.columns, "token_ids", "decoded"]
    apart = bpe_trie.decode(bpe_trie.encode(odd, PATH), PATH)
    assert sorted(map(str, apart.collect())) == sorted(map(str, out.collect()))


def test_op2(odd, docs, none, tmp_path):
    for k, table in enumerate((odd, docs, none)):
        path = f"file://{tmp_path}/t{k}"
        out = orc_tokens.round_trip(table, PATH, path).collect()
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in table.collect()))
        out.sort(key=lambda r: r["start"])
        assert len(out) == len(rows)
        want = sorted((n, i, zlib.crc32(np.array(expected(t)[0] + [1], "<u4").tobytes()), len(expected(t)[0]) + 1) for n, i, t in rows)
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"], r["n_tokens"]) for r in out) == want
        at = 0
        for r in out:
            assert r["start"] == at
            at += r["n_tokens"]
        assert [r["doc_id"] or -1 for r in out] == sorted(r["doc_id"] or -1 for r in out) or k == 0


def test_orc_lookup(docs, tmp_path, spark):
    path = f"file://{tmp_path}/t"
    orc_tokens.write_orc(docs, path, PATH)
    row = orc_tokens.read_orc(spark, path).where("doc_id = 7").collect()
    assert len(row) == 1 and row[0]["token_ids"][-1] == 1 and row[0]["n_tokens"] == len(row[0]["token_ids"])


def test_op9(spark):
    big = "é<html>\r\nWARC/1.1\r\n" + "x" * 1200
    rows = [(1, "http://a.example/p?q", big), (2, None, big), (3, "http://b.example", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "http://c\r\nX: y/", ""), (None, "u", big), (2, "u", big), (8, "u", "\r\n\r\n" + big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.round_trip(pages).collect()
    assert len(out) == len(rows)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in out)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h == big and i != 3
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", "3" if again else "None"))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_captures_hold_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/x", "<p>\r\n\r\nhello</p>")], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    row = warc.captures(warc.read_warc(spark, f"file://{tmp_path}/w")).first()
    assert bytes(row["response"]["payload"]).decode() == "<p>\r\n\r\nhello</p>" and row["page_id"] == 1
    assert row["request"]["target_uri"] == "http://a.example/x" and row["metadata"]["id"] == row["capture_id"].replace(":main>", ":metadata>")


def test_captures_keep_their_own_requests(spark, tmp_path):
    """Rows that repeat a page_id, with other URLs, other payloads or nothing else, are captures with requests of their own."""
    big = "z" * 1500
    rows = [(1, "http://a/x", "one"), (1, "http://b/y", "one"), (1, "http://b/y", "two"), (1, "http://b/y", "two"), (1, "http://b/y", "two"), (2, "http://c/", big), (2, "http://d/", big), (3, "http://e/", big), (3, "http://e/", big), (None, "http://f/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(pages, f"file://{tmp_path}/w")
    records = warc.read_warc(spark, f"file://{tmp_path}/w").cache()
    assert records.select("id").distinct().count() == 3 * len(rows)
    out = warc.captures(records).collect()
    assert sorted((str(r["page_id"]), r["response"]["target_uri"]) for r in out) == sorted((str(i), u) for i, u, _ in rows)
    assert all(r["request"]["target_uri"] == r["metadata"]["target_uri"] == r["response"]["target_uri"] for r in out)
    ids = {r["capture_id"]: r for r in out}
    revisits = [r for r in out if r["response"]["type"] == "revisit"]
    assert len(revisits) == 3 and all(ids[r["response"]["refers_to"]]["page_id"] == 3 for r in revisits)
    lost = records.where("not (type = 'response' and page_id = 3)")
    with pytest.raises(Exception, match="no such payload"):
        warc.resolved(lost).collect()


def viterbi(text, pieces, byte_score):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            p = pieces.get(text[start:end])
            if p is not None:
                s, n = best[start][0] + p, best[start][1] + 1
                if s > best[end][0] + 1e-12 or (abs(s - best[end][0]) <= 1e-12 and n < best[end][1]):
                    best[end] = s, n
        if text[end - 1] not in pieces:
            k = len(text[end - 1].encode())
            s, n = best[end - 1][0] + k * byte_score, best[end - 1][1] + k
            if s > best[end][0]:
                best[end] = s, n
    return best[-1]


def test_op8(odd, docs, none):
    path = tokenizer_file("piece_bpe_32k.model")
    pieces, byte = trie_counts.zipf_pieces(path)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if len(r["text"] or "") < 600}
    out = {r["doc_id"]: r for r in trie_counts.counts(docs, path).collect()}
    for i, t in texts.items():
        words = t.encode().split()
        parts = [viterbi("▁" + w.decode(), pieces, byte) for w in words]
        assert out[i]["n_words"] == len(words) and out[i]["n_tokens"] == sum(n for _, n in parts)
        assert math.isclose(out[i]["log_prob"], sum(s for s, _ in parts), rel_tol=1e-9, abs_tol=1e-9)
    assert trie_counts.counts(odd, path).count() == odd.count() and trie_counts.counts(none, path).count() == 0


@pytest.mark.parametrize("k", [1, 5])
def test_op7(spark, k):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 3, 4).astype(float).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 2.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (304, [1.0, 2.0]), (350, [1.0, 1.0]), (None, [0.0] * 4)]
    table = pivot_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = pivot_search.top_k(table, table.where("vec_id % 50 = 0"), k)
    fine = {i: np.floor(256 * np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q, x in fine.items():
        if q % 50 == 0:
            scored = sorted((-int(x @ y), i) for i, y in fine.items() if i != q and len(y) == len(x))[:k]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert pivot_search.top_k(table.limit(0), table.limit(0), k).count() == 0


def test_pivots_leave_candidates_out():
    rng = np.random.default_rng(2)
    x = np.floor(np.concatenate([rng.normal(c, 1, (200, 8)) for c in (-200, 0, 200)]))
    found, computed = pivot_search.pivot_search(np.arange(600), x, np.array([5]), x[5:6], 3)
    scores = x @ x[5]
    scores[5] = -np.inf
    assert [v for _, v, _ in found] == np.lexsort((np.arange(600), -scores))[:3].tolist() and computed < 600


def test_seeds_leave_candidates_out(spark):
    """On the embeddings themselves: what a sample has reached spares scores in every block, and loses nothing."""
    table = pivot_search.quantised(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["vector"] for r in table])
    asked = np.flatnonzero(ids % 50 == 0)
    q, q_ids = x[asked], ids[asked]
    reached = pivot_search.reached_scores(ids[::2], x[::2], q_ids, q, 5)
    alone, n_alone = pivot_search.pivot_search(ids, x, q_ids, q, 5)
    seeded, n_seeded = pivot_search.pivot_search(ids, x, q_ids, q, 5, None, reached)
    print("scores computed:", n_alone / (len(q) * len(x)), "seeded", n_seeded / (len(q) * len(x)))
    assert seeded == alone and n_seeded <= n_alone < len(q) * len(x)
    scores = x @ x.T
    for i, v in zip(asked, q_ids):
        row = scores[i].copy()
        row[i] = -np.inf
        assert [b for a, b, _ in seeded if a == v] == ids[np.lexsort((ids, -row))[:5]].tolist()
    pivots, _ = pivot_search.pivot_table(x)
    far = lambda p: pivot_search._distances(p, p)[~np.eye(len(p), dtype=bool)].min()
    spaced = pivot_search._lifted(x, (x * x).sum(1).max())[np.linspace(0, len(x) - 1, len(pivots)).astype(int)]
    assert far(pivots) > far(spaced)


def test_pretokens_are_encoded_by_the_model_alone():
    """op2's words of plain Latin-1 need no normalizing and cutting by the library; its ids are those of the whole texts."""
    path = tokenizer_file()
    encoder = subword.LibraryEncoder(path)
    library, encoder.tokenizer = encoder.tokenizer, None
    rng = np.random.default_rng(7)
    letters = [chr(c) for c in range(0x20, 0x100)] + list("aeiourstn  '") * 20
    texts = ["".join(rng.choice(letters, 80)).replace("<|", "") for _ in range(300)]
    cache = subword.ChunkCache(encoder.pretokens, encoder.chunks, most_bytes=1 << 18)
    for some in (texts[:150], texts[150:], texts):
        assert [x.tolist() for x in cache.encode(pa.array(some))] == [library.encode(x, add_special_tokens=False).ids for x in some]
