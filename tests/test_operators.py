"""Sequential operators against plain Python, and the properties that hold whatever the input."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import chunking as K
from lexmill.operators import fusion as U
from lexmill.operators import graph as G
from lexmill.operators import groups as GR
from lexmill.operators import lexical as L
from lexmill.streaming import ops as X

PIECE = st.fixed_dictionaries({"content": st.text(max_size=12), "reasoning_content": st.text(max_size=12), "done": st.just(False), "error": st.none()})


@given(st.lists(PIECE, max_size=30), st.integers(0, 40))
@settings(max_examples=100, deadline=None)
def test_buffering_loses_nothing(chunks, size):
    out = X.buffered([*chunks, {"content": "", "reasoning_content": "", "done": True, "error": None}], size)
    for k in ("content", "reasoning_content"):
        assert "".join(c[k] for c in out) == "".join(c[k] for c in chunks)
    assert out[-1]["done"]


@given(st.lists(st.tuples(st.text(alphabet="ab ", min_size=1, max_size=30).filter(str.strip), st.booleans()), max_size=20), st.integers(5, 60))
@settings(max_examples=100, deadline=None)
def test_packing_keeps_every_piece(parts, size):
    chunks = K.packed([(t, p, "") for t, p in parts], size)
    assert "\n\n".join(c for c, _ in chunks) == "\n\n".join(t for t, _ in parts)


def test_packing_rules():
    assert K.packed([("a" * 50, False, "")], 10) == [("a" * 50, "")]  # a long piece stays whole
    two = K.packed([("a" * 8, False, "One"), ("b" * 8, False, "Two")], 10)
    assert two == [("a" * 8, "Two"), ("b" * 8, "Two")]  # the heading of the piece that closed it
    assert len(K.packed([("a" * 5, False, ""), ("b" * 5, False, "")], 12, 5)) == 1
    # a protected piece that is too long is closed at once and does not take the next piece's heading
    assert K.packed([("| x |" * 9, True, ""), ("b", False, "Next")], 20) == [("| x |" * 9, ""), ("b", "Next")]
    # a protected piece adds two to an empty chunk: 6 + 2 + 4 + 2 is beyond 13
    assert K.packed([("p" * 6, True, ""), ("b" * 4, False, "")], 13) == [("p" * 6, ""), ("b" * 4, "")]
    assert K.packed([("p" * 6, False, ""), ("b" * 4, False, "")], 13) == [("p" * 6 + "\n\n" + "b" * 4, "")]
    # overlap takes the last piece whatever its length
    assert K.packed([("a" * 8, False, ""), ("b" * 8, False, "")], 10, 5) == [("a" * 8, ""), ("a" * 8 + "\n\n" + "b" * 8, "")]
    assert K.overlap_tail(["aa", "bbb", "c"], 4) == ["bbb", "c"] and K.overlap_tail(["aa"], 0) == []


def test_headings():
    assert all(map(K.is_heading, ["# Title", "1.2 intro", "3 x", "## " + "long " * 40, "ABSTRACT", "A. B!"]))
    assert not any(map(K.is_heading, ["#hash", "1.2intro", "", "Plain line", "A", "A" * 120]))
    text = "lead\n# One\nfirst\n\n2. two\nsecond"
    assert K.segments(text) == [("lead", False, ""), ("# One\nfirst", False, "# One"), ("2. two\nsecond", False, "2. two")]
    assert K.segments("one\n\n\ntwo") == [("one", False, ""), ("two", False, "")]
    # one piece alone is cut at blank lines and unnamed
    assert K.segments("# Only\n\nbody") == [("# Only", False, ""), ("body", False, "")]


def test_pages_are_packed_paragraphs():
    assert K.pages_of("", 10) == [""]
    assert K.pages_of("a" * 8 + "\n\n" + "b" * 8 + "\n\nc", 12) == ["a" * 8, "b" * 8 + "\n\nc"]


def test_protected_regions():
    text = "intro\n| a | b |\n| c | d |\nend $$x\ny$$ and \\[z\\]\na | b\nc | d"
    spans = [text[a:b] for a, b in K.protected_regions(text)]
    assert spans == ["| a | b |\n| c | d |\n", "$$x\ny$$", "\\[z\\]"]  # rows without a pipe at both ends are no table


def test_cjk_tokens(spark):
    row = spark.createDataFrame([("État 数据库 a x1",)], "t string").select(T.tokens(F.col("t")).alias("k")).first()
    assert sorted(row["k"]) == sorted(["tat", "数", "据", "库", "数据", "据库", "数据库", "x1"])


def test_query_types(spark):
    df = spark.createDataFrame([("请总结全文",), ("why is it so",), ("give the exact number",), ("hello",)], "t string")
    assert [r[0] for r in df.select(T.query_type(F.col("t"))).collect()] == ["overview", "analytical", "extraction", "specific"]


def test_inline_refs(spark):
    df = spark.createDataFrame([("a [2] b [1](x) ![3] 【4】 [2]",)], "t string")
    assert df.select(T.inline_refs(F.col("t"))).first()[0] == [2, 4]


def test_positions_overlap(spark):
    df = spark.createDataFrame([("aaa baa",), ("xx",), ("",)], "t string")
    assert [r[0] for r in df.select(L.positions(F.col("t"), "aa")).collect()] == [[1, 2, 6], [], []]


def test_boolean_parser():
    assert L.parse_boolean("machine learning AND graph theory NOT image data OR x ANDY") == (["machine learning", "graph theory"], ["x ANDY"], ["image data"])
    assert L.parse_boolean("OR one NOT two") == ([], ["one"], ["two"])


def test_boolean_hits():
    text = "alpha beta gamma alpha " + "x" * 600 + " alpha delta"
    hits = L.boolean_hits(text, ["alpha", "beta"], ["gamma"], ["delta"], 500, 20, 5)
    assert [(o, s) for _, o, s in [(m, o, s) for m, o, _, s in hits]] == [(0, 2.5), (6, 2.5)] and hits[0][0] == "alpha beta gamma"
    assert [h[1] for h in L.boolean_hits(text, [], ["delta", "none"], [], 500, 20, 5)] == [text.index("delta")]
    assert L.boolean_hits(text, ["zeta"], [], [], 500, 20, 5) == []


def test_grep_hits():
    text = "One. tion abc tion def tion! end ment"
    hits = L.grep_hits(text, ["tion", "MENT"], 36, 20)
    assert [(m, o) for m, o, _ in hits] == [("tion", 5), ("tion", 14), ("tion", 23), ("ment", 33)]  # 9 apart is just far enough
    assert L.grep_hits(text, ["tion"], 8, 1) == [("tion", 5, text[: text.index("!") + 1])]
    assert L.widened("a. b c d. e", 5, 6) == (2, 9)


def test_highlights():
    snippet, marks = L.highlighted("The  quick\nbrown fox", "quick brown")
    assert snippet == "The quick brown fox" and marks == [{"start": 4, "end": 15, "text": "quick brown"}]
    _, marks = L.highlighted("fox and quick fox", "quick fox jumps")
    assert [(m["start"], m["text"]) for m in marks] == [(0, "fox"), (8, "quick"), (14, "fox")]
    assert L.highlighted("x" * 500, "none")[0] == "x" * 200 and L.highlighted("", "q") == ("", [])


def test_equal_texts_merge_in_rrf(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (1, "x", 2)], "query_id int, chunk string, rank int")
    out = {r["chunk"]: r["rrf_score"] for r in U.rrf([a, a.where("rank = 1")]).collect()}
    assert out["x"] == round(1 / 61 + 1 / 63, 9) and out["y"] == round(2 / 62, 9)


def plain_mmr(rows, k):
    """(chunk, similarity) lists, by the rule as it is told."""
    if len(rows) <= k:
        return [c for c, _ in rows]
    left, out = list(rows), [rows[0]]
    left.remove(rows[0])
    while left and len(out) < k:
        words = lambda c: set(c[:600].split())
        like = lambda c: max(len(words(c) & words(o)) / max(len(words(c) | words(o)), 1) for o, _ in out)
        best = max(left, key=lambda r: 0.5 * r[1] - 0.5 * like(r[0]))
        out.append(best)
        left.remove(best)
    return [c for c, _ in out]


def test_mmr(spark):
    lists = {1: [("red green blue", 0.9), ("red green Blue", 0.89), ("red green blue", 0.88), ("cat dog", 0.6)], 2: [("b", 0.2), ("a", 0.9)], 3: [("x y", 0.5), ("y x", 0.5), ("z", 0.1), ("", 0.05), ("x z w", 0.45)]}
    rows = [(q, c, s, i) for q, some in lists.items() for i, (c, s) in enumerate(some)]
    out = U.mmr(spark.createDataFrame(rows, "query_id int, chunk string, similarity double, rank int"), 3).orderBy("query_id", "place").collect()
    for q, some in lists.items():
        assert [r["chunk"] for r in out if r["query_id"] == q] == plain_mmr(some, 3)


def test_groups_against_a_loop(spark):
    rows = [("d", i, "x" * n, p) for i, (n, p) in enumerate([(3000, 1), (2500, 1), (400, 1), (100, 2), (5900, 2), (200, 2)])]
    out = GR.aggregate_chunks(spark.createDataFrame(rows, "doc_id string, chunk_idx int, chunk string, page int")).orderBy("group_no").collect()
    assert [r["chunk_indices"] for r in out] == [[0, 1], [2], [3, 4], [5]]


def test_budget_steps_down(spark):
    rows = [(1, 0, "full", "a" * 4000, "b" * 400, "c" * 40), (1, 1, "full", "a" * 4000, "b" * 400, "c" * 40), (1, 2, "digest", "a" * 4000, "b" * 400, "c" * 40)]
    df = spark.createDataFrame(rows, "query_id int, rank int, granularity string, full_text string, digest string, summary string")
    out = GR.fit_within_budget(df, 1110).orderBy("rank").collect()
    assert [(r["granularity"], r["tokens"]) for r in out] == [("full", 1000), ("digest", 100), ("summary", 10)]


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "d")], "src string, tgt string")
    assert {r["name"]: r["component"] for r in G.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_extraction_records(spark):
    text = '("entity"<|>"Ada &lt;"<|>"person"<|>"a woman")##("relationship"<|>"Ada"<|>"Bob"<|>"knows"<|>"x")##("relationship"<|>"Ada"<|>"Bob"<|>"knows"<|>2)##(entity<|>x<|>y<|>z)<|COMPLETE|>'
    e, r = G.parse_records(spark.createDataFrame([("c1", text)], "chunk_id string, output string"))
    assert [x.asDict() for x in e.collect()] == [{"chunk_id": "c1", "name": '"ADA <"', "type": '"PERSON"', "description": '"a woman"'}]
    assert sorted(x["weight"] for x in r.collect()) == [1.0, 2.0]


def test_buffer_ends_with_done():
    out = X.buffered([{"content": "ab"}, {"content": "last", "done": True}, {"content": "late"}], 10)
    assert [c.get("content") for c in out] == ["ab", "last"] and out[-1]["done"]
    assert X.buffered([{"content": "a"}, {"content": "", "error": "e"}, {"content": "b"}], 0)[-1]["error"] == "e"


def test_streams_buffer_live(spark, tmp_path):
    rows = [("s", i, f"p{i}", "", i == 9, None) for i in range(10)]
    spark.createDataFrame(rows, X.BUFFER).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(X.BUFFER).parquet(str(tmp_path / "in"))
    out = X.run_available(spark, X.buffer_live(live, 6)).orderBy("seq").toPandas()
    assert "".join(out["content"]) == "".join(r[2] for r in rows) and bool(out["done"].iloc[-1]) and out["content"].iloc[-1] == "p9"


def test_incremental_index(spark, tmp_path):
    src, index = str(tmp_path / "src"), str(tmp_path / "index")
    for text in ("one", "two", "two"):
        pd_rows = pd.DataFrame({"id": [1], "text": [text]})
        spark.createDataFrame(pd_rows, "id long, text string").write.mode("append").parquet(src)
        X.index_incrementally(spark.readStream.schema("id long, text string").parquet(src), index, str(tmp_path / "cp"), "id", "text").awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(index).collect()) == ["one", "two"]
