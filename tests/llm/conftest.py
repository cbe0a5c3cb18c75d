import pytest

pytest.importorskip("lexmill.llm")

DIR = "/root/testdata/sf0.001"
#: Texts that every operator on documents must take: null, empty, blank, short, long, repeated, of many scripts.
ODD = [None, "", " \t\n ", "one", "one two", "A b. C d!", "ÉTÉ été naïve", "日本語 テキスト", "a b c\x1cd", "<|endoftext|> x", "word " * 5000, "z" * 20000, "same text here now", "same text here now", "\x00\x01", "İ ß ŉ ǅ"]


@pytest.fixture
def odd(spark):
    rows = [(i, t, ["en", None][i % 2], ["a", "b", None][i % 3], len(t or ""), "x") for i, t in enumerate(ODD)]
    rows += [(12, "same text here now", "en", "a", 18, "x"), (None, "no id at all", "en", "a", 12, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, probability string")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")
