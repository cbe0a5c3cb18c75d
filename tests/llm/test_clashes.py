"""Columns of any name beside those that an operator reads change nothing."""

import pytest
from pyspark.sql import functions as F

from lexmill.llm import attention_lm, bpe_trie, gam_quality, imatch, neardup, orc_tokens, phrases, pivot_search, trie_counts
from lexmill.llm.queries import tokenizer_file

#: Names that operators use inside.
NAMES = "h ids learn n bucket place term row block vector dim tf words kept component_id n_shingles score held_out start n_tokens weight mass text_hash found own phrase m q k key value".split()
DOCUMENTS = {
    "op1": lambda d, labels: neardup.classes(d, width=2, percent=80),
    "op2": lambda d, labels: orc_tokens.round_trip(d, tokenizer_file()),
    "op3": lambda d, labels: attention_lm.scores(d, tokenizer_file("byte_bpe_50k.json"), warm_documents=5, bucket_ids=2000).select("doc_id", "n_tokens", "n_known", F.round("base_score", 4)),
    "op4": lambda d, labels: gam_quality.predictions(d, labels),
    "op5": lambda d, labels: imatch.fingerprints(d),
    "op8": lambda d, labels: trie_counts.counts(d, tokenizer_file("piece_bpe_32k.model")),
    "op10": lambda d, labels: bpe_trie.digests(d, tokenizer_file()),
    "op13": lambda d, labels: phrases.collocations(d, least=3, top=50),
}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", DOCUMENTS)
def test_documents(spark, docs, name):
    some = docs.where("doc_id < 40")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    more = some.withColumns({c: F.lit(f"{c} of another kind") for c in NAMES})
    assert rows(DOCUMENTS[name](more, labels)) == rows(DOCUMENTS[name](some, labels))


def test_vectors(spark):
    some = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    more = some.withColumns({c: F.lit("x") for c in NAMES})
    asked = lambda v: pivot_search.top_k(v, v.where("vec_id % 50 = 0"), k=5)
    assert rows(asked(pivot_search.quantised(more))) == rows(asked(pivot_search.quantised(some)))
