"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, bisection_search, bpe_trie, chat_trees, gam_quality, imatch, mixing, neardup, orc_tokens, phrases, pivot_search, trie_counts, warc


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_file())


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.scores(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam_quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_search.quantised(table(spark, sf_dir, "embeddings"))
    return pivot_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_trees.digests(table(spark, sf_dir, "conversations"))


def op12_bisection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisection_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=50)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hyperminhash": op1_hyperminhash,
        "op2_orc_tokens": op2_orc_tokens,
        "op3_attention_lm": op3_attention_lm,
        "op4_gam_quality": op4_gam_quality,
        "op5_imatch": op5_imatch,
        "op6_mixing": op6_mixing,
        "op7_pivot_topk": op7_pivot_topk,
        "op8_trie_counts": op8_trie_counts,
        "op9_warc": op9_warc,
        "op10_bpe_codec": op10_bpe_codec,
        "op11_reply_trees": op11_reply_trees,
        "op12_bisection_search": op12_bisection_search,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.oracle(), "op7_pivot_topk": pivot_search.ORACLE, "op9_warc": warc.ORACLE, "op11_reply_trees": chat_trees.ORACLE, "op12_bisection_search": bisection_search.ORACLE, "op13_phrases": phrases.ORACLE}
