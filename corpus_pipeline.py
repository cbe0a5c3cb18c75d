"""Corpus pipeline: quality, near duplicates, mixing, subword ids.

``run`` applies STAGES to ``documents``; every stage's output is written as Parquet and read again as the
next one's input.  A stage decides on the rows that its predecessor kept, and all but the last return the
columns of documents.

Contract of all stages: null texts are as empty ones; texts are read whole whatever their length; an empty
table gives an empty one; further columns pass through untouched, whatever their names (the last stage's
own columns win over clashing ones).  Of the single stages:

- quality: empty texts are scored as any other; rows that repeat are scored alike; without labels all score
  one half and stay; a score equal to QUALITY stays.
- near duplicates: texts without words are like nothing and stay; of a class the rows of its least doc_id
  stay; rows without an id stay.
- mixing: null sources and languages are a value of their own; rows that repeat a doc_id are drawn alike.
- subword ids: empty texts have no ids and the digest of the empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe_trie, gam_quality, mixing, neardup
from lexmill.llm.common import cut, unused
from lexmill.llm.queries import table, tokenizer_file

#: Documents that score below are rejected.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels of those that came in, does not reject."""
    score = unused(docs, "score")
    model = gam_quality.fit(docs, table(spark, sf_dir, "labels"))
    return gam_quality.score(docs, model, score).where(F.col(score) >= QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group alike in 80 of 100 five-word shingles."""
    return neardup.deduplicate(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the expected tokens of sources, languages and topics come to their target shares."""
    return mixing.sample(docs)


def subword_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, their packed ids, and digests of these and of the text decoded from them."""
    return bpe_trie.coded(docs, tokenizer_file())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mix), ("subword_ids", subword_ids)]

#: SQL expresses neither the classifier nor the subword ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
