"""All registered queries outside the llm subpackage, with their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import context_queries, graph_queries, memory_queries, question_queries, relational_queries, retrieval_queries, store_queries, text_queries

MODULES = [text_queries, question_queries, memory_queries, retrieval_queries, context_queries, graph_queries, relational_queries, store_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.Q.items() if sql}
