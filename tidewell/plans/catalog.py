"""Every registered query of the library with its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans import agent_queries, collection_queries, conversation_queries, event_queries, json_queries, layout_queries, operations_queries, retrieval_queries, service_queries, text_queries, web_queries

MODULES = (retrieval_queries, text_queries, conversation_queries, event_queries, web_queries, json_queries, service_queries, operations_queries, collection_queries, agent_queries, layout_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.hybrid_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made for module in MODULES for name, (made, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
