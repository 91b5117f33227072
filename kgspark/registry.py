"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark import queries_graph, queries_hierarchy, queries_metrics, queries_plans, queries_stream, queries_text, queries_vector

MODULES = (queries_hierarchy, queries_graph, queries_text, queries_vector, queries_metrics, queries_plans, queries_stream)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["vector_topk"](spark, folder)
