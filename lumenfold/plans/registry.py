"""All queries of the core: name -> callable(spark, folder), and the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.plans import analysis_queries, data_queries, lookup_queries, routing_queries, search_queries, source_queries
from lumenfold.plans.ship import shipped

_MODULES = [data_queries, search_queries, analysis_queries, routing_queries, lookup_queries, source_queries]
QUERIES = {k: shipped(f) for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["bm25_fused_topk"](spark, folder)
