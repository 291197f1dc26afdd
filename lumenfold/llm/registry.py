"""All queries of the subpackage: name -> callable(spark, folder), and the SQL that must agree."""

from __future__ import annotations

from lumenfold.llm import queries
from lumenfold.plans.ship import shipped

QUERIES = {k: shipped(f) for k, f in queries.QUERIES.items()}
ORACLE = queries.ORACLE
