"""Queries of the general data-preparation operators (sessions, units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.operators import sessions, units
from lumenfold.sources.tables import table


def p2_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.sessionize(sessions.chat_events(table(spark, folder, "chat_log")), "user_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_sessions(spark, folder).select("user_id", "start_ms", "end_ms", "n_events")


def p7_units(spark: SparkSession, folder: str) -> DataFrame:
    return units.harmonised(table(spark, folder, "extracted"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in the unit that their segment proposes, checked against the text; those whose unit only the history tells are no cases here."""
    return (
        units.harmonised(table(spark, folder, "extracted"))
        .where("decided <> 'history'")
        .selectExpr("key as entry_id", "quantity", "common_value")
        .distinct()
    )


_SESSIONS = """
WITH e AS (
  SELECT DISTINCT lower(trim(user_id)) AS user_id, id, epoch_ms(CAST(ts AS TIMESTAMP)) AS end_ms,
         greatest(coalesce(duration_ms, 0), 0) AS d
  FROM chat_log
), f AS (
  SELECT user_id, id, end_ms - d AS start_ms, end_ms FROM e WHERE user_id <> ''
), m AS (
  SELECT *, max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, end_ms, id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM f
), g AS (
  SELECT *, sum(CASE WHEN latest IS NULL OR start_ms > latest + 1800000 THEN 1 ELSE 0 END) OVER (
         PARTITION BY user_id ORDER BY start_ms, end_ms, id ROWS UNBOUNDED PRECEDING) AS nr FROM m
)
SELECT user_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms{}, count(*) AS n_events
FROM g GROUP BY user_id, nr
"""

QUERIES = {"p2_found": p2_found, "p2_sessions": p2_sessions, "p7_found": p7_found, "p7_units": p7_units}
ORACLE = {"p2_found": _SESSIONS.format(""), "p2_sessions": _SESSIONS.format(", max(end_ms) - min(start_ms) AS duration_ms")}
