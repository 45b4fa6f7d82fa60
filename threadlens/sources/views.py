"""Canonical views over the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as comment actions: every turn replies to the one before."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat(conv_id, '.', turn, '.', turn) AS id",
        "conv_id AS conversation_id",
        "turn",
        "role AS user_text",
        "text AS content",
        "CASE WHEN turn = 0 THEN 'CREATION' ELSE 'ADDITION' END AS type",
        "conv_id % 10 AS page_id",
        "CASE WHEN turn > 0 THEN concat(conv_id, '.', turn - 1, '.', turn - 1) END AS reply_to",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id AS INT), CAST(turn AS INT)) AS ts",
    )


COMMENTS = """comments AS (
    SELECT conv_id || '.' || turn || '.' || turn AS id, conv_id AS conversation_id, turn, role AS user_text, text AS content,
           CASE WHEN turn = 0 THEN 'CREATION' ELSE 'ADDITION' END AS type, conv_id % 10 AS page_id,
           CASE WHEN turn > 0 THEN conv_id || '.' || (turn - 1) || '.' || (turn - 1) END AS reply_to,
           TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts
    FROM conversations)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as revisions: a page is a user's events of one type, ``k`` is the content hash, the value a toxicity."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS rev_id",
        "concat(user_id, '/', event_type) AS page_id",
        "ts",
        "get_json_object(props, '$.k') AS sha1",
        "least(value / 200, 1) AS attack",
        "event_type AS author",
        "user_id",
    )


REVISIONS = """revisions AS (
    SELECT event_id AS rev_id, user_id || '/' || event_type AS page_id, ts, json_extract_string(props, '$.k') AS sha1,
           least(value / 200, 1) AS attack, event_type AS author, user_id
    FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as actions of user-day conversations: one scored action each."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "concat(user_id, '/', CAST(CAST(ts AS DATE) AS STRING)) AS conversation_id",
        "event_type AS user_text",
        "user_id % 10 AS page_id",
        "ts",
        "least(value / 490, 1) AS toxicity",
        "CASE WHEN event_type = 'error' THEN 'DELETION' WHEN event_type = 'signup' THEN 'CREATION' ELSE 'ADDITION' END AS type",
    )


SCORED = """scored AS (
    SELECT event_id AS id, user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS conversation_id, event_type AS user_text,
           user_id % 10 AS page_id, ts, least(value / 490, 1) AS toxicity,
           CASE WHEN event_type = 'error' THEN 'DELETION' WHEN event_type = 'signup' THEN 'CREATION' ELSE 'ADDITION' END AS type
    FROM events)"""
