"""The driver tables in the roles of the engine's sources, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.columns import epoch_ms
from mnemora.operators import grid
from mnemora.plans.registry import Tables


#: Rows that a task of ``dealt`` takes, so that its memory stays as it is however many there are.
TASK_ROWS = 250_000


def tasks(table: DataFrame) -> int:
    """How many tasks a table's rows ask for."""
    return max(table.sparkSession.sparkContext.defaultParallelism, table.count() // TASK_ROWS + 1)


def dealt(table: DataFrame, key: str) -> DataFrame:
    """A table's rows by ``key`` over as many tasks as its number of rows asks for; Spark alone goes by bytes, which are few for rows that compress well."""
    return table.repartition(tasks(table), key)


def chat_grid(t: Tables) -> DataFrame:
    """``conversations`` as chat and message rows."""
    return grid.chat_rows(t.conversations, "assistant")


def review_grid(t: Tables) -> DataFrame:
    """``orders`` as review requests, ``lineitem`` as their comments."""
    requests = t.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("opened_at"), F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("author"), F.col("o_orderpriority").alias("title"))
    comments = t.lineitem.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("number"), F.col("l_shipdate").alias("at"), F.concat(F.lit("user-"), F.col("l_suppkey").cast("string")).alias("author"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("body"))
    return grid.review_rows(requests, comments, "reviews")


def readings(t: Tables) -> DataFrame:
    """``events`` as sensor readings: a device for each user, the event type as metric."""
    return t.events.select(F.concat(F.lit("device-"), F.col("user_id").cast("string")).alias("device"), F.col("event_type").alias("metric"), epoch_ms(F.col("ts")).alias("ts_ms"), "value", "event_id")


def old_orders(t: Tables) -> DataFrame:
    """An earlier version of ``orders``: some rows missing, some with another status."""
    return t.orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))


def new_orders(t: Tables) -> DataFrame:
    """The present version: others missing."""
    return t.orders.where("o_orderkey % 10 <> 0")


def files(t: Tables) -> DataFrame:
    """``part`` as files: the type's words as directories, the name's hash as content."""
    return t.part.select(F.concat(F.lit("root/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("hash"), F.col("p_size").cast("long").alias("size"))


#: The same views for DuckDB, as common table expressions.
GRID_SQL = """
chats AS (
  SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE role <> 'system'), '') AS text, min(turn) AS turn
  FROM conversations GROUP BY conv_id),
grid AS (
  SELECT 'conv-' || conv_id || '-' || turn AS uuid,
         CASE role WHEN 'user' THEN 'User Input' WHEN 'assistant' THEN 'LLM Response' WHEN 'system' THEN 'System Prompt' WHEN 'tool' THEN 'Tool Result' ELSE role END AS kind,
         TIMESTAMP '2024-01-01' + to_days(conv_id::INTEGER) + to_minutes(turn) AS when_ts_utc, role AS author, 'conv-' || conv_id AS conversation_uuid,
         turn::BIGINT AS message_index, false AS entire_chat, coalesce(text, '') AS text, 'md-' || conv_id AS markdown_uuid
  FROM conversations
  UNION ALL
  SELECT 'conv-' || conv_id, 'Chat', TIMESTAMP '2024-01-01' + to_days(conv_id::INTEGER) + to_minutes(turn), NULL, 'conv-' || conv_id, NULL, true, text, 'md-' || conv_id
  FROM chats)
"""

REVIEW_SQL = """
reviews AS (
  SELECT 'pr-' || o_orderkey AS uuid, 'Pull Request' AS kind, o_orderdate AS when_ts_utc, 'user-' || o_custkey AS author, 'pr-' || o_orderkey AS conversation_uuid,
         CAST(NULL AS BIGINT) AS message_index, o_orderpriority AS text, 'pr-' || o_orderkey AS markdown_uuid FROM orders
  UNION ALL
  SELECT 'pr-' || l_orderkey || '-' || l_linenumber, 'PR Comment', l_shipdate, 'user-' || l_suppkey, 'pr-' || l_orderkey, l_linenumber::BIGINT,
         l_returnflag || ' ' || l_linestatus, 'pr-' || l_orderkey FROM lineitem)
"""

READINGS_SQL = """
readings AS (SELECT 'device-' || user_id AS device, event_type AS metric, epoch_us(ts) // 1000 AS ts_ms, value, event_id FROM events)
"""

ORDERS_SQL = """
old AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey % 11 <> 0),
new AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0)
"""

FILES_SQL = """
files AS (SELECT 'root/' || replace(p_type, ' ', '/') || '/' || p_partkey AS path, sha256(p_name) AS hash, p_size::BIGINT AS size FROM part)
"""
