"""Projection of sources into the union row, its documents and its links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.operators.payloads import item_text
from mnemora.schema import CHAT_KINDS, GRID_ROWS, conform

#: Message kinds by role.
ROLE_KINDS = {"user": "User Input", "assistant": "LLM Response", "system": "System Prompt", "tool": "Tool Result"}


def role_kind(role: Column) -> Column:
    """The kind of a message row; other roles keep their name."""
    out = role
    for name, kind in ROLE_KINDS.items():
        out = F.when(role == name, F.lit(kind)).otherwise(out)
    return out


def ordered_text(text: Column, order: Column, keep: Column | None = None, delimiter: str = "\n") -> Column:
    """Aggregate: texts in order joined by ``delimiter``; nulls and those that ``keep`` rejects left out."""
    item = F.struct(order.alias("o"), text.alias("t"))
    kept = F.when(text.isNotNull() if keep is None else text.isNotNull() & keep, item)
    return F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"]), delimiter)


def chat_rows(messages: DataFrame, provider: str, day: str = "2024-01-01") -> DataFrame:
    """Chat and message rows of ``(conv_id, turn, role, text)``.

    A message without a time of its own gets its chat's day plus a minute for each turn; the chat row
    has the text of all but system messages.
    """
    key = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    at = F.expr(f"timestamp_ntz'{day} 00:00:00' + make_dt_interval(conv_id, 0, turn, 0)")
    own = messages.select(
        F.concat(key, F.lit("-"), F.col("turn").cast("string")).alias("uuid"), role_kind(F.col("role")).alias("kind"), at.alias("when_ts_utc"), F.col("role").alias("author"),
        key.alias("conversation_uuid"), F.col("turn").cast("long").alias("message_index"), F.lit(False).alias("entire_chat"), F.coalesce("text", F.lit("")).alias("text"),
        F.concat(F.lit("md-"), F.col("conv_id").cast("string")).alias("markdown_uuid"),
    )
    whole = messages.groupBy("conv_id").agg(ordered_text(F.col("text"), F.col("turn"), F.col("role") != "system").alias("text"), F.min("turn").alias("turn"))
    chats = whole.select(
        key.alias("uuid"), F.lit("Chat").alias("kind"), at.alias("when_ts_utc"), key.alias("conversation_uuid"), F.lit(True).alias("entire_chat"), "text",
        F.concat(F.lit("md-"), F.col("conv_id").cast("string")).alias("markdown_uuid"),
    )
    both = own.unionByName(chats, allowMissingColumns=True)
    return conform(both.withColumn("provider", F.lit(provider)).withColumn("source_label", F.lit(provider)).withColumn("when_ts", F.date_format("when_ts_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn("when_offset", F.lit("Z")))


def review_rows(requests: DataFrame, comments: DataFrame, provider: str) -> DataFrame:
    """Rows of review requests ``(request_id, opened_at, author, title)`` and of their comments ``(request_id, number, at, author, body)``."""
    key = F.concat(F.lit("pr-"), F.col("request_id").cast("string"))
    heads = requests.select(key.alias("uuid"), F.lit("Pull Request").alias("kind"), F.col("opened_at").alias("when_ts_utc"), F.col("author"), key.alias("conversation_uuid"), F.col("title").alias("text"), key.alias("markdown_uuid"))
    notes = comments.select(
        F.concat(key, F.lit("-"), F.col("number").cast("string")).alias("uuid"), F.lit("PR Comment").alias("kind"), F.col("at").alias("when_ts_utc"), F.col("author"),
        key.alias("conversation_uuid"), F.col("number").cast("long").alias("message_index"), F.col("body").alias("text"), key.alias("markdown_uuid"),
    )
    both = heads.unionByName(notes, allowMissingColumns=True)
    return conform(both.withColumn("provider", F.lit(provider)).withColumn("source_label", F.lit(provider)).withColumn("entire_chat", F.lit(False)))


def union_rows(*sources: DataFrame) -> DataFrame:
    """All sources as one table."""
    return reduce(lambda a, b: a.unionByName(b), map(conform, sources))


def canonical(rows: DataFrame) -> DataFrame:
    """A row for each document: the one whose uuid is the document's, else a chat, else the first in time."""
    own = Window.partitionBy("markdown_uuid").orderBy((F.col("uuid") == F.col("markdown_uuid")).desc(), F.when(F.col("kind").isin(*CHAT_KINDS), 0).otherwise(1), F.col("when_ts_utc").asc_nulls_last(), "uuid")
    return rows.where("markdown_uuid is not null").withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


#: Columns of a row whose change makes its document another.
CONTENT = [f.name for f in GRID_ROWS if f.name not in ("when_ts", "markdown_uuid")]


def markdowns(rows: DataFrame) -> DataFrame:
    """A row for each document: rows, first and last time, and a hash of its rows in (time, uuid) order.

    All content columns take part, times to the microsecond, nulls apart from empty values; each row goes in as its own hash.
    """
    cell = F.sha2(item_text(*[F.col(c) for c in CONTENT]), 256)
    item = F.struct(F.col("when_ts_utc").alias("w"), F.col("uuid").alias("u"), cell.alias("c"))
    return rows.where("markdown_uuid is not null").groupBy("markdown_uuid").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("when_ts_utc").alias("first_ts"), F.max("when_ts_utc").alias("last_ts"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]), "\x1e"), 256).alias("row_set_hash"),
    )
