"""The union row of all sources and its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampNTZType

_TEXT = "author account project org_uuid org_name channel conversation_name slack_link qmd_path source_url git_sha external_id notion_page_uuid notion_block_uuid markdown_uuid".split()

GRID_ROWS = StructType(
    [StructField(c, StringType(), False) for c in ("uuid", "provider", "kind", "source_label")]
    + [StructField("when_ts", StringType()), StructField("when_ts_utc", TimestampNTZType()), StructField("when_offset", StringType())]
    + [StructField(c, StringType()) for c in _TEXT]
    + [StructField("conversation_uuid", StringType(), False), StructField("message_index", LongType()), StructField("entire_chat", BooleanType(), False), StructField("text", StringType(), False)]
)

#: Kinds of rows that stand for a whole chat or thread.
CHAT_KINDS = ("Chat", "Slack Thread")


def conform(rows: DataFrame) -> DataFrame:
    """``rows`` with every column of the union row, missing ones null, in its order and types."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in GRID_ROWS])
