"""What a source's changed settings ask for: only what widens a scope makes work.

Settings are JSON texts, kept for each scope after a run that covered it. What isn't known (no earlier settings, a key that isn't in
them, a value of another kind) asks for nothing. All are column expressions, so that they apply to a table of scopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stored(before: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(before), f"$.{key}", "variant")


def turned_on(before: Column, key: str, now: Column) -> Column:
    """Whether a switch that was off is on."""
    was = F.when(F.schema_of_variant(_stored(before, key)) == "BOOLEAN", F.try_variant_get(F.try_parse_json(before), f"$.{key}", "boolean"))
    return F.coalesce(now & ~was, F.lit(False))


def limit_relaxed(before: Column, key: str, now: Column) -> Column:
    """Whether an upper bound, null for none, admits more than it did."""
    was = F.when(F.schema_of_variant(_stored(before, key)) == "BIGINT", F.try_variant_get(F.try_parse_json(before), f"$.{key}", "bigint"))
    return F.coalesce(was.isNotNull() & (now.isNull() | (now > was)), F.lit(False))


def filter_widened(before: Column, key: str, now: Column) -> Column:
    """``struct<change, added>``: what a list of names, where an empty one means all, lets in that it didn't.

    ``change`` is ``all`` where the filter is gone, ``added`` where there are new names, else ``none``.
    """
    was = F.when(F.schema_of_variant(_stored(before, key)).startswith("ARRAY"), F.from_json(F.get_json_object(before, f"$.{key}"), "array<string>"))
    added = F.array_except(now, was)
    change = F.when(was.isNull() | (F.size(was) == 0), "none").when(F.size(now) == 0, "all").when(F.size(added) > 0, "added").otherwise("none")
    return F.struct(change.alias("change"), F.when(change == "added", added).otherwise(F.array().cast("array<string>")).alias("added"))


def cursor_usable(stored: Column, params: Column) -> Column:
    """Whether a render cursor holds: the parameters stored with it are the same, keys in any order, or there are none."""
    return stored.isNull() | F.coalesce(F.to_json(F.try_parse_json(stored)) == F.to_json(F.try_parse_json(params)), F.lit(False))


def channel_plan(before: Column, since: Column, media: Column, blob_cap: Column) -> Column:
    """``struct<backfill, full_walk>`` of a chat source: an earlier start reads below the oldest message that is there; media turned on, or a larger cap for them, reads all again."""
    stored = F.try_variant_get(F.try_parse_json(before), "$.since", "string")
    at = lambda c: F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    backfill = F.coalesce(at(since) < at(stored), F.lit(False))
    full = turned_on(before, "media", media) | (F.coalesce(media, F.lit(False)) & limit_relaxed(before, "blob_cap", blob_cap))
    return F.struct(backfill.alias("backfill"), full.alias("full_walk"))


def since(cursor: Column, now: Column, window_days: Column, full: Column, widened: Column) -> Column:
    """Where a scope's next read starts, null for the beginning; times as timestamps without zone.

    A full read starts at the beginning; else at the cursor; a widened window goes back to its floor; a window of 0 days has none.
    """
    floor = F.when(window_days > 0, now - F.make_dt_interval(window_days))
    return F.when(full, F.lit(None)).when(cursor.isNull(), floor).when(~widened, cursor).when(floor.isNull(), F.lit(None)).otherwise(F.least(cursor, floor))


#: For each kind of source: tables whose change touches every bucket, and for the others the columns of the bucket's key.
BUCKETS: dict[str, tuple[frozenset[str], dict[str, tuple[str, ...]]]] = {
    "slack": (frozenset({"workspaces", "users", "channels"}), {"messages": ("channel_id", "thread_ts")}),
    "signal": (frozenset({"recipients"}), {"messages": ("thread_id", "period"), "reactions": ("thread_id", "period")}),
    "claude": (frozenset({"users", "orgs"}), {"conversations": ("uuid",)}),
    "chatgpt": (frozenset({"me"}), {"conversations": ("id",)}),
    "email": (frozenset(), {"emails": ("account", "thread_id"), "labels": ("account", "thread_id")}),
}


def buckets_to_make(kind: str, diffs: dict[str, DataFrame]) -> DataFrame | None:
    """Distinct buckets that a source's changed rows (``diff_type`` and key columns) touch; None for all of them."""
    fan_out, keyed = BUCKETS[kind]
    if any(not diffs[t].isEmpty() for t in fan_out & diffs.keys()):
        return None
    parts = [diffs[t].select(F.concat_ws("/", *[F.col(c).cast("string") for c in keyed[t]]).alias("bucket")) for t in keyed if t in diffs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def reconciled(stored: DataFrame, schema: str) -> tuple[DataFrame, str]:
    """A stored table under a newer schema, and what was done: ``same``, ``added`` (columns, null so far) or ``made anew`` (empty, where a stored column is gone)."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema)
    names, have = [f.name for f in wanted], set(stored.columns)
    if not have <= set(names):
        return stored.sparkSession.createDataFrame([], wanted), "made anew"
    out = stored.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    return out, "same" if have == set(names) else "added"
