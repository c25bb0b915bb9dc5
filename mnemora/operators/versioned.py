"""Differences between versions of a table, keyed upserts, history: joins and windows, no store of its own.

A version is any DataFrame. Equality is null-safe throughout. Each operation shuffles both sides once, on
the key; versions bucketed on it join without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _content(df: DataFrame, keys: list[str], columns: list[str] | None) -> list[str]:
    return columns or [c for c in df.columns if c not in keys]


def diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None, unchanged: bool = False) -> DataFrame:
    """Keys, ``from_*`` and ``to_*`` columns and ``diff_type`` added, removed or modified."""
    content = _content(new, keys, columns)
    a = old.select(*keys, *[F.col(c).alias(f"from_{c}") for c in content], F.lit(True).alias("__old"))
    b = new.select(*keys, *[F.col(c).alias(f"to_{c}") for c in content], F.lit(True).alias("__new"))
    same = reduce(lambda x, y: x & y, [F.col(f"from_{c}").eqNullSafe(F.col(f"to_{c}")) for c in content], F.lit(True))
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~same, "modified")
    found = a.join(b, keys, "full_outer").withColumn("diff_type", F.coalesce(kind, F.lit("unmodified"))).drop("__old", "__new")
    return found if unchanged else found.where("diff_type <> 'unmodified'")


def diff_stat(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row: rows and cells by what became of them."""
    content = _content(new, keys, columns)
    changed = reduce(lambda x, y: x + y, [F.when(F.col(f"from_{c}").eqNullSafe(F.col(f"to_{c}")), 0).otherwise(1) for c in content])
    count = lambda kind: F.count(F.when(F.col("diff_type") == kind, 1))
    return diff(old, new, keys, content, unchanged=True).agg(
        *[count(k).alias(f"rows_{k}") for k in ("unmodified", "added", "removed", "modified")],
        F.coalesce(F.sum(F.when(F.col("diff_type") == "modified", changed)), F.lit(0)).cast("long").alias("cells_modified"),
    )


def diff_summary(old: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """``(table, schema_changed, data_changed)`` for every table of either version."""
    spark = next(iter({**old, **new}.values())).sparkSession
    rows = []
    for name in sorted(old.keys() | new.keys()):
        both = name in old and name in new
        schema = not both or old[name].schema != new[name].schema
        shared = [c for c in old[name].columns if c in new[name].columns] if both else []
        data = not both or not diff(old[name].select(*shared), new[name].select(*shared), keys[name]).isEmpty()
        rows.append((name, schema, data))
    return spark.createDataFrame(rows, "table string, schema_changed boolean, data_changed boolean")


def diff_keyless(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables without a key as multisets: rows gone and come, with repetitions."""
    return old.exceptAll(new).withColumn("diff_type", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("diff_type", F.lit("added")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], coalesce: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of the same key; columns in ``coalesce`` keep the old value where the new one is null."""
    content = _content(new, keys, None)
    a = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in content], F.lit(True).alias("__old"))
    b = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in content], F.lit(True).alias("__new"))
    pick = lambda c: F.coalesce(f"__n_{c}", f"__o_{c}") if c in coalesce else F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}"))
    return a.join(b, keys, "full_outer").select(*keys, *[pick(c).alias(c) for c in content])


def bump(old: DataFrame, ids: DataFrame, now: Column, key: str = "id", error: Column | None = None) -> DataFrame:
    """Bookkeeping after an attempt: the count goes up; success clears the error and sets the time fetched, failure keeps it."""
    hit = F.col("__hit").isNotNull()
    joined = old.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "full_outer")
    return joined.select(
        key,
        F.when(hit, F.coalesce("attempt_count", F.lit(0)) + 1).otherwise(F.col("attempt_count")).cast("long").alias("attempt_count"),
        F.when(hit & F.lit(error is None), now).otherwise(F.col("fetched_at")).alias("fetched_at"),
        F.when(hit, F.lit(None) if error is None else error).otherwise(F.col("last_error")).cast("string").alias("last_error"),
    )


def new_and_changed(prior: DataFrame, fresh: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """``fresh`` with its ``stream``: ``created`` where the key is new, ``updated`` where ``raw`` differs; the rest is left out."""
    before = prior.select(*keys, F.col(raw).alias("__raw"), F.lit(True).alias("__there"))
    kind = F.when(F.col("__there").isNull(), "created").when(~F.col("__raw").eqNullSafe(F.col(raw)), "updated")
    return fresh.join(before, keys, "left").withColumn("stream", kind).where("stream is not null").drop("__raw", "__there")


def replace_documents(rows: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of the documents in ``fresh`` go, then its rows come."""
    return rows.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def stale(documents: DataFrame, stored: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Documents whose stored fingerprint isn't the same: those to be made again."""
    return documents.join(stored.select(key, fingerprint), [key, fingerprint], "left_anti")


def vanished(stored: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Stored documents that are no longer there."""
    return stored.join(documents.select(key).distinct(), key, "left_anti")


def versions(*tables: DataFrame) -> DataFrame:
    """Versions in order as one table with a ``commit`` number from 1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("commit", F.lit(n).cast("long")) for n, t in enumerate(tables, 1)])


def _row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def history(table: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """From ``versions``: a row for each commit in which a key is new or has changed."""
    content = [c for c in _content(table, keys, columns) if c != "commit"]
    own = Window.partitionBy(*keys).orderBy("commit")
    found = table.withColumn("__h", _row_hash(content)).withColumn("__p", F.lag("__h").over(own))
    return found.where(~F.col("__h").eqNullSafe(F.col("__p"))).drop("__h", "__p")


def blame(table: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """The commit that last changed each key that the last version has."""
    last = table.agg(F.max("commit").alias("__last"))
    there = table.join(F.broadcast(last), table["commit"] == F.col("__last")).select(*keys)
    return history(table, keys, columns).groupBy(*keys).agg(F.max("commit").alias("commit")).join(there, keys, "left_semi")


def changed_buckets(diffs: dict[str, DataFrame], fan_out: set[str], bucket: dict[str, Column]) -> DataFrame | None:
    """Buckets to make again: None for all, where a table that touches every bucket has changed."""
    if any(not diffs[t].isEmpty() for t in fan_out if t in diffs):
        return None
    parts = [d.select(bucket[t].alias("bucket")) for t, d in diffs.items() if t in bucket]
    return reduce(lambda a, b: a.union(b), parts).where("bucket is not null").distinct()


def since(state: str | None, window_days: int, now, full: bool = False, widened: bool = False) -> str | None:
    """Where a source's next read starts; None: from the beginning. A widened window goes back to its floor."""
    from datetime import timedelta

    floor = (now - timedelta(days=window_days)).isoformat() if window_days else None
    if full:
        return None
    if state is None:
        return floor
    return state if not widened else None if floor is None else min(state, floor)


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row that is first in ``order`` for each key."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def flushed(fetched: DataFrame, failed: DataFrame, keys: list[str], content_hash: str = "hash") -> DataFrame:
    """A link to a content for each key; where the fetch failed ``failed (keys, error)`` it is null, with the error."""
    joined = fetched.join(failed, keys, "left")
    return joined.withColumn(content_hash, F.when(F.col("error").isNull(), F.col(content_hash))).select(*keys, content_hash, "error")
