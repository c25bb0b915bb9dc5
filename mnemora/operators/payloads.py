"""JSON payloads as they come from a source: fields that change all the time apart from the rest, and back again; fingerprints.

Payloads are VARIANT values inside Spark's own functions. Objects are maps by name there, a null is a value like others, and what
is written has its keys in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = "map<string,variant>"


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used; inside functions of arrays and maps Spark computes each use anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _object(value: Column) -> Column:
    """A VARIANT object as a map; null where it is something else."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.variant_get(value, "$", MAP))


def _variant(entries: Column) -> Column:
    return F.parse_json(F.to_json(entries))


def _tree(paths: list[tuple[str, ...]]) -> dict:
    tree: dict = {}
    for path in paths:
        at = tree
        for name in path[:-1]:
            at = at.setdefault(name, {})
        if path:
            at[path[-1]] = None  # a whole field takes what is below it along
    return tree


def _without(entries: Column, tree: dict) -> Column:
    whole = [k for k, below in tree.items() if below is None]
    kept = F.map_filter(entries, lambda k, _: ~k.isin(whole)) if whole else entries
    inner = {k: below for k, below in tree.items() if below}
    if not inner:
        return kept

    def value(k: Column, v: Column) -> Column:
        out = v
        for name, below in inner.items():
            out = F.when(k == name, _named(_object(v), lambda o: F.when(o.isNotNull(), _variant(_without(o, below))).otherwise(v))).otherwise(out)  # noqa: B023
        return out

    return F.transform_values(kept, value)


def _taken(entries: Column, tree: dict) -> Column:
    """What the paths name, at the same places; an empty map where nothing of it is there."""
    found = F.map_filter(entries, lambda k, _: k.isin(list(tree)))
    inner = {k: below for k, below in tree.items() if below}

    def value(k: Column, v: Column) -> Column:
        out = v
        for name, below in inner.items():
            out = F.when(k == name, _named(_object(v), lambda o: F.when(o.isNotNull(), _variant(_taken(o, below))).otherwise(F.parse_json(F.lit("{}"))))).otherwise(out)  # noqa: B023
        return out

    filled = F.transform_values(found, value) if inner else found
    return F.map_filter(filled, lambda k, v: ~(k.isin(list(inner)) & (F.to_json(v) == "{}"))) if inner else filled


def split_volatile(payload: Column, paths: list[tuple[str, ...]]) -> Column:
    """``struct<base, volatile>`` of a JSON object: it without the fields of ``paths``, and those at the same places, null where there are none."""
    tree = _tree(paths)

    def split(entries: Column, whole: Column) -> Column:
        base = F.when(entries.isNotNull(), F.to_json(_variant(_without(entries, tree)))).otherwise(F.to_json(whole))
        return F.struct(base.alias("base"), _named(_taken(entries, tree), lambda taken: F.when(F.size(taken) > 0, F.to_json(_variant(taken)))).alias("volatile"))

    return _named(F.try_parse_json(payload), lambda whole: _named(_object(whole), lambda entries: split(entries, whole)))


def overlay(base: Column, volatile: Column, depth: int = 8) -> Column:
    """``volatile`` laid over ``base``: objects merge name by name, anything else replaces; a null replaces too.

    ``depth``: on how many levels both may hold objects, the longest of the paths that were split; deeper ones are replaced whole.
    """

    def merged(x: Column, y: Column, left: int) -> Column:
        if not left:
            return y

        def both(a: Column, b: Column) -> Column:  # a JSON null is a value: only a missing name is a null here
            return F.map_zip_with(a, b, lambda k, v, w: F.when(w.isNull(), v).when(v.isNull(), w).otherwise(merged(v, w, left - 1)))

        return _named(_object(x), lambda a: _named(_object(y), lambda b: F.when(a.isNotNull() & b.isNotNull(), _variant(both(a, b))).otherwise(y)))

    return _named(F.try_parse_json(base), lambda x: _named(volatile, lambda v: F.to_json(F.when(v.isNull(), x).otherwise(_named(F.try_parse_json(v), lambda y: merged(x, y, depth))))))


def fingerprint(version: int, head: list[Column], items: Column | None = None, order: Column | None = None) -> Column:
    """Aggregate: SHA-256 of a version, a document's own values and its items in order.

    A null differs from an empty value. Each item goes in as its own hash, so a document's row is bounded by its number of items.
    """
    cells = lambda values: F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("-")) for v in values])
    own = cells([F.lit(version), *head])
    if items is None:
        return F.sha2(own, 256)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.sha2(items, 256).alias("h")))), lambda x: x["h"])
    return F.sha2(F.concat_ws("\x1e", own, F.array_join(listed, "\x1e")), 256)


def item_text(*values: Column) -> Column:
    """The values of one item as one text, nulls apart from empty ones."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("-")) for v in values])


def chat_fingerprints(chats: DataFrame, items: DataFrame, version: int = 1) -> DataFrame:
    """``(chat_uuid, period, fingerprint)`` of each document of a chat.

    ``chats (chat_uuid, title, source_url, org_uuid)``; ``items (chat_uuid, period, uuid, author, at_ms, text, attachments array<string>,
    reactions array<string>)``. Items count in order of (time, uuid), attachments as they are, reactions sorted.
    """
    item = item_text(F.col("uuid"), F.col("author"), F.col("at_ms"), F.col("text"), F.array_join("attachments", "+"), F.array_join(F.array_sort("reactions"), "+"))
    head = [F.col(c) for c in ("chat_uuid", "period", "title", "source_url", "org_uuid")]
    joined = items.join(chats, "chat_uuid")
    return joined.groupBy("chat_uuid", "period", "title", "source_url", "org_uuid").agg(fingerprint(version, head, item, F.struct("at_ms", "uuid")).alias("fingerprint")).select("chat_uuid", "period", "fingerprint")


def contact_fingerprint(uuid: Column, name: Column, group: Column, fields: Column, photo_bytes: Column, version: int = 1) -> Column:
    """Of a contact's own values, its fields as they are ordered and the size of its photo."""
    return fingerprint(version, [uuid, name, group, F.array_join(F.transform(fields, lambda f: F.concat(f["label"], F.lit("="), f["value"])), "\x1e"), F.coalesce(photo_bytes, F.lit(0))])


def record_fingerprints(records: DataFrame, children: DataFrame, key: str, payload: str, child: str, order: str, version: int = 1) -> DataFrame:
    """``(key, fingerprint)`` of records with children, review requests and pages: canonical JSON of both, children by ``order``."""
    from mnemora.functions.columns import canonical_json

    joined = records.select(key, canonical_json(F.col(payload)).alias("__own")).join(children.select(key, canonical_json(F.col(child)).alias("__child"), order), key, "left")
    return joined.groupBy(key, "__own").agg(
        F.sha2(F.concat_ws("\x1e", F.lit(str(version)), F.col("__own"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__child").isNotNull(), F.struct(F.col(order).alias("o"), F.sha2("__child", 256).alias("h"))))), lambda x: x["h"]), "\x1e")), 256).alias("fingerprint")
    ).select(key, "fingerprint")


def series_fingerprints(readings: DataFrame, keys: list[str], at: str = "ts_ms", value: str = "value", version: int = 1) -> DataFrame:
    """``(keys, n, fingerprint)`` of series: an order-free sum of the readings' hashes, so that a series of any length is summed where it is read."""
    h = F.xxhash64(F.col(at), F.col(value))
    summed = readings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("__s"), F.bit_xor(h).alias("__x"))
    return summed.select(*keys, "n", F.sha2(F.concat_ws("\x1f", F.lit(str(version)), *[F.col(k).cast("string") for k in keys], F.col("n").cast("string"), F.col("__s").cast("string"), F.col("__x").cast("string")), 256).alias("fingerprint"))
