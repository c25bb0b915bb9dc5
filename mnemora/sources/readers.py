"""Readers of the sources' files: JSON events, sidecars, CSV exports, XML backups, mailboxes, cards, file trees.

Each uses Spark's own formats; Python runs only where a format has none (mail headers), on Arrow batches.
"""

from __future__ import annotations

import csv
import email
import email.headerregistry
import email.policy
import hashlib
import re
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemora.durable import cut
from mnemora.functions.columns import epoch_ms

def raw_payloads(table: DataFrame, schema: str, key: str = "id", payload: str = "payload") -> DataFrame:
    """``(key, data)`` of rows whose JSON payload is there and can be read, in key order; others are skipped."""
    readable = table.where(F.try_parse_json(F.col(payload)).isNotNull())
    return readable.select(key, F.from_json(payload, schema, {"mode": "PERMISSIVE"}).alias("data")).orderBy(key)


def jsonl_latest(spark: SparkSession, created: str, updated: str, keys: list[str], schema: StructType | str) -> DataFrame:
    """The last record of each key, in the order in which keys were first seen; a record without its key is an error.

    ``created`` is read before ``updated``; inside a stream the file's offset orders.
    """
    read = lambda path, n: spark.read.schema(schema).json(path).select("*", F.lit(n).alias("__s"), F.col("_metadata.file_path").alias("__f"), F.monotonically_increasing_id().alias("__p"))
    both = read(created, 0).unionByName(read(updated, 1))
    missing = [F.col(k).isNull() for k in keys]
    checked = both
    for k, gone in zip(keys, missing):
        checked = checked.withColumn(k, F.when(gone, F.raise_error(F.lit(f"record without {k}")).cast("string")).otherwise(F.col(k)))
    order = ["__s", "__f", "__p"]
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    first = Window.partitionBy(*keys)
    place = F.min(F.struct(*order)).over(first)
    return checked.withColumn("__n", F.row_number().over(last)).withColumn("__first", place).where("__n = 1").orderBy("__first").drop("__n", "__first", *order)


def sidecars(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """Rows of all ``*.grid_rows.json`` below ``root`` with the source's folder name; those below ``system`` are left out."""
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.grid_rows.json").json(root)
    path = F.col("_metadata.file_path")
    return read.withColumn("path", path).withColumn("source_name", F.regexp_extract(path, r"([^/]+)/rendered_md/", 1)).where(~F.col("path").contains("/system/"))


def preamble(spark: SparkSession, path: str, names: list[str]) -> int:
    """How many lines an export has before its header, the first line that states all of ``names``; 0 where none does."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))
    cells = F.transform(F.split("value", ","), lambda x: F.regexp_replace(F.trim(x), r'^\ufeff?"?|"$', ""))
    found = lines.where(F.forall(F.array(*map(F.lit, names)), lambda x: F.array_contains(cells, x))).agg(F.min("n")).first()[0]
    return 0 if found is None else lines.where(F.col("n") < found).count()


def csv_export(spark: SparkSession, path: str, key: str | None = None, preamble_lines: int = 0) -> DataFrame:
    """One CSV file as a table of strings with an ``id``: its natural key, else a hash of its cells.

    Lines before the header are skipped by count (``preamble`` finds it) and repeated names numbered. Cells may hold commas, quotes and line ends. A
    file without a preamble is read by Spark's own reader; one with a preamble is a small export, whose text is parsed again from its header on.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False}
    if preamble_lines:
        whole = spark.read.text(path, wholetext=True)
        body = whole.select(F.regexp_replace("value", rf"(?s)\A\ufeff?(?:[^\n]*\n){{{preamble_lines}}}", "").alias("value"))
        records = body.select(F.explode(F.regexp_extract_all("value", F.lit(r'((?:"(?:[^"]|"")*"|[^"\n])+)(?:\n|\z)'), F.lit(1))).alias("record"))
        numbered = records.select(F.monotonically_increasing_id().alias("n"), F.regexp_replace("record", r"\r\z", "").alias("record"))
        header = numbered.orderBy("n").first()  # one line
        names = _unique(next(csv.reader([header["record"]]))) if header else ["_c0"]
        schema = ", ".join(f"`{n}` string" for n in names)
        cells = F.from_csv("record", schema, {"quote": '"', "escape": '"', "multiLine": "true"})
        table = numbered.where(F.col("n") > (header["n"] if header else 0)).where(F.trim("record") != "").select(cells.alias("c")).select("c.*")
    else:
        first = spark.read.options(**options | {"header": False}).csv(path).limit(1).first()
        names = _unique([str(c or "") for c in first] if first else ["_c0"])
        table = spark.read.options(**options | {"enforceSchema": True}).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]), {"ignoreNullFields": "false"}), 256)
    return table.withColumn("id", F.col(f"`{key}`") if key else row)


def _unique(names: list[str]) -> list[str]:
    """Column names as they are; a repeated one with its number."""
    plain = [n.lstrip("\ufeff").strip() for n in names]
    return [n if plain.index(n) == k else f"{n}_{plain[:k].count(n) + 1}" for k, n in enumerate(plain)]


def table_name(path: str) -> str:
    """The name of an exported file's table: its stem in lower case, words joined by ``_``."""
    stem = path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
    return re.sub(r"[^a-z0-9]+", "_", stem.lower()).strip("_")


def sms_backup(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, address, at_ms, outgoing, body, name)`` of text messages and calls of an XML backup."""
    fields = lambda *names: StructType.fromDDL(", ".join(f"`_{n}` string" for n in names))
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    texts = read("sms", fields("address", "date", "type", "body", "contact_name"))
    calls = read("call", fields("number", "date", "type", "duration", "contact_name"))
    a = texts.select(F.lit("text").alias("kind"), F.col("_address").alias("address"), F.col("_date").cast("long").alias("at_ms"), (F.col("_type") == "2").alias("outgoing"), F.col("_body").alias("body"), F.col("_contact_name").alias("name"))
    b = calls.select(F.lit("call").alias("kind"), F.col("_number").alias("address"), F.col("_date").cast("long").alias("at_ms"), (F.col("_type") == "2").alias("outgoing"), F.concat(F.col("_duration"), F.lit(" s")).alias("body"), F.col("_contact_name").alias("name"))
    return a.unionByName(b)


def mms_backup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Picture messages of an XML backup: ``(messages, attachments)``.

    ``messages (id, address, at_ms, outgoing, body, n_attachments)``: the texts of its plain parts joined by line ends; ``attachments
    (id, place, name, content_type, size, hash)``: other parts but the layout, with the hash of their decoded bytes. ``id`` is a hash of the message.
    """
    part = "struct<_ct:string,_name:string,_cl:string,_text:string,_data:string>"
    schema = StructType.fromDDL(f"`_address` string, `_date` string, `_msg_box` string, `_m_id` string, parts struct<part:array<{part}>>")
    rows = spark.read.format("xml").option("rowTag", "mms").schema(schema).load(path)
    parts = F.coalesce("parts.part", F.array().cast(f"array<{part}>"))
    identity = F.sha2(F.to_json(F.struct("_address", "_date", "_msg_box", "_m_id", "parts"), {"ignoreNullFields": "false"}), 256)
    plain = F.transform(F.filter(parts, lambda x: x["_ct"] == "text/plain"), lambda x: x["_text"])
    named = lambda x: F.coalesce(*[F.when(x[c] != "null", x[c]) for c in ("_cl", "_name")])
    content = lambda x: F.try_to_binary(x["_data"], F.lit("base64"))
    others = F.transform(F.filter(parts, lambda x: ~x["_ct"].isin("text/plain", "application/smil")), lambda x: F.struct(named(x).alias("name"), x["_ct"].alias("content_type"), F.octet_length(content(x)).alias("size"), F.sha2(content(x), 256).alias("hash")))
    read = rows.select(identity.alias("id"), F.col("_address").alias("address"), F.col("_date").cast("long").alias("at_ms"), (F.col("_msg_box") == "2").alias("outgoing"), F.array_join(plain, "\n").alias("body"), others.alias("others"))
    read = cut(read)  # both tables are of one read of the backup
    each = read.select("id", F.posexplode("others").alias("place", "x"))
    return read.select("id", "address", "at_ms", "outgoing", "body", F.size("others").alias("n_attachments")), each.select("id", "place", "x.*")


def sensor_csv(spark: SparkSession, path: str, time_column: str = "time", device: str = r"([^/]+)\.csv$") -> DataFrame:
    """``(device, metric, ts_ms, value)`` of CSV files, one for each device, read each by its own header; a metric given in two units is an error.

    ``device``: the pattern that finds a device's name in its file's path.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    headers = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "n").alias("header"), F.min("n").alias("first"))  # a line of each file
    cells = lambda c: F.transform(F.split(c, ","), lambda x: F.regexp_replace(F.trim(x), r'^"|"$', ""))
    names = cells("header")
    stems = F.transform(F.filter(names, lambda x: x != time_column), lambda x: F.regexp_replace(x, "_[^_]*$", ""))
    checked = headers.select("file", "first", F.when(F.size(F.array_distinct(stems)) < F.size(stems), F.raise_error(F.concat(F.lit("one metric in two units: "), F.col("header"))).cast("array<string>")).otherwise(names).alias("names"))
    rows = lines.join(checked, "file").where((F.col("n") != F.col("first")) & (F.trim("value") != "")).select("file", "names", cells("value").alias("cells"))
    at = F.element_at(F.col("cells"), F.array_position("names", F.lit(time_column)).cast("int"))
    long = rows.select("file", at.alias("at"), F.explode(F.arrays_zip("names", "cells")).alias("x")).where(F.col("x.names") != time_column)
    read = long.select(F.regexp_extract("file", device, 1).alias("device"), F.col("x.names").alias("metric"), epoch_ms(F.col("at").cast("timestamp_ntz")).alias("ts_ms"), F.nullif("x.cells", F.lit("")).cast("double").alias("value"))
    return read.where("value is not null")


class _Headers(email.headerregistry.HeaderRegistry):
    """The default policy's header classes, each made once: as it is, the registry makes a class for every header of every mail."""

    def __init__(self):
        super().__init__()
        self.made: dict[type, type] = {}

    def __getitem__(self, name):
        kind = self.registry.get(name.lower(), self.default_class)
        if kind not in self.made:
            self.made[kind] = super().__getitem__(name)
        return self.made[kind]

    def __reduce__(self):
        return type(self), ()


#: The bytes and the number of mails that are taken apart at once.
MAIL_BYTES, MAIL_ROWS = 4 << 20, 256


def _mails(batches):
    """``[(position, mail)]`` of an Arrow batch's mails, in runs of bounded bytes."""
    policy = email.policy.default.clone(header_factory=_Headers())
    for batch in batches:
        held, weight = [], 0
        for position, value in zip(batch.column(0), batch.column(1)):
            raw = value.as_py() or b""
            held.append((position.as_py(), email.message_from_bytes(raw.partition(b"\n")[2], policy=policy)))
            weight += len(raw)
            if weight >= MAIL_BYTES or len(held) >= MAIL_ROWS:
                yield held
                held, weight = [], 0
        if held:
            yield held


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """``(position, sender, subject, date, labels, body)`` of the mails of an mbox file, split at ``From `` lines by Spark's line separator."""
    parts = spark.read.option("lineSep", "\nFrom ").text(path).select(F.monotonically_increasing_id().alias("position"), F.col("value").cast("binary").alias("value"))
    schema = pa.schema([("position", pa.int64()), ("sender", pa.string()), ("subject", pa.string()), ("date", pa.string()), ("labels", pa.string()), ("body", pa.string())])

    def run(batches):
        for mails in _mails(batches):
            rows = []
            for position, mail in mails:
                text = re.sub(r"(?m)^>(>*From )", r"\1", _content(mail.get_body(("plain", "html"))))
                rows.append((position, mail["From"], mail["Subject"], mail["Date"], mail["X-Gmail-Labels"], text))
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else v if f.name == "position" else str(v) for v in c], f.type) for c, f in zip(columns, schema)], schema=schema)

    mails = parts.mapInArrow(run, "position long, sender string, subject string, date string, labels string, body string")
    return mails.withColumn("labels", gmail_labels(F.col("labels")))


def mail_attachments(spark: SparkSession, path: str) -> DataFrame:
    """``(position, place, name, content_type, size, hash)`` of the attachments of an mbox file's mails, as edges to contents by their hash.

    Mails are split as in ``mailbox``, by Spark, so that one file is read by several tasks; ``position`` tells mails apart as there.
    """
    parts = spark.read.option("lineSep", "\nFrom ").text(path).select(F.monotonically_increasing_id().alias("position"), F.col("value").cast("binary").alias("value"))
    names = ["position", "place", "name", "content_type", "size", "hash"]

    def run(batches):
        for mails in _mails(batches):
            rows = []
            for position, mail in mails:
                for place, part in enumerate(mail.iter_attachments() if mail.is_multipart() else ()):
                    content = part.get_payload(decode=True) or b""
                    rows.append((position, place, part.get_filename(), part.get_content_type(), len(content), hashlib.sha256(content).hexdigest()))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return parts.mapInArrow(run, "position long, place int, name string, content_type string, size long, hash string")


def _content(part) -> str:
    """A mail part's text; bytes that its charset, or one nobody knows, can't read are replaced."""
    raw = part.get_payload(decode=True) if part is not None else None
    if raw is None:
        return ""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def gmail_labels(value: Column) -> Column:
    """A list of labels from a comma list whose items may be in quotes."""
    items = F.regexp_extract_all(value, F.lit(r'("(?:[^"\\]|\\.)*"|[^,]+)'), F.lit(1))
    plain = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r'^"|"$', ""), r"\\(.)", "$1"))
    return F.filter(plain, lambda x: x != "")


def cards(spark: SparkSession, path: str) -> DataFrame:
    """``(position, uid, name, fields array<struct<label,value>>)`` of the vCards of files; folded lines are joined."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\n[ \t]", "").alias("value"))
    each = whole.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)BEGIN:VCARD\n(.*?)END:VCARD"), F.lit(1))).alias("position", "card"))
    lines = F.filter(F.split("card", "\n"), lambda x: x.contains(":"))
    fields = F.transform(lines, lambda x: F.struct(F.upper(F.regexp_extract(x, r"^(?:[\w-]+\.)?([\w-]+)[^:]*:", 1)).alias("label"), F.regexp_extract(x, r"^[^:]*:(.*)$", 1).alias("value")))
    first = lambda label: F.get(F.filter("fields", lambda f: f["label"] == label), F.lit(0))["value"]
    return each.select("position", fields.alias("fields")).select("position", first("UID").alias("uid"), first("FN").alias("name"), "fields")


def file_tree(spark: SparkSession, root: str, ignore: str | None = None) -> DataFrame:
    """``(path, size, mtime, hash)`` of all files below a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = files.where(~F.col("path").rlike(ignore)) if ignore else files
    return kept.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"))


def walked(spark: SparkSession, root: str, ignore_file: str, held_by: str | None = None) -> DataFrame:
    """``(path, size, mtime, hash, kept, pattern, at)`` of all files below ``root``, paths relative to it; ``kept``: by the lines of the ignore files.

    An ignore file's lines hold for its folder and all below it (see ``operators.ignore``), and it isn't listed itself. ``held_by``: a pattern of
    folders that only hold an ignore file for the folder around them. Spark lists no file whose name begins with ``.`` or ``_``.
    """
    from mnemora.operators import ignore

    files = file_tree(spark, root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    inside = lambda c: F.expr(f"substring({c}, locate('{base}', {c}) + {len(base)})")
    relative = files.select(inside("path").alias("path"), "size", "mtime", "hash")
    listed = relative.where(~F.col("path").rlike(rf"(^|/){re.escape(ignore_file)}$"))
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", ignore_file).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    folder = F.regexp_replace(F.regexp_replace(inside("path"), "[^/]*$", ""), "/$", "")
    if held_by:
        folder = F.regexp_replace(folder, held_by, "")
    frames = texts.select(folder.alias("directory"), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("patterns"))
    parts = F.split("path", "/")
    folders = listed.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).where("path <> ''").distinct().withColumn("is_dir", F.lit(True))
    decided = ignore.ignored(listed.select("path", F.lit(False).alias("is_dir")).unionByName(folders), frames).where("not is_dir")
    return listed.join(decided.drop("is_dir"), "path")


def chosen(names: list[str], include: list[str], exclude: list[str] = ()) -> list[str]:
    """Names that a pattern of ``include`` and none of ``exclude`` matches."""
    return [n for n in names if any(fnmatchcase(n, g) for g in include) and not any(fnmatchcase(n, g) for g in exclude)]


def mirrored(tables: dict[str, DataFrame], include: list[str], exclude: list[str] = (), drop_columns: list[str] = ()) -> dict[str, DataFrame]:
    """Tables and columns chosen by globs, as a mirror keeps them."""
    return {n: d.select(*[c for c in d.columns if not any(fnmatchcase(f"{n}.{c}", g) for g in drop_columns)]) for n, d in tables.items() if chosen([n], include, exclude)}


def mirror_key(table: DataFrame, stated: list[str] = (), stable: list[str] = (), declared: list[str] = ()) -> tuple[list[str], str]:
    """A mirrored table's key and where it is from: stated, else the first of ``stable`` that is there and unique, else declared, else none.

    Uniqueness is counted on the data, a column at a time.
    """
    if stated:
        return list(stated), "stated"
    for name in (c for c in stable if c in table.columns):
        whole, filled, distinct = table.agg(F.count(F.lit(1)), F.count(name), F.countDistinct(name)).first()
        if whole == filled == distinct:
            return [name], "stable"
    if declared and set(declared) <= set(table.columns):
        return list(declared), "declared"
    return [], "none"


def with_natural_keys(rows: DataFrame, names: DataFrame, foreign: dict[str, str], key: str = "id", name: str = "name") -> DataFrame:
    """``rows`` with row numbers of another table replaced by that table's lasting names, ``foreign``: column to the name's column; unknown ones are null."""
    for column, to in foreign.items():
        rows = rows.join(names.select(F.col(key).alias(column), F.col(name).alias(to)), column, "left").drop(column)
    return rows


def takeout_messages(spark: SparkSession, root: str) -> DataFrame:
    """``(space, sender, at, text)`` of the ``messages.json`` of every group folder below ``root``; the folder names the space."""
    schema = "messages array<struct<creator:struct<name:string,email:string>,created_date:string,text:string,topic_id:string>>"
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "messages.json").json(root)
    each = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/messages\.json$", 1).alias("space"), F.explode("messages").alias("m"))
    return each.select("space", F.coalesce("m.creator.name", "m.creator.email").alias("sender"), export_time(F.col("m.created_date")).alias("at"), F.col("m.text").alias("text"))


def export_time(stated: Column) -> Column:
    """A time as exports write it, ``Monday, January 1, 2024 at 10:00:00 AM UTC``, without zone; null where it isn't one."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(stated, r"^[A-Z][a-z]+, ", ""), r"[\u202f\u00a0]", " "), " UTC$", "")
    return F.try_to_timestamp(plain, F.lit("MMMM d, y 'at' h:mm:ss a")).cast("timestamp_ntz")


def takeout_history(spark: SparkSession, path: str) -> DataFrame:
    """``(title, url, channel, at)`` of a watch history in JSON; entries without a link are left out."""
    schema = "title string, titleUrl string, subtitles array<struct<name:string,url:string>>, time string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).where("titleUrl is not null")
    return rows.select(F.regexp_replace("title", "^Watched ", "").alias("title"), F.col("titleUrl").alias("url"), F.get("subtitles", F.lit(0))["name"].alias("channel"), F.regexp_replace("time", "Z$", "").cast("timestamp_ntz").alias("at"))


def write_sidecars(rows: DataFrame, path: str, document: str = "markdown_uuid") -> None:
    """A line of JSON for each document, ``{header, rows}``: its canonical row and all of its rows in order of (time, uuid)."""
    row = F.struct(*[F.col(c) for c in rows.columns if c != document])
    listed = rows.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col("when_ts_utc").alias("w"), F.col("uuid").alias("u"), row.alias("r")))).alias("s"))
    listed.select(F.struct(document, F.size("s").alias("n_rows")).alias("header"), F.transform("s", lambda x: x["r"]).alias("rows")).write.mode("overwrite").json(path)


def append_tape(rows: DataFrame, path: str) -> None:
    """One line of JSON for each row that was stored, after those that are there."""
    rows.write.mode("append").json(path)
