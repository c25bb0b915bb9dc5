"""Feeds of an account's export: reviews and saved places, subscriptions, text conversations and calls.

GeoJSON and CSV are read by Spark's own formats. Conversations and calls are small HTML files, one for each conversation or call; a task reads
them one at a time.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.columns import uuid5

#: The kinds of calls as files' names state them, and as rows do.
CALLS = {"Voicemail": "voicemail", "Missed": "missed", "Placed": "placed", "Received": "received", "Recorded": "recorded"}


def place_key(url: Column) -> Column:
    """What a map's address says of a place: the hexadecimal id after ``!1s``, else the number after ``cid=``; empty without either."""
    feature = F.regexp_extract(url, r"!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)", 1)
    return F.when(feature != "", feature).otherwise(F.regexp_extract(url, r"[?&]cid=([0-9]+)", 1))


def places(spark: SparkSession, root: str, file_name: str, kind: str, namespace: str) -> DataFrame:
    """``(id, date, key, name, address, rating, text)`` of the features of all files named ``file_name`` below ``root``.

    ``id`` is a name-based UUID of ``kind:key:date``, so that an export read again gives the same rows; features without a key or a date are left out.
    """
    location = "struct<name:string,address:string>"
    schema = f"features array<struct<properties:struct<date:string,google_maps_url:string,location:{location},five_star_rating_published:int,review_text_published:string>>>"
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", file_name).json(root)
    p = files.select(F.explode("features.properties").alias("p")).where("p is not null")
    keyed = p.select(F.coalesce("p.date", F.lit("")).alias("date"), place_key(F.coalesce("p.google_maps_url", F.lit(""))).alias("key"), "p.location.name", "p.location.address", F.col("p.five_star_rating_published").alias("rating"), F.col("p.review_text_published").alias("text"))
    return keyed.where("key <> '' and date <> ''").select(uuid5(namespace, F.concat_ws(":", F.lit(kind), "key", "date")).alias("id"), "*")


def subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """``(channel_id, url, title)`` of an export's subscriptions; titles may hold commas and quotes."""
    rows = spark.read.options(header=True, quote='"', escape='"', enforceSchema=True).schema("channel_id string, url string, title string").csv(path)
    return rows.where("channel_id is not null")


class Conversation(HTMLParser):
    """One file: ``messages`` of a text conversation, or ``call``, told by the classes of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.messages: list[dict] = []
        self.call: dict | None = None
        self.taking: tuple[str, str] | None = None  # the tag that is read and the field it fills

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        named = set(a.get("class", "").split())
        if tag == "div" and "message" in named:
            self.messages.append({"attachments": []})
        if tag == "div" and "haudio" in named:
            self.call = {}
        own = self.messages[-1] if self.messages else self.call
        if own is None:
            return
        if tag == "abbr" and named & {"dt", "published", "duration"}:
            own["duration" if "duration" in named else "at"] = a.get("title", "")
        elif tag == "a" and "tel" in named:
            own.setdefault("tel", a.get("href", "").removeprefix("tel:"))
        elif tag in ("img", "audio", "video") and a.get("src"):
            own.setdefault("attachments", []).append(a["src"])
        elif tag == "br" and self.taking:
            own[self.taking[1]] += "\n"
        elif self.taking is None and (tag == "q" or named & {"fn", "full-text"}):
            field = "body" if tag == "q" or "full-text" in named else "name"
            if field not in own:
                own[field] = ""
                self.taking = (tag, field)

    def handle_endtag(self, tag):
        if self.taking and tag == self.taking[0]:
            self.taking = None

    def handle_data(self, data):
        if self.taking:
            (self.messages[-1] if self.messages else self.call)[self.taking[1]] += data


def _files(spark: SparkSession, root: str) -> DataFrame:
    """``(conversation, type, content)``: files are named by the other party, the type and the time.

    Where Spark wrote the export, a folder ``<column>=<name>.html`` with one part stands for a file.
    """
    form = r"(?:(?<=/)[^/=]+=(?=[^/]*\.html/part-))?([^/]*?) - ([A-Za-z ]+) - [^/]*\.html(?:/part-[^/]*)?$"
    path = F.try_url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{*.html,part-*}").load(root)
    return files.where(path.rlike(form)).select(F.regexp_extract(path, form, 1).alias("conversation"), F.regexp_extract(path, form, 2).alias("type"), "content")


def voice_messages(spark: SparkSession, root: str) -> DataFrame:
    """``(conversation, place, at, tel, name, is_me, body, attachments)`` of the text conversations below ``root``, in each file's order."""
    texts = _files(spark, root).where(~F.col("type").isin(*CALLS))
    names = ["conversation", "place", "at", "tel", "name", "is_me", "body", "attachments"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())]

    def run(batches):
        for batch in batches:
            rows = []
            for conversation, content in zip(batch.column(0).to_pylist(), batch.column(2)):
                page = Conversation()
                page.feed(content.as_py().decode("utf-8", "replace"))
                page.close()
                rows += [(conversation, k, m.get("at"), m.get("tel") or None, m.get("name"), m.get("name") == "Me", m.get("body", ""), m["attachments"]) for k, m in enumerate(page.messages)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return texts.mapInArrow(run, "conversation string, place int, at string, tel string, name string, is_me boolean, body string, attachments array<string>")


def voice_calls(spark: SparkSession, root: str) -> DataFrame:
    """``(conversation, kind, at, tel, name, seconds, transcript, attachments)`` of the calls and voicemails below ``root``."""
    calls = _files(spark, root).where(F.col("type").isin(*CALLS))
    names = ["conversation", "kind", "at", "tel", "name", "duration", "transcript", "attachments"]

    def run(batches):
        for batch in batches:
            rows = []
            for conversation, kind, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                page = Conversation()
                page.feed(content.as_py().decode("utf-8", "replace"))
                page.close()
                if page.call is not None:
                    c = page.call
                    rows.append((conversation, CALLS[kind], c.get("at"), c.get("tel") or None, c.get("name"), c.get("duration"), c.get("body"), c.get("attachments", [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.string()) if k == 7 else pa.string()) for k, c in enumerate(zip(*rows))], names)

    read = calls.mapInArrow(run, "conversation string, kind string, at string, tel string, name string, duration string, transcript string, attachments array<string>")
    part = lambda unit: F.coalesce(F.regexp_extract("duration", rf"([0-9]+){unit}", 1).try_cast("long"), F.lit(0))
    seconds = F.when(F.col("duration").rlike("^PT"), part("H") * 3600 + part("M") * 60 + part("S"))
    return read.withColumn("seconds", seconds).select("conversation", "kind", "at", "tel", "name", "seconds", "transcript", "attachments")
