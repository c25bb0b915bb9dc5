"""Editions of a text in TEI: nested divisions flattened to locators, editions united by locator."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = "book string, chapter string, section string, text string"


def _name(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _own_text(element) -> Iterator[str]:
    """All text below an element but for what lies in divisions of their own; inline markup counts as text."""
    yield element.text or ""
    for child in element:
        if isinstance(child.tag, str) and _name(child) != "div":
            yield from _own_text(child)
        yield child.tail or ""


def sections(xml: bytes) -> Iterator[tuple[str, str, str, str]]:
    """``(book, chapter, section, text)`` of one document, in its order.

    A section belongs to the nearest book and chapter around it; a chapter without sections is its section 1. Divisions
    without a book, or sections without a chapter, have no locator. White space is collapsed.
    """
    body = next((e for e in ElementTree.fromstring(xml).iter() if _name(e) == "body"), None)

    def walk(element, book: str, chapter: str):
        for child in element:
            if _name(child) != "div":
                yield from walk(child, book, chapter)
                continue
            kind, n = child.get("subtype"), child.get("n") or ""
            inner = (n or book, "") if kind == "book" else (book, n or chapter) if kind == "chapter" else (book, chapter)
            sections_below = kind == "chapter" and any(_name(e) == "div" and e.get("subtype") == "section" for e in child.iter() if e is not child)
            if kind == "section" and book and chapter:
                yield book, chapter, n, " ".join("".join(_own_text(child)).split())
            elif kind == "chapter" and not sections_below and book:
                yield book, n, "1", " ".join("".join(_own_text(child)).split())
            yield from walk(child, *inner)

    if body is not None:
        yield from walk(body, "", "")


def editions(spark: SparkSession, path: str, edition: str = r"([^/]+)\.xml$") -> DataFrame:
    """``(edition, book, chapter, section, text)`` of all TEI files below ``path``; a task holds one file at a time.

    ``edition`` finds an edition's name in its file's path. Empty texts and locators that aren't numbers (front and back
    matter) are left out; of a locator stated twice in a file the last one counts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", edition, 1).alias("edition"), "content").where("edition <> ''")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {row[:3]: row[3] for row in sections(content.as_py())}
                rows = [(name, *at, text) for at, text in found.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["edition", "book", "chapter", "section", "text"])

    read = files.mapInArrow(run, f"edition string, {SECTIONS}")
    numeric = F.col("book").rlike(r"^[+-]?[0-9]+$") & F.col("chapter").rlike(r"^[+-]?[0-9]+$") & F.col("section").rlike(r"^[+-]?[0-9]+$")
    return read.where(numeric & (F.col("text") != ""))


def numeric_key(part: str) -> Column:
    """A sort key under which "10" comes after "2": the number, then the text."""
    return F.struct(F.coalesce(F.col(part).try_cast("long"), F.lit(2**63 - 1)).alias("number"), F.col(part).alias("as_text"))


def edition_language(edition: Column) -> Column:
    """The language in an edition's short name, the part after its last hyphen without the number."""
    return F.regexp_replace(F.regexp_extract(edition, r"([^-]*)$", 1), "[0-9]+$", "")


def united(read: DataFrame, original: str = "grc") -> DataFrame:
    """``(book, chapter, section, texts)``: every locator of any edition, ``texts`` an array of ``(edition, text)``, those in the original's language first, then by name.

    An array holds a text for each edition, which are few; locators are spread over the tasks.
    """
    first = (edition_language(F.col("edition")) != original).cast("int")
    listed = read.groupBy("book", "chapter", "section").agg(F.sort_array(F.collect_list(F.struct(first.alias("later"), "edition", "text"))).alias("texts"))
    return listed.select("book", "chapter", "section", F.transform("texts", lambda x: F.struct(x["edition"].alias("edition"), x["text"].alias("text"))).alias("texts"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by book, chapter and section as numbers; a range partition sorts, no task sees all."""
    return rows.orderBy(numeric_key("book"), numeric_key("chapter"), numeric_key("section"))
