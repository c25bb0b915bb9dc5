"""Functions for SQL users: ``register(spark)``, then plain ``spark.sql``.

Scalar functions are SQL functions, so they stay inside the plan. Table functions are Python's, for
``LATERAL``; each takes a row's own arguments and holds nothing but that row.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Names with parameters, result and body.
SCALARS = {
    "mn_norm_path": ("path STRING", "STRING", "regexp_replace(lower(path), '[_-]+', '-')"),
    "mn_slug": ("text STRING", "STRING", "rtrim('-', substring(trim(BOTH '-' FROM regexp_replace(lower(text), '[^a-z0-9]+', '-')), 1, 60))"),
    "mn_first_chars": ("text STRING, n INT", "STRING", "CASE WHEN char_length(text) > n THEN concat(substring(text, 1, n), '…') ELSE text END"),
    "mn_terms": ("text STRING", "ARRAY<STRING>", r"filter(split(lower(text), '[^\\p{L}\\p{N}]+'), w -> w <> '')"),
    "mn_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))"),
    "mn_period": ("ms BIGINT, period STRING", "STRING", "CASE period WHEN 'all' THEN 'all' ELSE date_format(date_add(DATE'1970-01-01', CAST(floor(ms / 86400000D) AS INT)), CASE period WHEN 'month' THEN 'yyyy-MM' WHEN 'day' THEN 'yyyy-MM-dd' ELSE 'yyyy' END) END"),
}


#: Types that a shredded field can have.
FIELD_TYPES: dict[str, DataType] = {"string": StringType(), "bigint": LongType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType()}


def _fields(stated: str) -> StructType:
    """``name type, ...`` as a schema; a table function is analysed where there is no session to read it."""
    pairs = [item.split() for item in stated.split(",")]
    if any(len(p) != 2 or p[1].lower() not in FIELD_TYPES for p in pairs):
        raise ValueError(f"fields must be stated as name and type, of {', '.join(FIELD_TYPES)}")
    return StructType([StructField(name, FIELD_TYPES[kind.lower()]) for name, kind in pairs])


class Shred:
    """``mn_shred(payload, ddl)``: a payload's fields as columns; the second argument, a constant, states them and the result's schema."""

    @staticmethod
    def analyze(payload: AnalyzeArgument, ddl: AnalyzeArgument) -> AnalyzeResult:
        if ddl.value is None:
            raise ValueError("the fields must be a constant")
        return AnalyzeResult(_fields(ddl.value))

    def eval(self, payload: str, ddl: str):
        try:
            found = json.loads(payload or "null")
        except ValueError:
            return
        for item in found if isinstance(found, list) else [found]:
            if isinstance(item, dict):
                yield tuple(self._as(item.get(f.name), f.dataType) for f in _fields(ddl))

    @staticmethod
    def _as(value, kind):
        if value is None or isinstance(kind, StringType):
            return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return None
        return int(value) if isinstance(kind, LongType) else float(value)


class Sections:
    """``mn_tei(xml)``: the sections of a TEI document."""

    def eval(self, xml: str):
        from mnemora.sources.tei import sections

        if xml:
            yield from sections(xml.encode())


class Chunks:
    """``mn_chunks(text)``: a text's chunks for retrieval with their positions."""

    def eval(self, text: str):
        from mnemora.operators.retrieval import chunk_spans

        for number, (begin, end) in enumerate(chunk_spans(text or "")):
            yield number, begin, text[begin:end]


class Sentences:
    """``mn_sentences(text)``: sentences with their positions, cut after ``.``, ``!`` or ``?`` before white space."""

    def eval(self, text: str):
        import re

        number = 0
        for found in re.finditer(r"(?s)\S.*?(?:[.!?]+(?=\s)|\s*\Z)", text or ""):
            sentence = found.group().rstrip()
            if sentence:
                yield number, found.start(), sentence
                number += 1


TABLES = {
    "mn_shred": (Shred, None),
    "mn_tei": (Sections, "book string, chapter string, section string, text string"),
    "mn_chunks": (Chunks, "number int, position int, text string"),
    "mn_sentences": (Sentences, "number int, position int, text string"),
}


def register(spark: SparkSession) -> None:
    """All functions under their names, for this session."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, udtf(handler, returnType=schema) if schema else udtf(handler))
