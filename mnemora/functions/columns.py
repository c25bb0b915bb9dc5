"""Scalar functions as column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 240


def first_chars(text: Column, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis where more follow."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def snippet(text: Column, needle: str) -> Column:
    """A window around the first match of ``needle`` on one line: 121 characters before it, 120 after."""
    if not needle:
        return F.replace(first_chars(text, SNIPPET), F.lit("\n"), F.lit(" "))
    at = F.locate(needle.lower(), F.lower(text))
    radius = SNIPPET // 2
    start = F.greatest(at - radius - 1, F.lit(1))
    end = at + len(needle) + radius  # one past the window
    window = F.concat(
        F.when(start > 1, F.lit("…")).otherwise(F.lit("")), F.substring(text, start, end - start), F.when(end <= F.length(text), F.lit("…")).otherwise(F.lit(""))
    )
    return F.replace(F.when(at > 0, window).otherwise(first_chars(text, SNIPPET)), F.lit("\n"), F.lit(" "))


def norm_path(path: Column) -> Column:
    """Lower case, runs of ``_`` and ``-`` as one ``-``."""
    return F.regexp_replace(F.lower(path), "[_-]+", "-")


def slugify(text: Column, most: int = 60) -> Column:
    """Lower-case words of letters and digits joined by ``-``."""
    return F.rtrim(F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, most), F.lit("-"))


def uuid_suffix(value: Column) -> Column:
    """The UUID at the end of ``slug-uuid``; other values unchanged."""
    found = F.regexp_extract(value, "(?:^|-)([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$", 1)
    return F.when(found != "", found).otherwise(value)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5: SHA-1 of the namespace's bytes and the name, assembled from its hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def period_key(ms: Column, period: str) -> Column:
    """Calendar bucket of epoch milliseconds in UTC, in any session's zone: ``month``, ``day``, ``year`` or ``all``; right for times before 1970."""
    if period == "all":
        return F.lit("all")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    return F.date_format(day, {"month": "yyyy-MM", "day": "yyyy-MM-dd", "year": "yyyy"}[period])


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, read as UTC in any session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def human_bytes(n: Column) -> Column:
    """Size with a binary unit and one decimal; plain bytes below 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_number(n / 1024**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_gap(ms: Column) -> Column:
    """A duration by its largest unit."""
    s = F.floor(ms / 1000)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit(" d")))
    )


def preview(text: Column, most: int = 200) -> Column:
    """The first line that isn't blank, cut to ``most`` characters."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.trim(F.get(lines, F.lit(0))), 1, most)


def escape_html(text: Column) -> Column:
    """Text as HTML text."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def content_type(name: Column) -> Column:
    """Media type by a file name's extension."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("application/octet-stream")
    for ext, kind in {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "mp4": "video/mp4", "mov": "video/quicktime", "mp3": "audio/mpeg", "ogg": "audio/ogg", "pdf": "application/pdf", "txt": "text/plain", "json": "application/json", "html": "text/html", "csv": "text/csv"}.items():
        out = F.when(extension == ext, F.lit(kind)).otherwise(out)
    return out


def when_offset(when: Column) -> Column:
    """The offset part of an RFC 3339 time."""
    return F.regexp_extract(when, r"(Z|[+-]\d{2}:\d{2})$", 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def canonical_json(payload: Column) -> Column:
    """A JSON text with the keys of every object in order and no white space; null where it can't be read."""
    return F.to_json(F.try_parse_json(payload))


def percent_encode(text: Column) -> Column:
    """Text as a part of a URL: all but letters, digits and ``-_.~`` as percent escapes of UTF-8."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def autolink(text: Column) -> Column:
    """Web addresses in escaped text as links."""
    return F.regexp_replace(text, r"(https?://[^\s<>\"]*[^\s<>\".,;:!?)])", '<a href="$1">$1</a>')


def yaml_safe(text: Column) -> Column:
    """A YAML scalar: in double quotes where it isn't plain."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9 _./-]*$") & ~F.lower(text).isin("null", "true", "false", "yes", "no", "on", "off") & ~text.endswith(" "), text).otherwise(quoted)


def thousands(n: Column) -> Column:
    """A whole number with commas between groups of three digits."""
    return F.format_number(n, 0)


def id_token(value: Column) -> Column:
    """An id from a link that ends with it: the last part of its path without query and dashes; other values trimmed."""
    tail = F.regexp_extract(value, r"^https?://[^?#]*/([^/?#]+)/?(?:[?#].*)?$", 1)
    hexes = F.regexp_extract(F.replace(tail, F.lit("-"), F.lit("")), r"([0-9a-fA-F]{32})$", 1)
    return F.when(hexes != "", F.lower(hexes)).when(tail != "", tail).otherwise(F.trim(value))
