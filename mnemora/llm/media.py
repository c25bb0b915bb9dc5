"""Media columns: signature sniffing of binary values.

One Aho-Corasick automaton finds every magic byte string of the formats below in a value;
a validator for each format then reads the structure at that place and confirms it by its
lengths and checks. The format at offset 0 is the value's true type and corrects the declared
one; confirmed media at other offsets, outside of what encloses them, are carved out.

``wave`` is the lossless writer the query uses: bytes as mono unsigned 8-bit samples.

Defined cases: a null value is empty, an empty or unknown value has the type
``application/octet-stream`` and no media; a magic string without a valid structure is text
that happens to look alike and is not reported; equal values give equal results.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, column_bytes, texts, to_batches

UNKNOWN = "application/octet-stream"


class Value(bytes):
    """A value whose searches for one string, at rising places, read it once in all."""

    def next(self, part: bytes, at: int) -> int:
        seen = self.__dict__.setdefault("seen", {})
        begin, found = seen.get(part, (0, -2))
        if found == -2 or at < begin or 0 <= found < at:
            seen[part] = begin, found = at, self.find(part, at)
        return found


def _wave(b: bytes, i: int) -> int:
    """RIFF: the chunks after the header must fill the stated size; fmt before data."""
    if len(b) < i + 44 or bytes(b[i + 8 : i + 12]) != b"WAVE":
        return 0
    end = i + 8 + struct.unpack_from("<I", b, i + 4)[0]
    at, seen = i + 12, []
    while at + 8 <= end <= len(b):
        kind, n = struct.unpack_from("<4sI", b, at)
        seen.append(kind)
        at += 8 + n + n % 2
    return end - i if at == end and seen[:1] == [b"fmt "] and b"data" in seen else 0


def _png(b: bytes, i: int) -> int:
    """Chunks with right checksums from IHDR to IEND."""
    at, first = i + 8, True
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if at + 12 + n > len(b) or (kind == b"IHDR") != first or zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return 0
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at - i
    return 0


def _gif(b: bytes, i: int) -> int:
    """Blocks up to the trailer."""
    if len(b) < i + 13:
        return 0
    flags = b[i + 10]
    at = i + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    images = 0
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1 - i if images else 0
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and at + 10 < len(b):
            flags = b[at + 9]
            at += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
            images += 1
        else:
            return 0
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return 0


def _jpeg(b: Value, i: int) -> int:
    """Marker segments by their lengths, then scan data up to the end marker."""
    at = i + 2
    while at + 4 <= len(b) and b[at] == 0xFF and 0xC0 <= b[at + 1] <= 0xFE:
        kind, n = b[at + 1], struct.unpack_from(">H", b, at + 2)[0]
        if n < 2:
            return 0
        at += 2 + n
        if kind == 0xDA:
            end = b.next(b"\xff\xd9", at)
            return end + 2 - i if end >= 0 else 0
    return 0


def _bmp(b: bytes, i: int) -> int:
    """Size field, header size and data offset agree."""
    if len(b) < i + 54:
        return 0
    size, reserved, data, header = struct.unpack_from("<IIII", b, i + 2)
    return size if not reserved and header in (40, 52, 56, 108, 124) and 14 + header <= data <= size <= len(b) - i else 0


def _gzip(b: bytes, i: int) -> int:
    """A whole member that inflates."""
    if len(b) < i + 18 or b[i + 2] != 8 or b[i + 3] & 0xE0:
        return 0
    one = zlib.decompressobj(31)
    at = i
    try:
        while at < len(b) and not one.eof:
            one.decompress(one.unconsumed_tail or b[at : (at := at + 65536)], 1 << 20)
    except zlib.error:
        return 0
    return at - i - len(one.unused_data) if one.eof else 0


def _pdf(b: Value, i: int) -> int:
    if len(b) < i + 8 or not (48 <= b[i + 5] <= 57 and b[i + 6] == 46):
        return 0
    end, start = b.next(b"%%EOF", i), b.next(b"startxref", i)
    return end + 5 - i if 0 <= start < end and re.match(rb"startxref\s+\d+\s+%%EOF", b[b.rfind(b"startxref", start, end) : end + 5]) else 0


#: Magic bytes, media type and validator of the formats known here.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int]], ...] = (
    (b"RIFF", "audio/wav", _wave),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
)


class Sniffer:
    """The automaton over all magic strings."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(FORMATS):
            self.automaton.add_word(magic.decode("latin-1"), k)
        self.automaton.make_automaton()

    def __call__(self, value: bytes) -> list[tuple[int, str, int]]:
        """Confirmed media as ``(offset, type, length)`` by place: the value itself, where it is one, and in it or in unknown bytes the outermost ones."""
        whole, found, upto = Value(value), [], 0
        hits = sorted((end + 1 - len(FORMATS[k][0]), k) for end, k in self.automaton.iter(value.decode("latin-1")))
        for at, k in hits:
            if at >= upto and (n := FORMATS[k][2](whole, at)):
                found.append((at, FORMATS[k][1], n))
                upto = at + n if at else 1  # what is inside of an embedded one is part of it
        return found


def wave(payload: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit PCM whose samples are the payload's bytes."""
    pad = b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + pad


def wave_samples(stored: bytes) -> bytes:
    """The bytes of the data chunk, found by walking the chunks."""
    at = 12
    while at + 8 <= len(stored):
        kind, n = struct.unpack_from("<4sI", stored, at)
        if kind == b"data":
            return stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def sniff(values: DataFrame, id_col: str = "id", value_col: str = "value", declared_col: str | None = None) -> DataFrame:
    """``(id, declared, media_type, corrected, media_length, embedded array<struct<offset,type,length,bytes>>)``."""
    rows = values.select(F.col(id_col).alias("id"), F.col(value_col).cast("binary").alias("value"), (F.col(declared_col) if declared_col else F.lit(None)).cast("string").alias("declared"))
    part = pa.struct([("offset", pa.int64()), ("type", pa.string()), ("length", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        look = Sniffer()
        for batch in batches:
            ids = column(batch, "id")
            schema = pa.schema([("id", ids.type), ("declared", pa.string()), ("media_type", pa.string()), ("corrected", pa.bool_()), ("media_length", pa.int64()), ("embedded", pa.list_(part))])

            def out():
                for key, value, declared in zip(ids.to_pylist(), column_bytes(batch, "value"), column(batch, "declared").to_pylist()):
                    found = look(value)
                    own = next((x for x in found if x[0] == 0), (0, UNKNOWN, 0))
                    carved = [{"offset": a, "type": t, "length": n, "bytes": value[a : a + n]} for a, t, n in found if a > 0]
                    yield key, declared, own[1], declared is not None and declared != own[1], own[2], carved

            yield from to_batches(out(), schema)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, declared string, media_type string, corrected boolean, media_length long, embedded array<struct<offset:long,type:string,length:long,bytes:binary>>")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 192) -> DataFrame:
    """Texts as media: ``(id, n_bytes, media binary)``, UTF-8 padded with spaces to a positive multiple of ``unit``."""
    rows = texts(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            ids = column(batch, "id")
            schema = pa.schema([("id", ids.type), ("n_bytes", pa.int64()), ("media", pa.binary())])

            def out():
                for key, text in zip(ids.to_pylist(), column_bytes(batch, "text")):
                    yield key, len(text), wave(text + b" " * ((unit - len(text) % unit) % unit if text else unit))

            yield from to_batches(out(), schema)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Read stored media back: ``(id, n_bytes, media, payload binary, feature)``.

    The type comes from sniffing, not from trust; ``feature`` states it with the length
    the validator confirmed, the samples' mean and their most common values, and the media
    found inside.
    """

    def run(batches):
        look = Sniffer()
        for batch in batches:
            ids = column(batch, "id")
            schema = pa.schema([("id", ids.type), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("feature", pa.string())])

            def out():
                for key, n, media in zip(ids.to_pylist(), column(batch, "n_bytes").to_pylist(), column_bytes(batch, "media")):
                    found = look(media)
                    own = next((x for x in found if x[0] == 0), (0, UNKNOWN, 0))
                    payload = wave_samples(media) if own[1] == "audio/wav" else b""
                    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                    common = [(int(v), int(counts[v])) for v in np.argsort(-counts, kind="stable")[:4] if counts[v]]
                    mean = int(counts @ np.arange(256)) / max(1, len(payload))
                    inside = ",".join(f"{t}@{a}+{m}" for a, t, m in found if a)
                    yield key, n, media, payload, f"type={own[1]};length={own[2]};samples={len(payload)};mean={mean:.4f};top={','.join(f'{v}:{c}' for v, c in common)};embedded={inside}"

            yield from to_batches(out(), schema)

    return stored.mapInArrow(run, f"id {stored.schema['id'].dataType.simpleString()}, n_bytes long, media binary, payload binary, feature string")


def digest(read: DataFrame) -> DataFrame:
    """Digest columns of media that were read back."""
    return read.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
