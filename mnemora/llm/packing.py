"""Packing: sum-of-squares online packing of token sequences into fixed windows.

A document's ids are cut at the window size; its full pieces are windows of their own.
The rest, shorter than a window, is an item of the online rule: with ``N[h]`` windows
filled to level ``h`` (0 < h < size), it goes to the level, or to a new window, that
makes the sum of ``N[h]**2`` least. The levels' counts are one array; windows of a level
are taken last in, first out. A window that is exactly full is closed and emitted.
At a task's end the fullest windows still open keep what the rule gave them, and the items of the emptiest
fill them up, cut at the edges; what is left of the last one is cut at powers of two, which need no padding.

Each task packs the rows it reads: nothing is shuffled, a task holds the ids of its open
windows alone (some hundreds of windows; at most the ids of what it reads), and a task that runs
again gives the same windows for the same rows.

Tokens: a word-level cache over the tokenizer. Its pre-tokenizer splits at white space, which
it drops, and its normaliser works on characters, so a text's ids are its words' ids in turn.

Defined cases: a null or empty text has the end id alone; rows with null or repeated ids are
packed like others; very long texts give many full windows; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, column_bytes, task_number, texts, to_batches

SIZE = 2048
END_ID = 1

#: sequence_id = partition * 2**32 + number in the partition
SEQUENCES_PER_TASK = 1 << 32


class WordTokens(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, kept for words seen before.

    Letters of Latin-1 with ASCII punctuation after them, the most common form, go to the vocabulary's model in
    the two parts that the tokenizer's own splitting gives; all other words to the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 800_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.most = most
        self.plain = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]*)([!-&(-/:-@\[-`{-~]*)").fullmatch
        shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]  # a byte-level vocabulary writes these as they are
        self.bytes_as = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def ids(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        parts = self.plain(text)
        if parts:
            as_bytes = (x.lower() if x.isascii() else x.lower().encode().decode("latin-1").translate(self.bytes_as) for x in parts.groups() if x)
            return [t.id for x in as_bytes for t in self.model(x)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.ids(word)
        self[word] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def of(self, text: bytes) -> bytes:
        if len(self) > self.most:
            self.clear()
        # the tokenizer drops case, and this is ASCII's part of it; but its special tokens, which begin with this, are told by case
        words = text.split() if b"<|" in text else text.lower().split()
        return b"".join(map(self.__getitem__, words))


class Packer:
    """The level array and the open windows of one task.

    A piece is ``(doc, start, ids as bytes, doc_tokens)``; ``closed`` gets windows as
    lists of pieces, each exactly ``size`` ids or a power of two.
    """

    def __init__(self, size: int = SIZE):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.by_rule = self.moved = 0  # ids of windows that the rule filled or kept, and of items moved at the end

    def level_for(self, length: int) -> int:
        """The level whose windows take an item of ``length`` at the least sum of squares."""
        there = self.counts[: self.size - length + 1]
        change = 2 * (self.counts[length:] - there) + 2  # one more at the level reached, one fewer at the level left
        change[-1] = 1 - 2 * there[-1]  # a full window counts at no level
        change[there == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.counts[length] + 1  # a new window leaves no level
        return len(change) - 1 - int(change[::-1].argmin())  # of equals the fullest window

    def add(self, doc, ids: bytes) -> Iterator[list]:
        total, size = len(ids) // 4, self.size
        whole = total // size * size
        for start in range(0, whole, size):
            yield [(doc, start, ids[4 * start : 4 * (start + size)], total)]
        if total > whole:
            yield from self._place((doc, whole, ids[4 * whole :], total))

    def _place(self, piece: tuple) -> Iterator[list]:
        length = len(piece[2]) // 4
        level = self.level_for(length)
        window = self.open[level].pop() if level else []
        self.counts[level] -= level > 0
        window.append(piece)
        if level + length == self.size:
            self.by_rule += self.size
            yield window
        else:
            self.counts[level + length] += 1
            self.open[level + length].append(window)

    def finish(self) -> Iterator[list]:
        """Close all open windows: the fullest first, with the items of the emptiest, cut where a window is full."""
        windows = [w for level in sorted(self.open) for w in self.open[level]]
        self.open.clear()
        self.counts[:] = 0
        filler: list[tuple] = []
        first, last = 0, len(windows) - 1
        while first <= last:
            window = windows[last]
            last -= 1
            room = self.size - sum(len(ids) for _, _, ids, _ in window) // 4
            self.by_rule += self.size - room
            while room and (filler or first <= last):
                if not filler:
                    filler, first = windows[first][::-1], first + 1
                doc, start, ids, total = filler.pop()
                part, ids = ids[: 4 * room], ids[4 * room :]
                window.append((doc, start, part, total))
                room -= len(part) // 4
                self.moved += len(part) // 4
                if ids:
                    filler.append((doc, start + len(part) // 4, ids, total))
            if room:
                yield from self._powers(window, self.size - room)
            else:
                yield window
        if filler:
            filler = filler[::-1]
            yield from self._powers(filler, sum(len(ids) for _, _, ids, _ in filler) // 4)

    def _powers(self, pieces: list, left: int) -> Iterator[list]:
        for power in (1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1):
            window = []
            while power:
                doc, start, ids, total = pieces[0]
                part = ids[: 4 * power]
                window.append((doc, start, part, total))
                power -= len(part) // 4
                pieces = ([(doc, start + len(part) // 4, ids[len(part) :], total)] if len(part) < len(ids) else []) + pieces[1:]
            yield window


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", most_words: int = 800_000) -> DataFrame:
    """Pieces of all texts: ``(id, start, length, doc_tokens, sequence_id, offset, ids binary)``.

    ``ids``: the piece's ids, little-endian unsigned 32-bit. A sequence's pieces have the
    offsets 0 to its length without gaps; sequences shorter than ``size`` are powers of two.
    ``most_words``: the words whose ids a task keeps, some 400 bytes each.
    """
    rows = texts(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType
    arrow_id = pa.int64() if id_type.typeName() == "long" else None
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        tokens, packer, number = WordTokens(tokenizer_path, most_words), Packer(size), task_number() * SEQUENCES_PER_TASK
        kind = [arrow_id]

        def windows():
            for batch in batches:
                ids = column(batch, "id")
                kind[0] = ids.type
                for doc, text in zip(ids.to_pylist(), column_bytes(batch, "text")):
                    yield from packer.add(doc, tokens.of(text) + end)
            yield from packer.finish()

        def pieces():
            nonlocal number
            for window in windows():
                offset = 0
                for doc, start, ids, total in window:
                    yield doc, start, len(ids) // 4, total, number, offset, ids
                    offset += len(ids) // 4
                number += 1

        whole = pieces()
        first = next(whole, None)
        if first is not None:
            import itertools

            long = pa.int64()
            schema = pa.schema([("id", kind[0]), ("start", long), ("length", long), ("doc_tokens", long), ("sequence_id", long), ("offset", long), ("ids", pa.binary())])
            yield from to_batches(itertools.chain([first], whole), schema)

    return rows.mapInArrow(run, f"id {id_type.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
