"""Words of many texts at once: their places and 64-bit hashes, by array operations alone."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import mix

MOST_BYTES = 2 << 20
#: Texts of one ``Words``: its arrays take some 40 bytes for each byte of them, so this bounds a worker's memory.
RUN_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_VALUE[_SPACE] = 0
_BASE, _LONG = 0xD1342543DE82EF95, 1 << 64


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, _LONG)):
        p = np.ones(n, np.uint64)
        done, step = 1, base
        while done < n:
            m = min(done, n - done)
            p[done : done + m] = p[:m] * np.uint64(step)
            step = step * step % _LONG
            done += m
        out.append(p)
    return out[0], out[1]


class Words:
    """All words of ``texts``: ``hash``, byte places ``start`` and ``end`` in ``data``, and ``first``, the number of each text's first word.

    A word's hash is the sum of its bytes' values times powers of their places in it, mixed.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        edges = np.cumsum([0, *map(len, texts)])
        word = ~_SPACE[raw]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = edges[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        begins[inner] = word[inner]  # a text's first byte begins a word though the byte before it is of another text
        ends[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, edges)
        if len(self.start):
            powers, inverse = _powers(1 << max(RUN_BYTES.bit_length() - 1, (len(raw) - 1).bit_length()))
            sums = np.add.reduceat(_VALUE[raw] * powers[: len(raw)], self.start)
            self.hash = mix(sums * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)

    def kept(self, i: int, gone: np.ndarray, text: bytes) -> bytes:
        """Text ``i`` without the words that ``gone`` marks: kept runs as they were, joined by a space."""
        a, b = self.first[i], self.first[i + 1]
        own = gone[a:b]
        if not own.any():
            return text
        edges = np.flatnonzero(np.diff(np.r_[True, own, True].astype(np.int8))).reshape(-1, 2) + a
        return b" ".join([self.data[s:e] for s, e in zip(self.start[edges[:, 0]].tolist(), self.end[edges[:, 1] - 1].tolist())])


def slices(sizes: list[int], most: int = MOST_BYTES) -> Iterator[slice]:
    """Runs of texts of bounded bytes; a longer text is a run of its own."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))
