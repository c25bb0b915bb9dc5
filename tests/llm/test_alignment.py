import hashlib
from collections import Counter, defaultdict

import pytest

from mnemora.llm import alignment

from .data import corpus, frame, odd_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """The contract by loops over tokens: ranges of bytes, groups at common ends, links by overlap."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel  # noqa: F401

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    both = alignment.sides(A, B)

    def ranges(pieces):
        at, out = 0, []
        for p in pieces:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    found = []
    for key, text in rows:
        text = text or ""
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pieces = [both.a_bytes[i] for i in ids[0]], [both.b_bytes[i] for i in ids[1]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in pieces):
            found.append((key, [], [], [], []))
            continue
        ra, rb = map(ranges, pieces)
        links = [(i, j) for i, (s, e) in zip(ids[0], ra) for j, (t, f) in zip(ids[1], rb) if s < f and t < e]
        common = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, low = [], 0
        for high in common:
            inside = [",".join(str(i) for i, (s, e) in zip(side, r) if low < e <= high) for side, r in zip(ids, (ra, rb))]
            groups.append("|".join(inside))
            low = high
        found.append((key, *ids, groups, links))
    counts = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (i, _), c in counts.items():
        most[i] = max(most[i], c)
    return sorted(
        (key if key is not None else -1, len(x), len(y), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if x else "")
        for key, x, y, groups, links in found
    )


def rows_of(df):
    return sorted((r.id if r.id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


SHORT = [
    (1, "hello world"), (2, "hello <|endoftext|> world <s> </s>"), (3, "Grüße, naïve café — ☃ 漢字かな交じり文 🎉🎉"), (4, "a▁b"), (5, ""), (6, None), (7, "   \n\n\t x  "), (8, "\x00\x01 z"),
    (9, "don't can't 12345 <0x41>"), (9, "don't can't 12345 <0x41>"), (None, "hello world"), (None, None), (10, " leading"), (11, "\r\n"), (12, "é ﬁ Ｆ"),
]


def test_alignment_is_the_plain_one(spark):
    rows = SHORT + corpus(30)
    assert rows_of(alignment.align(frame(spark, rows), A, B)) == plain(rows)


def test_alignment_counts_cross_chunks(spark):
    rows = corpus(40) + [(100, "very long " * 3000)]
    assert rows_of(alignment.align(frame(spark, rows, 5), A, B, most_links=300)) == rows_of(alignment.align(frame(spark, rows, 1), A, B))


def test_pieces_are_encoded_as_whole_texts_are():
    """Texts of white space, signs and letters in any order: ids by pieces are those of the whole text."""
    import random

    import numpy as np

    both, r = alignment.sides(A, B), random.Random(5)
    parts = [*"ab e  .,'s\n\t\r1９é漢🎉\x85\x1c\x00▁<|>İ-_", "'ll", "the ", " to", "  ", "\n\n"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        whole = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
        same = text and all(b"".join(of[i] for i in ids) == (" " + text).encode() for ids, of in zip(whole, (both.a_bytes, both.b_bytes)))
        for got, want in zip(both.encode([text]), whole):
            assert np.frombuffer(got[0], np.int32).tolist() == (want if same else []), repr(text)


def test_alignment_takes_odd_and_empty_tables(spark):
    odd = odd_rows(spark)
    got = alignment.align(odd, A, B).collect()
    assert len(got) == odd.count() and all(r.n_a + r.n_b - r.n_groups == r.n_links for r in got)
    assert alignment.align(odd.limit(0), A, B).count() == 0
