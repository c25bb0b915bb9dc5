"""Small corpora with planted copies, and the odd rows every operator must take."""

import random

ODD = "doc_id long, text string, id string, k long, words string"


def odd_rows(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, columns of clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [(1, ""), (2, None), (3, "   \n\t "), (4, long), (5, "one two"), (5, "one two"), (6, "one two"), (None, "null id here"), (None, None), (7, "ÄÖ ß é \x00 x"), (8, "a" * 5000)]
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], ODD)


def corpus(n=120, seed=3):
    """Texts of ``(doc_id, text)`` with exact copies, edited copies, shared passages and repeated lines."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ka lo mi re su ta vo ne".split() for b in "ban dor fel gim hus kel".split()]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, line = words(30), " ".join(words(12))
    out = []
    for i in range(n):
        kind, text = i % 6, words(r.randint(1, 150))
        if kind == 1 and out:
            text = r.choice(out)[1].replace("\n", " ").split()
        elif kind == 2 and out:
            text = r.choice(out)[1].split()
            for _ in range(max(1, len(text) // 40)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
        elif kind == 3:
            text = text[:40] + passage + text[40:]
        whole = " ".join(text)
        out.append((i, whole + "\n" + line if kind == 4 else whole))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
