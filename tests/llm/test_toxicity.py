import math
import zlib
from collections import Counter

import numpy as np
import pytest

from mnemora.llm import toxicity

from .data import corpus, odd_rows


def plain_grams(text):
    """All n-grams of 3 to 5 characters by loops, in lower case, white space and control characters as one space."""
    low = f" {text.lower()} "
    joined = ""
    for c in low:
        c = " " if ord(c) <= 32 else c
        if not (c == " " and joined.endswith(" ")):
            joined += c
    return [joined[i : i + n] for n in (3, 4, 5) for i in range(len(joined) - n + 1)]


@pytest.mark.parametrize("text", ["", "a", "ab", "Straße  und\n\tWÖRTER 🎉 z", "x" * 500, "İ ǅ ﬁ", " \x00 a \x1f"])
def test_buckets_are_those_of_the_ngrams(text):
    """Equal n-grams have equal buckets and there are as many of each; different ones differ but for rare collisions."""
    grams, found = plain_grams(text), toxicity.buckets(text).tolist()
    assert len(grams) == len(found)
    bucket = dict(zip(grams, found))
    assert [bucket[g] for g in grams] == found and len(set(found)) >= len(set(grams)) - 2


LABELS = "doc_id long, toxic int, text string"


def taught(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


def rows(n=200):
    """A corpus whose toxic rows hold one of three words."""
    words = ["zvarq", "mubrik", "plonth"]
    docs = [(i, t + (" " + words[i % 3] if i % 7 == 0 else "")) for i, (_, t) in enumerate(corpus(n, 5))]
    return docs, [(i, int(i % 7 == 0), "clash") for i, _ in docs if i % 4 != 1]


def test_scores_are_the_plain_classifiers(spark):
    """Counts, ratios and chosen features by dictionaries, weights by Newton steps on the dense matrix."""
    docs, labels = rows()
    shape = toxicity.Shape(features=150, steps=200)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, LABELS)
    got = {r.id: r.score for r in toxicity.classify(d, lab, shape=shape).collect()}

    known = {i: y for i, y, _ in labels if taught(i)}
    sets = {i: set(toxicity.buckets(t).tolist()) for i, t in docs}
    n = [sum(y == k for y in known.values()) for k in (0, 1)]
    counts = [Counter(b for i, y in known.items() if y == k for b in sets[i]) for k in (0, 1)]

    def evidence(b):
        a = [counts[0][b], counts[1][b]]
        cells = [(a[k], sum(a) * n[k] / sum(n)) for k in (0, 1)] + [(n[k] - a[k], (sum(n) - sum(a)) * n[k] / sum(n)) for k in (0, 1)]
        return sum(c * math.log(c / e) for c, e in cells if c > 0)

    kept = sorted(set(counts[0]) | set(counts[1]), key=lambda b: (-round(evidence(b), 9), b))[: shape.features]
    ratio = np.array([math.log((counts[1][b] + 1) / (n[1] + 2)) - math.log((counts[0][b] + 1) / (n[0] + 2)) for b in kept])
    x = lambda i: np.array([float(b in sets[i]) for b in kept]) * ratio
    design, y = np.array([np.r_[x(i), 1.0] for i in known]), np.array(list(known.values()), float)
    penalty = np.r_[np.full(len(kept), shape.penalty), 0.0]
    w = np.zeros(len(kept) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty) + 1e-10 * np.eye(len(w)), design.T @ (p - y) + penalty * w)
    want = {i: 1 / (1 + math.exp(-(np.r_[x(i), 1.0] @ w))) for i, _ in docs}
    assert max(abs(got[i] - want[i]) for i in want) < 0.02
    assert all((got[i] >= 0.5) == (i % 7 == 0) for i in want)


def test_held_out_accuracy(spark, sf_dir):
    from pyspark.sql import functions as F

    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.classify(docs, labels).where("held_out").join(labels, F.col("id") == F.col("doc_id")).select("score", "predicted", "toxic").collect()
    bad, good = [r for r in scored if r.toxic], [r for r in scored if not r.toxic]
    assert sum(r.predicted == r.toxic for r in scored) >= 0.94 * len(scored)
    assert np.mean([a.score > b.score for a in bad for b in good]) >= 0.9


def test_bounded_training_rows_and_one_class(spark):
    docs, labels = rows(80)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    assert toxicity.labelled(d, lab, "doc_id", "text", "toxic", 20).count() == 20
    one = toxicity.classify(d, lab.where("toxic = 0")).collect()
    taught_rows = sum(taught(i) and y == 0 for i, y, _ in labels)
    assert {r.score for r in one} == {1 / (taught_rows + 2)} and {r.predicted for r in one} == {0}


def test_toxicity_odd_rows(spark):
    odd = odd_rows(spark)
    labels = spark.createDataFrame([(4, 1, "x"), (5, 0, "x"), (5, 0, "x"), (6, None, "x"), (7, 3, "x"), (None, 1, "x")], LABELS)
    got = toxicity.classify(odd, labels, shape=toxicity.Shape(steps=3)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got) and all(r.held_out for r in got if r.id is None)
    assert toxicity.classify(odd.limit(0), labels).count() == 0 and len(toxicity.classify(odd, labels.limit(0)).collect()) == odd.count()
