import re
from collections import defaultdict

import pytest

import corpus_pipeline
from mnemora.llm import quality, queries

from .data import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def stored(spark, path, rows, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def plain_stages(rows):
    """Exact copies, near copies by all pairs of word shingles of five, and passages of 20 words, in turn, by loops."""
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    rows = [(i, t) for i, t in sorted(rows) if i in first.values()]
    yield dict(rows)
    sets = {i: ({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set()) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = [(i, t) for i, t in rows if find(i) == i]
    yield dict(rows)
    seen, left = defaultdict(lambda: None), {}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if seen[k] is not None:
                gone[j : j + 20] = [True] * 20
            else:
                seen[k] = i
        left[i] = " ".join(x for x, g in zip(w, gone) if not g)
    yield left


def test_every_stage_is_the_plain_one(spark, tmp_path):
    """Each stage on what the one before it kept; junk is what the labels call bad."""
    rows = [(i, t + (" $$$ %%% ### @@@ &&&" * 20 if i % 5 == 0 else "")) for i, (_, t) in enumerate(corpus(150, 11))]
    sf = stored(spark, tmp_path, rows, [(i, int(i % 5 != 0), 0) for i, _ in rows if i % 3])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.id for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    assert all(i in good for i, _ in rows if i % 5) and not any(i in good for i, _ in rows if i % 5 == 0)
    kept = corpus_pipeline.cut(corpus_pipeline.STAGES[0][1](spark, docs, sf))
    assert {r.doc_id for r in kept.collect()} == good
    for (name, stage), want in zip(corpus_pipeline.STAGES[1:4], plain_stages([(i, t) for i, t in rows if i in good])):
        kept = corpus_pipeline.cut(stage(spark, kept, sf))
        assert {r.doc_id: " ".join(r.text.split()) for r in kept.collect()} == {i: " ".join(t.split()) for i, t in want.items()}, name
    pieces = corpus_pipeline.STAGES[4][1](spark, kept, sf).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept.collect()}
    found, windows = defaultdict(int), defaultdict(list)
    for p in pieces:
        found[p.doc_id] += p.length
        windows[p.sequence_id].append((p.offset, p.length))
    assert found == sizes and {p.doc_id: p.doc_tokens for p in pieces} == sizes
    for parts in windows.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for a, n in parts if a < b) for b, _ in sorted(parts)] and sum(n for _, n in parts) <= 2048


def test_run_takes_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, empty, blank and long ones, repeated rows; labels of rows that aren't there, null ones, none at all."""
    rows = [(1, ""), (2, None), (3, " \n\t "), (4, " ".join(f"w{i % 997}" for i in range(20_000))), (5, "one two three"), (5, "one two three"), (6, "one two three"), (None, "null id here"), (None, None)]
    odd = stored(spark, tmp_path / "odd", rows, [(4, 1, 0), (5, 1, 0), (99, 0, 0), (None, 0, 1)])
    got = corpus_pipeline.run(spark, odd).collect()
    assert {4, 5} <= {r.doc_id for r in got} and sum(r.start == 0 for r in got if r.doc_id == 5) == 1 and 6 not in {r.doc_id for r in got}
    assert sum(r.length for r in got if r.doc_id == 4) == next(r.doc_tokens for r in got if r.doc_id == 4)
    assert corpus_pipeline.run(spark, stored(spark, tmp_path / "none", [], [])).count() == 0


def test_stages_keep_the_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count()
        docs = after
    assert docs.count() > before / 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    sums = pieces.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).collect()
    assert len(sums) == docs.count() and all(r["sum(length)"] == r.doc_tokens for r in sums)


def test_every_operator_is_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]


def test_batches_for_python_workers_are_bounded(spark, tmp_path):
    """Every stage plans batches of bounded bytes, whatever the number of rows."""
    sf = stored(spark, tmp_path, [(i, f"w{i} " * 1000) for i in range(40)], [(1, 1, 0), (2, 0, 0)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat(cast(id as string), 2000) as text")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs, sf)
        assert max(r.n for r in wide.mapInArrow(sizes, "n long").collect()) < 5 << 20, name
