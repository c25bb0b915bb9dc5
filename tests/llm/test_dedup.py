import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from mnemora.llm import exact_dedup, line_dedup, near_dedup, substring_dedup, words

from .data import corpus, frame, odd_rows

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_groups_match_a_dictionary(spark):
    rows = corpus() + [(900, "a  b"), (901, "a\tb"), (902, "a\n b"), (903, "a b")]
    first, size = {}, defaultdict(int)
    for i, t in rows:
        key = SPACE.sub(" ", t)
        first[key] = min(first.get(key, i), i)
        size[key] += 1
    got = {r.id: r for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        key = SPACE.sub(" ", t)
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (first[key], size[key], first[key] == i)
        assert got[i].text_sha256 == hashlib.sha256(key.encode()).hexdigest()


def test_exact_odd_rows(spark):
    docs = odd_rows(spark)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == docs.count()
    assert {r.keep_id for r in got if r.id == 6} == {5}
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def _sets(rows):
    out = {}
    for i, t in rows:
        w = t.encode().lower().split()
        out[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    return out


def test_near_groups_match_all_pairs(spark):
    rows = corpus(160)
    sets, parent = _sets(rows), {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.id: r for r in near_dedup.near_groups(frame(spark, rows), shingle=4).collect()}
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in sets}
    assert all(r.n_shingles == len(sets[i]) and r.kept == (r.component_id == i) for i, r in got.items())


def test_near_last_round_settles_chains(spark):
    """A chain of edits: neighbours are alike, ends are not, so pivots alone can't link all."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):
        words[k * 3] = f"new{k}"
        rows.append((k, " ".join(words)))
    got = near_dedup.near_groups(frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}


def test_near_odd_rows(spark):
    docs = odd_rows(spark)
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == docs.count()
    by = {r.id: r for r in got if r.id is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[6].component_id == 5 and by[1].component_id == 1
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 7, 100, 3000):
        s = near_dedup.sketch(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(7919), 240)
        assert (s != near_dedup.FULL).all()


def _substring(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = t.encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_substring_matches_all_windows(spark):
    rows = corpus(150, seed=8) + [(500, "la " * 70), (501, "x y " * 40), (502, " ".join(str(i % 25) for i in range(300)))]
    got = {r.id: (r.n_words, r.n_removed, " ".join(r.kept.split())) for r in substring_dedup.remove_repeats(frame(spark, rows, 4)).collect()}
    assert got == _substring(rows)


def test_substring_odd_rows(spark):
    docs = odd_rows(spark)
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    long = next(r for r in got if r.id == 4)
    assert long.n_words == 60_000 and long.n_removed > 50_000
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    kept = substring_dedup.without_repeats(docs.where("doc_id is not null"))
    assert kept.columns == docs.columns and kept.count() == 9


def test_substring_null_ids_are_documents_of_their_own(spark):
    """A passage that many rows without ids share stays once; equal rows without ids keep what they have."""
    shared = " ".join(f"s{k}" for k in range(30))
    rows = [(None, f"{shared} {i}") for i in range(40)] + [(None, "twice " * 25)] * 2 + [(7, f"x {shared}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    assert not any("s0" in r.kept for r in got if r.id is None)  # the row with an id comes first
    assert next(r for r in got if r.id == 7).n_removed == 0
    without = [r.n_removed for r in substring_dedup.remove_repeats(docs.where("doc_id is null")).collect() if r.n_words == 31]
    assert sorted(without) == [0] + [30] * 39
    assert [r.n_removed for r in got if r.n_words == 25] == [24, 24]  # one id and one text: only repeats inside it go


def _norm(x):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", regex.sub("[0-9]", "0", x.lower())).strip(" ")


def _line_groups(rows):
    """Where each normalised line occurs first, and the first occurrence of its group by edit similarity alone, over all pairs."""
    first = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if _norm(x):
                first[_norm(x)] = min(first.get(_norm(x), (i, k)), (i, k))
    names = sorted(first, key=len)
    chars = {c: n for n, c in enumerate(sorted(set("".join(names))))}
    bags = np.zeros((len(names), len(chars)), np.int32)
    for n, x in enumerate(names):
        for c in x:
            bags[n, chars[c]] += 1
    sizes, pairs = bags.sum(1), []
    for n in range(len(names)):
        d = bags[n + 1 :] - bags[n]
        least = np.maximum(np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1))  # no distance is below it
        pairs += [(names[n], names[n + 1 + m]) for m in np.flatnonzero(least * 100 <= 20 * sizes[n + 1 :])]
    db = duckdb.connect()
    db.register("pairs", pa.table({"a": [x for x, _ in pairs], "b": [y for _, y in pairs]}))
    alike = db.execute("select a, b from pairs where levenshtein(a, b) * 100 <= 20 * greatest(length(a), length(b))").fetchall()
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in alike:
        x, y = sorted((find(x), find(y)), key=first.get)
        parent[y] = x
    return first, {x: first[find(x)] for x in names}


def test_lines_found_by_edit_similarity_alone(spark, sf_dir):
    """Nothing goes but what all pairs by edit distance link, and of that 0.9 or more goes; no signature or block decides here."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first, group = _line_groups(rows)
    got = {r.k: set(r.lines) for r in line_dedup.repeated_lines(docs).collect()}
    gone = {(i, k): _norm(x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if k in got.get(i, ())}
    want = {(i, k) for i, t in rows for k, x in enumerate((t or "").split("\n")) if _norm(x) and group[_norm(x)] != (i, k)}
    assert set(gone) <= want
    fuzzy = {at for at in want if at in set(first.values())}  # not the equal of an earlier line
    found = len(fuzzy & set(gone)) / len(fuzzy)
    print(f"of {len(fuzzy)} lines that an earlier one is like {found:.3f} go")
    assert want - fuzzy <= set(gone) and found >= 0.9


def test_lines_with_few_changed_words(spark):
    base = "the quick brown fox jumps over the lazy dog and runs along the river bank until the evening comes again"
    rows = corpus(60, seed=5) + [(300, base + "\nother line"), (301, base + " now\n\n" + base.upper()), (302, "line 12\nline 34\n---"), (303, f"{base[:-6]}\n{base} Straße"), (304, "a b\na c b"), (305, f"{base} {base} x\n{base} {base}")]
    _, group = _line_groups(rows)
    got = {r.id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for i, t in rows:
        all_lines = t.split("\n")
        kept = [x for k, x in enumerate(all_lines) if not _norm(x) or group[_norm(x)] == (i, k)]
        if i >= 300:
            assert (got[i].n_lines, got[i].n_removed, got[i].text) == (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
        assert got[i].n_lines - got[i].n_removed >= len(kept)


def test_repeated_and_null_ids_lose_no_text(spark):
    """Rows of one id and another text, equal rows beside a third document, several null ids."""
    words = lambda seed: " ".join(f"{seed}{k}" for k in range(40))
    same, own, lone, rest = words("s"), words("o"), words("l"), words("r")
    rows = [(3, same), (5, same), (5, own), (5, f"{same}\nshort"), (7, lone), (7, lone), (9, f"{lone} more"), (None, rest), (None, f"{rest}\n{own} end"), (None, "only here " + words("n")), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    every = {w for _, t in rows for w in t.split()}

    kept = [(r.doc_id, r.text) for r in exact_dedup.drop_copies(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, same), (5, own), (5, f"{same}\nshort"), (7, lone), (9, f"{lone} more"), (None, rest), (None, f"{rest}\n{own} end"), (None, "only here " + words("n")), (None, "")], key=str)

    found = {(r.id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect()}
    assert found[5, 36] in ((3, False), (5, True))
    kept = near_dedup.drop_near_copies(docs).collect()
    assert {w for r in kept for w in r.text.split()} >= every - {"more", "short"} and sum(r.doc_id == 7 for r in kept) == 1

    for got in (substring_dedup.remove_repeats(docs).collect(),):
        assert len(got) == len(rows) and {w for r in got for w in r.kept.split()} == every
        assert sum(r.n_removed for r in got if r.id == 7) == 0 and next(r for r in got if r.id == 9).n_removed == 40

    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows) and {w for r in got for w in r.text.split()} >= every - {"more", "end"}
    assert sum(lone in r.text for r in got) == 2  # the rows that share id and text keep what they have


def test_edit_similarity_matches_the_distance(spark):
    r = random.Random(2)
    words = [r.choice(["ab", "abc", "b", "ö", "xyz", "𝒳y"]) for _ in range(40)]
    pairs = []
    for n in range(120):
        a = r.choices(words, k=r.randint(1, 9))
        b = list(a)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = r.choices(words, k=r.randint(0, 1))
        pairs.append((n, n + 1000, " ".join(a), " ".join(b) or "ab"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    frame = spark.createDataFrame(pairs, "a long, b long, ta string, tb string")
    assert {x.a for x in line_dedup.similar(frame).collect()} == {n for n, _, a, b in pairs if distance(a, b) * 100 <= 20 * max(len(a), len(b))}


def test_long_lines_are_compared_by_characters(spark):
    words = [f"word{i:06d}" for i in range(150)]
    edited = [w[:-1] + "x" if i % 2 else w for i, w in enumerate(words)]  # half of the words, a few of 100 characters
    other = [w[:4] + "qqqqqq" if i % 2 else w for i, w in enumerate(words)]
    rows = [(1, 2, " ".join(words), " ".join(edited)), (3, 4, " ".join(words), " ".join(edited[:70] + ["inserted"] + edited[70:])), (5, 6, " ".join(words), " ".join(other))]
    pairs = spark.createDataFrame(rows, "a long, b long, ta string, tb string")
    assert {x.a for x in line_dedup.similar(pairs).collect()} == {1, 3}


def test_ends_over_the_limit_decide_for_lines_of_one_passage(spark):
    """No pair within the limit is told apart by its ends, and lines that share half of their words in one run, and nothing else, are."""
    r = random.Random(11)
    text = lambda n, of="abcdefgh": " ".join("".join(r.choices(of, k=r.randint(2, 8))) for _ in range(n))
    passage, pairs = text(40), []
    for n in range(40):
        pairs.append((n, n + 10_000, f"{text(40, 'abcdefgh')} {passage}", f"{text(r.randint(34, 46), 'ijklmnop')} {passage}"))
        pairs.append((n + 100, n + 10_100, f"{passage} {text(40, 'abcdefgh')}", f"{passage} {text(r.randint(34, 46), 'ijklmnop')}"))
    for n in range(400):
        a = text(r.randint(1, 40), "abü𝒳")
        b = list(a)
        for _ in range(r.randint(0, len(a) // 3)):
            at = r.choice([r.randrange(len(b)), r.randrange(len(b) // 3 + 1)])
            b[at : at + r.randint(0, 1)] = r.choices("abü ", k=r.randint(0, 2))
            b = b or ["a"]
        pairs.append((n + 1000, n + 20_000, a, "".join(b)))
    frame = spark.createDataFrame(pairs, "a long, b long, ta string, tb string").withColumn("most", F.floor(F.greatest(F.length("ta"), F.length("tb")) * 20 / 100).cast("int"))
    rows = frame.select("a", line_dedup.ends_apart("ta", "tb", "most").alias("apart"), F.expr("levenshtein(ta, tb) <= most").alias("alike")).collect()
    assert not any(x.apart and x.alike for x in rows) and sum(x.alike for x in rows) > 100 and any(x.apart for x in rows if x.a >= 1000)
    assert all(x.apart for x in rows if x.a < 1000)
    assert {x.a for x in line_dedup.similar(frame.drop("most")).collect()} == {x.a for x in rows if x.alike}


def test_lines_odd_rows(spark):
    docs = odd_rows(spark)
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == docs.count()
    assert {r.n_lines for r in got if r.id in (1, 2)} == {1}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_and_scattered_edits_share_a_key(spark):
    """Every pair of short lines within the distance, and longer ones that no block of words had in common."""
    r = random.Random(7)
    rows = ["la ja", "la ra", "eding in", "eding enin"]
    for _ in range(60):
        a = "".join(r.choice("abcd ") for _ in range(r.randint(5, 24))).split()
        a = " ".join(a) or "abcde"
        b = list(a)
        for _ in range(r.randint(1, 4)):
            b[r.randrange(len(b)) : r.randrange(len(b)) + r.randint(0, 1)] = r.choice(["", "a", "d"])
        rows += [a, " ".join("".join(b).split()) or "abcd"]
    rows += ["reth the for statre the thingou that nter ershin edshnt onnd", "esedble the for statre the thingou that nter ershin edshnt onnd"]
    _, group = _line_groups(list(enumerate(rows)))
    got = {x.id for x in line_dedup.dedup_lines(frame(spark, list(enumerate(rows)))).collect() if x.n_removed}
    assert got == {i for i, t in enumerate(rows) if group[_norm(t)] != (i, 0)}


def test_line_keys_are_made_once_and_tables_of_marks_go(spark, tmp_path, monkeypatch):
    """The keys of all lines are dealt by one exchange, and when the lines are found the tables of the rounds are off the disk."""
    docs = frame(spark, corpus(60, seed=5))
    distinct = docs.select(F.col("doc_id").alias("k"), line_dedup.normalised(F.col("text")).alias("text"))
    plan = line_dedup.shared(line_dedup.runs(distinct))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate ") == 2 and "Join" not in plan
    found = line_dedup.runs(distinct, None).groupBy("k").count().collect()
    sizes = {r.k: len(r.text.split(" ")) for r in distinct.collect()}
    assert all(r["count"] == (n - 3 if n >= 20 else 2 * n - 5 if n >= 8 else 2 * n - 3) for r in found if (n := sizes[r.k]) >= 3)
    monkeypatch.setattr("mnemora.durable.shared_dir", lambda spark: f"file://{tmp_path}")
    assert line_dedup.repeated_lines(docs).count()
    left = [spark.read.parquet(str(d)).columns for d in tmp_path.glob("mnemora-*")]
    assert left and not [c for c in left if {"mark", "marks", "band"} & set(c)]


def test_tags_of_words_leave_out_no_pair_that_shares_half(spark):
    r = random.Random(3)
    rows = []
    for n in range(300):
        a, b = (set(r.sample(range(40), r.randint(8, 24))) for _ in "ab")
        rows.append((n, (len(a), sorted({x % 16 for x in a})), (len(b), sorted({x % 16 for x in b})), 2 * len(a & b) >= max(len(a), len(b))))
    kind = "struct<n:int,tags:array<smallint>>"
    got = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}, half boolean").withColumn("kept", line_dedup.half(F.col("a"), F.col("b"))).collect()
    assert all(x.kept for x in got if x.half) and sum(x.half for x in got) > 20 and not all(x.kept for x in got)


def test_segments_of_a_batch_take_bounded_memory():
    """Arrays are made for runs of bounded bytes, not for the whole batch."""
    import tracemalloc

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**5)}" for _ in range(1500)) for _ in range(400)]
    run = substring_dedup.segments(Rows())
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], ["k", "text"])
    words._powers.cache_clear()
    tracemalloc.start()
    for _ in run([batch]):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
