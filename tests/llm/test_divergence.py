import re
from collections import Counter, defaultdict

import duckdb

from mnemora.llm import divergence

from .data import corpus


def plain(rows, least=10, top=10):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        found = re.findall("[A-Za-z\x80-\U0010ffff]+", (text or "").translate(low))
        groups.add((lang or "", source or ""))
        n[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        own = [g for g in groups if g[0] == lang]
        whole = sum((n[g] for g in own), Counter())
        share = lambda c: (lambda total: {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {g: share(n[g]) for g in own}, share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for g in own:
            pairs = [(h[1], sum(f(p[g][t], p[h][t]) for t in kept)) for h in own if h != g]
            terms = [(t, f(p[g][t], q[t])) for t in kept if n[g][t] and p[g][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(*g, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


SCHEMA = "doc_id long, lang string, source string, text string, term string, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", 7) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [(("en", "de", None)[i % 3], ("a", "b", "c", None)[i // 3 % 4], t) for i, (_, t) in enumerate(corpus(150))]
ROWS += [("fr", "a", "Ünï ÜNÏ Aa-bB_cC1dd"), ("fr", "b", None), ("fr", "c", ""), ("xx", "only", "word " * 30_000), ("en", "z", "123 ..."), ("en", "a", "x\x00y")]


def test_divergence_is_the_plain_one(spark):
    assert rows_of(divergence.audit(table(spark, ROWS))) == plain(ROWS)
    assert rows_of(divergence.audit(table(spark, ROWS), least_documents=1, top_terms=3)) == plain(ROWS, 1, 3)


def test_divergence_groups_that_are_not_broadcast(spark, monkeypatch):
    """Beyond the bound of a broadcast, groups meet terms in salted parts."""
    monkeypatch.setattr(divergence, "GROUP_BYTES", 1 << 30)
    assert rows_of(divergence.audit(table(spark, ROWS))) == plain(ROWS)


def test_divergence_is_its_sql(spark):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, lang varchar, source varchar, text varchar)")
    rows = [r for r in ROWS if "\x00" not in (r[2] or "")]
    c.executemany("insert into documents values (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    want = c.execute(f"select lang, source, part, item, value, rank from ({divergence.SQL})").fetchall()
    assert rows_of(divergence.audit(table(spark, rows))) == sorted(want)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(table(spark, ROWS).limit(0)).count() == 0
