"""Source divergence audit: how the words of a source differ from those of its language's other sources.

1. A text's terms are its matches of a pattern, in lower case (A to Z alone). Tasks count by (lang, source, term) how often terms
   occur and how many documents have them, and send sums; these meet by (lang, source, term).
2. A language keeps the terms that enough of its documents have.
3. Groups cross with the kept terms of their language, so that a term that a group lacks is a zero there; each
   gives a smoothed share in billionths.
4. Shares of two groups meet by (lang, term), each pair once since the measure is symmetric, and are summed; shares of a
   group meet those of its language for its terms. Windows rank both.

All arithmetic is of integers: decimals where a product may pass 2**63.

The joins on language alone take the groups (a row for each source) and the languages to the terms: broadcast while their
counted rows are few; beyond that, groups meet terms in salted parts of each language, so that a language with
a third of all terms is no single task. Joins and sums by term have as many keys as there are terms. A frequent term
costs each map task one row.

Defined cases: null text, lang or source count as empty strings; ids play no part, so null and repeated ids are rows
like others; a text without terms gives none, but its group takes part with zeros; a language without kept terms has pairs
of value 0 and no terms; a language of one source has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BYTES, column, column_bytes, cut, small

#: Runs of ASCII letters and of everything beyond ASCII, as bytes of UTF-8.
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, SCALE, TOP_TERMS = 10, 1_000_000_000, 10
HELD = 400_000
SALTS = 64

#: Bytes counted for a row of the groups when a broadcast is decided.
GROUP_BYTES = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", pattern: bytes = TERM) -> DataFrame:
    """``(lang, source, term, n, d)``: occurrences and documents of each term; a row with an empty term stands for each group.

    Tasks match and sum whole texts; what they hold is sent on whenever it has ``HELD`` entries.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    rows = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    names = ["lang", "source", "term", "n", "d"]

    def run(batches):
        match = re.compile(pattern).findall
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent():
            for (of_lang, of_source), (n, d) in held.items():
                terms = list(n)
                columns = [pa.array([of_lang] * len(terms)), pa.array([of_source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([d[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
            held.clear()

        for batch in batches:
            for of_lang, of_source, one in zip(column(batch, "lang").to_pylist(), column(batch, "source").to_pylist(), column_bytes(batch, "text")):
                found = match(one.translate(_LOWER))
                n, d = held.setdefault((of_lang, of_source), (Counter({b"": 1}), Counter({b"": 1})))
                n.update(found)
                d.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from sent()
        yield from sent()

    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """A smoothed share of a total over ``kept`` terms, in billionths and at least 1."""
    wide = lambda x: x.cast("decimal(24,0)")
    product = ((wide(n) + F.lit(2).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", product, (wide(total) + wide(kept) * F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")) + F.lit(1)


def divergence(p: Column, q: Column) -> Column:
    """Squared difference over the sum; shares are at most a billion and one, so squares stay below 2**63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _densified(groups: DataFrame, kept: DataFrame, n_groups: int) -> DataFrame:
    """Every group with every kept term of its language."""
    if n_groups * GROUP_BYTES <= SMALL_BYTES:
        return kept.join(small(groups, n_groups, GROUP_BYTES), "lang")
    spread = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(spread, ["lang", "salt"]).drop("salt")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, pattern: bytes = TERM) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair``: every other source of the language with the divergence of the two summed over the kept terms.
    Part ``term``: the ``top_terms`` terms that the source has more of than its language, by divergence.
    """
    counts = cut(term_counts(docs, text_col, lang_col, source_col, pattern))
    in_group = counts.where("term = ''").select("lang", "source")
    terms = counts.where("term <> ''")
    kept = cut(terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("docs")).where(F.col("docs") >= least_documents).select("lang", "term", "lang_n"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))

    own = terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(in_group.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), "lang_total"))
    n_groups = groups.count()

    dense = _densified(groups.select("lang", "source", "total", "v"), kept.select("lang", "term"), n_groups)
    shares = dense.join(own.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").select(
        "lang", "term", "source", share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("v")).alias("p")
    )
    shares = cut(shares)
    other = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"))
    half = shares.join(other, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("value"))
    both = half.unionByName(half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    # groups of a language without kept terms meet nothing above: their pairs are zeros
    bare = groups.where("v = 0").select("lang", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "other"), "lang").where("source <> other").withColumn("value", F.lit(0).cast("long"))
    pairs = both.unionByName(zeros).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")

    spoken = own.join(small(groups.where("v > 0"), n_groups, GROUP_BYTES), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")
    )
    distinct = spoken.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda rows: rows.withColumn("rank", F.expr("row_number() over (partition by lang, source, part order by value desc, item)"))
    return ranked(pairs).unionByName(ranked(distinct).where(F.col("rank") <= top_terms))


#: The audit as SQL.
SQL = r"""
    WITH t AS (SELECT rowid_ AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
               FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
    k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
    kl AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
    g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
    s AS (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (gt.total + 2 * kl.v) AS p,
          1 + (1000000000 * (k.n + 2)::HUGEINT) // (kl.total + 2 * kl.v) AS q
          FROM gt JOIN kl USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM s WHERE n > 0 AND p > q),
    w AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM o)
    SELECT * FROM w WHERE part = 'pair' OR rank <= 10
"""
