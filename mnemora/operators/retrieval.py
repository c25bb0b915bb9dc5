"""Ranked retrieval: BM25 over terms, cosine over vectors, fusion of rankings, mapping of hits to rows.

Corpus statistics are aggregates; a query's terms are few, so postings are filtered to them before any
count, and only (document, term) pairs that match are shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.durable import cut
from mnemora.functions.columns import cosine, norm_path

K1, B, RRF_K = 1.2, 0.75, 60


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(docs: DataFrame, words: list[str], key: str = "doc_id", text: str = "text", prefix: bool = True, phrases: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> DataFrame:
    """``(key, score)`` of documents that have every word (or one that begins with it), every phrase and none of the excluded.

    Texts are cut into words once: lengths and counts of the few words asked for are written, and both the statistics and the scores read those.
    """
    tokens = docs.select(key, F.lower(F.col(text)).alias("__low"), terms(F.col(text)).alias("__t"))
    count = lambda w: F.size(F.filter("__t", lambda t: t.startswith(w) if prefix else t == w))
    kept = [F.col("__low").contains(p.lower()) for p in phrases] + [~F.col("__low").contains(w.lower()) for w in excluded]
    counted = cut(tokens.select(key, F.size("__t").alias("dl"), reduce(lambda a, b: a & b, kept, F.lit(True)).alias("kept"), *[count(w).alias(f"tf{i}") for i, w in enumerate(words)]))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(words))])
    hit = counted.where(reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(words))], F.col("kept"))).crossJoin(F.broadcast(stats))  # one row of statistics
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.select(key, reduce(lambda a, b: a + b, map(part, range(len(words)))).alias("score"))


def nearest(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, score)`` with score 1 / (1 + cosine distance) to one query vector."""
    at = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, (1 / (2 - cosine(F.col(vector), at))).alias("score"))


def top(scored: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """The best ``k`` with their 0-based rank and the list's name."""
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1).cast("long")).withColumn("list", F.lit(name))


def fuse(lists: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``(key, rank, list)`` with a bonus for the first ranks of any list."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("list") == name, F.lit(float(w))).otherwise(weight)
    summed = lists.groupBy(key).agg(F.sum(weight / (RRF_K + 1 + F.col("rank"))).alias("rrf"), F.min("rank").alias("best"))
    return summed.withColumn("score", F.col("rrf") + F.when(F.col("best") == 0, 0.05).when(F.col("best") <= 2, 0.02).otherwise(0.0))


def blend(fused: DataFrame, rerank: Column) -> Column:
    """Fusion and reranker scores by the fused rank (from 1): 75, 60 or 40 % fusion."""
    share = F.when(F.col("rank") <= 3, 0.75).when(F.col("rank") <= 10, 0.6).otherwise(0.4)
    return F.when(rerank.isNull(), F.col("score")).otherwise(share * F.col("score") + (1 - share) * rerank)


#: Fixed value: how many of the best a reranker gets.
CANDIDATES = 30


def candidates(scored: DataFrame, key: str, n: int = CANDIDATES) -> DataFrame:
    """The best by score, which a reranker is to judge."""
    return scored.orderBy(F.desc("score"), key).limit(n)


def one_per_document(hits: DataFrame, document: str, tie: str = "uuid") -> DataFrame:
    """The best-ranked hit of each document, of equal ranks the least ``tie``."""
    own = Window.partitionBy(document).orderBy("rank", tie)
    return hits.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def sections(hits: DataFrame, anchors: DataFrame, parts: int | None = None) -> DataFrame:
    """As-of: for hits ``(doc, line)`` the last of ``anchors (doc, anchor_line, uuid)`` at or before the line, else the first.

    Both sides meet in one sort by (document, line), in ``parts`` tasks where they are stated; there is no range join.
    """
    both = anchors.select("doc", F.col("anchor_line").alias("line"), F.lit(0).alias("kind"), "uuid").unionByName(hits.withColumn("kind", F.lit(1)).withColumn("uuid", F.lit(None).cast("string")), allowMissingColumns=True)
    both = both.repartition(parts, "doc") if parts else both
    upto = Window.partitionBy("doc").orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("doc").orderBy("line", "kind").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("section", F.coalesce(F.last("uuid", ignorenulls=True).over(upto), F.first("uuid", ignorenulls=True).over(after)))
    return found.where("kind = 1").drop("kind", "uuid")


def evaluate(ranked: DataFrame, relevant: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Precision at k, recall, reciprocal rank and F1 for each query of ``relevant``."""
    hits = ranked.where(F.col("rank") < k).join(relevant.withColumn("__rel", F.lit(1)), [query, key], "left")
    found = hits.groupBy(query).agg(F.count("__rel").alias("hits"), (1 / (F.min(F.when(F.col("__rel") == 1, F.col("rank"))) + 1)).alias("rr"))
    wanted = relevant.groupBy(query).agg(F.count(F.lit(1)).alias("wanted"))
    scored = wanted.join(found, query, "left").select(query, F.coalesce("hits", F.lit(0)).alias("hits"), "wanted", F.coalesce("rr", F.lit(0.0)).alias("rr"))
    p, r = F.col("hits") / k, F.col("hits") / F.col("wanted")
    return scored.select(query, p.alias("precision"), r.alias("recall"), "rr", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


# ---- the syntax of a query's text

#: Words and phrases of a query: a minus excludes, quotes hold a phrase.
_TOKEN = r'(-?"[^"]*"?|[^\s"]+)'


def lex_tokens(text: Column) -> Column:
    """The tokens of a query, quotes and minus signs kept."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))


def has_lex_syntax(text: Column) -> Column:
    """Whether any token is a phrase or excluded."""
    return F.exists(lex_tokens(text), lambda x: x.startswith('"') | x.startswith("-"))


def plain_words(text: Column) -> Column:
    """A query for vectors: without what it excludes and without quotes."""
    kept = F.filter(lex_tokens(text), lambda x: ~x.startswith("-"))
    return F.array_join(F.filter(F.transform(kept, lambda x: F.replace(x, F.lit('"'), F.lit(""))), lambda x: x != ""), " ")


def query_document(text: Column) -> Column:
    """What both kinds of search get: the text itself, or where it has syntax a ``lex:`` line of it and a ``vec:`` line of its plain words."""
    plain = plain_words(text)
    typed = F.concat(F.lit("lex: "), F.trim(text), F.when(plain != "", F.concat(F.lit("\nvec: "), plain)).otherwise(F.lit("")))
    return F.when(has_lex_syntax(text), typed).otherwise(text)


def parsed_lex(text: str) -> tuple[list[str], tuple[str, ...], tuple[str, ...]]:
    """Words (each the beginning of one), phrases and exclusions of a query's text, in lower case."""
    words, phrases, excluded = [], [], []
    for token in re.findall(_TOKEN, text):
        plain = token.lstrip("-").replace('"', "").lower()
        if plain:
            (excluded if token.startswith("-") else phrases if token.startswith('"') else words).append(plain)
    return words, tuple(phrases), tuple(excluded)


def lexical(docs: DataFrame, text: str, key: str = "doc_id", body: str = "text") -> DataFrame:
    """``(key, score)`` by BM25 of the documents that a query's text finds: every word by its beginning, every phrase, nothing excluded."""
    words, phrases, excluded = parsed_lex(text)
    scored = words + [w for p in phrases for w in re.findall(r"\w+", p)]
    if not scored:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    return bm25(docs, list(dict.fromkeys(scored)), key, body, prefix=True, phrases=phrases, excluded=excluded)


# ---- hits and the rows they stand for


def match_line(snippet: Column) -> Column:
    """The line that a hit matched, from the head ``@@ -N,M @@ (B before`` of its snippet: N + B; null without one."""
    first = F.regexp_extract(snippet, r"@@ -(\d+)", 1)
    before = F.regexp_extract(snippet, r"(\d+) before", 1)
    return F.when(first != "", first.cast("long") + F.coalesce(F.nullif(before, F.lit("")).cast("long"), F.lit(0)))


def anchors_of(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``(doc, anchor_line, uuid)``: the lines, from 1, of rendered documents that open a section."""
    each = documents.select(F.col(path).alias("doc"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    found = each.select("doc", (F.col("n") + 1).cast("long").alias("anchor_line"), F.regexp_extract("line", r'data-section-uuid="([^"]*)"', 1).alias("uuid"))
    return found.where("uuid <> ''")


def rows_of_hits(hits: DataFrame, rows: DataFrame, anchors: DataFrame, parts: int | None = None) -> DataFrame:
    """``(hit, uuid)`` of hits ``(hit, path, snippet)``: the row of the section that the matched line is in, else every row of the document.

    Paths meet in their normal form. Hits of documents that ``rows (uuid, path)`` lacks have no rows: see ``orphans``.
    ``parts``: how many tasks deal the rows; Spark alone goes by bytes, which are few for paths and ids that compress well.
    """
    dealt = lambda df, key: df.repartition(parts, key) if parts else df
    at = hits.select("hit", norm_path(F.col("path")).alias("doc"), match_line(F.col("snippet")).alias("line"))
    where = anchors.select(norm_path(F.col("doc")).alias("doc"), "anchor_line", "uuid")
    own = rows.select(norm_path(F.col("path")).alias("doc"), "uuid")
    placed = sections(at.where("line is not null"), where, parts).where("section is not null").select("hit", F.col("section").alias("uuid"))
    pinned = dealt(placed, "uuid").join(dealt(own.select("uuid"), "uuid"), "uuid", "left_semi")
    rest = dealt(dealt(at, "hit").join(dealt(pinned.select("hit"), "hit"), "hit", "left_anti"), "doc").join(dealt(own, "doc"), "doc").select("hit", "uuid")
    return pinned.select("hit", "uuid").unionByName(rest)


def orphans(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits whose document has no rows."""
    known = rows.select(norm_path(F.col("path")).alias("__doc")).distinct()
    return hits.withColumn("__doc", norm_path(F.col("path"))).join(known, "__doc", "left_anti").drop("__doc")


def hits_of_row(hits: DataFrame, rows: DataFrame, anchors: DataFrame, uuid: str, mapped: DataFrame | None = None) -> DataFrame:
    """The hits that stand for one row; ``mapped`` is what ``rows_of_hits`` gave, where that is there already."""
    mapped = rows_of_hits(hits, rows, anchors) if mapped is None else mapped
    return hits.join(mapped.where(F.col("uuid") == uuid).select("hit"), "hit", "left_semi")


# ---- chunks

#: Characters of a token, a chunk's tokens, the window before its end in which a break is looked for, the share that chunks overlap.
TOKEN_CHARS, CHUNK_TOKENS, WINDOW_TOKENS, OVERLAP = 4, 900, 200, 0.15
#: How much a place counts as a break, by the line that begins there.
BREAKS = ((r"# ", 100), (r"## ", 90), (r"### ", 80), (r"```", 80), (r"#### ", 70), (r"##### ", 60), (r"(?:---|\*\*\*)\s*$", 60), (r"###### ", 50), (r"\s*$", 20), (r"(?:[-*] |\d+\. )", 5), (r"", 1))


def break_points(text: str) -> list[tuple[int, int]]:
    """``(place, score)`` of every line's beginning outside of fenced blocks."""
    out, at, fenced = [], 0, False
    for line in text.split("\n"):
        fence = line.startswith("```")
        if at and (not fenced or fence):
            out.append((at, next(score for pattern, score in BREAKS if re.match(pattern, line)) if not (fence and fenced) else 1))
        fenced ^= fence
        at += len(line) + 1
    return out


def chunk_spans(text: str, size: int = CHUNK_TOKENS * TOKEN_CHARS, window: int = WINDOW_TOKENS * TOKEN_CHARS, overlap: float = OVERLAP) -> list[tuple[int, int]]:
    """``(begin, end)`` of a text's chunks: each ends at the best break of the window before its size, a break's score falling with the square of its distance.

    Where the window has no break, the cut is at the size, or after the fenced block that it would cut. The next chunk begins ``overlap`` of the size before the end.
    """
    points = break_points(text)
    places = [p for p, _ in points]
    fences = [m.start() for m in re.finditer(r"(?m)^```", text)]
    spans, begin = [], 0
    while True:
        goal = begin + size
        if goal >= len(text):
            return [*spans, (begin, len(text))] if len(text) > begin else spans
        near = points[bisect_right(places, max(begin, goal - window)) : bisect_right(places, goal)]
        if near:
            end = max(near, key=lambda x: (x[1] * (1 - ((goal - x[0]) / window) ** 2 * 0.7), x[0]))[0]
        else:
            inside = bisect_right(fences, goal)
            after = text.find("\n", fences[inside]) if inside % 2 and inside < len(fences) else -1
            end = after + 1 if 0 < after + 1 <= goal + size else goal  # a block that is longer than a chunk is cut
        spans.append((begin, end))
        begin = max(begin + 1, end - int(size * overlap))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS * TOKEN_CHARS, window: int = WINDOW_TOKENS * TOKEN_CHARS, overlap: float = OVERLAP) -> DataFrame:
    """``(key, seq, pos, text)``: overlapping pieces of every text for retrieval, cut at headings, paragraphs and lines; ``pos`` in characters from 0."""

    def run(batches):
        for batch in batches:
            rows = [(k, n, a, whole[a:b]) for k, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, (a, b) in enumerate(chunk_spans(whole or "", size, window, overlap))]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [key, "seq", "pos", "text"])

    chosen = docs.select(F.col(key), F.col(text).cast("string"))
    return chosen.mapInArrow(run, f"{key} {chosen.schema[0].dataType.simpleString()}, seq int, pos long, text string")
