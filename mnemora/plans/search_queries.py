"""Queries of the search family: filters, projections, orders, limits, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.functions import columns as C
from mnemora.operators import grid, retrieval
from mnemora.operators.search import Filters, channels_to_read, matching, ranked, search
from mnemora.plans.registry import query
from mnemora.plans.views import GRID_SQL, REVIEW_SQL, chat_grid, review_grid
from mnemora.sources.readers import chosen

SHOWN = ["uuid", "kind", "when_ts_utc", "author", "message_index", "text"]


def _grid(where: str, columns: str = ", ".join(SHOWN), rest: str = "") -> str:
    return f"WITH {GRID_SQL} SELECT {columns} FROM grid WHERE {where} {rest}"


_CHATS = "kind IN ('Chat', 'Slack Thread')"


@query(_grid(f"kind = 'User Input' AND when_ts_utc > TIMESTAMP '2024-01-05' AND NOT {_CHATS} AND contains(lower(text), 'th')", rest="ORDER BY when_ts_utc NULLS FIRST, 1 LIMIT 200"))
def q_search(t):
    return search(chat_grid(t), Filters(text="th", equal=[("kind", "User Input")], after="2024-01-05")).select(*SHOWN)


@query(_grid(f"{_CHATS}"))
def f_kind_class_chat(t):
    return matching(chat_grid(t), Filters(rows="chat")).select(*SHOWN)


@query(_grid(f"NOT {_CHATS}"))
def f_kind_class_message(t):
    return matching(chat_grid(t), Filters(rows="message")).select(*SHOWN)


@query(_grid("author = 'user'"))
def f_eq(t):
    return matching(chat_grid(t), Filters(equal=[("author", "user")])).select(*SHOWN)


@query(_grid("author = 'user' AND author = 'assistant'"))
def f_eq_zoom(t):
    return matching(chat_grid(t), Filters(equal=[("author", "user"), ("author", "assistant")])).select(*SHOWN)


@query(_grid("(author IS NULL OR author <> 'user')"))
def f_ne_keepnull(t):
    return matching(chat_grid(t), Filters(unequal=[("author", "user")])).select(*SHOWN)


@query(_grid("true"))
def f_ignored_fields(t):
    return matching(chat_grid(t), Filters(equal=[("subj", "x"), ("other", "y")], before="not a time")).select(*SHOWN)


@query(_grid("when_ts_utc < TIMESTAMP '2024-01-15' AND when_ts_utc > TIMESTAMP '2024-01-03 12:00:00'"))
def f_time_range(t):
    return matching(chat_grid(t), Filters(before="2024-01-15", after="2024-01-03T12:00:00")).select(*SHOWN)


@query(_grid("when_ts_utc > TIMESTAMP '2024-01-04 23:00:00' AND when_ts_utc < TIMESTAMP '2024-01-10 10:30:00'"))
def f_time_normalize(t):
    return matching(chat_grid(t), Filters(after="2024-01-05", before="2024-01-10T12:30:00+02:00", zone="Europe/Berlin")).select(*SHOWN)


@query(_grid("contains(lower(text), 'then')"))
def f_like(t):
    return matching(chat_grid(t), Filters(text="Then", rows="all")).select(*SHOWN)


@query(
    "SELECT doc_id, CASE WHEN regexp_matches(v, '(^|-)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') THEN right(v, 36) ELSE v END AS value FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'slug-' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) ELSE 'plain-' || doc_id END AS v FROM (SELECT doc_id, md5(text) AS h FROM documents))"
)
def q_uuid_suffix(t):
    h = F.md5("text")
    part = lambda a, n: F.substring(h, a, n)
    value = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("-", F.lit("slug"), part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))).otherwise(F.concat(F.lit("plain-"), F.col("doc_id").cast("string")))
    return t.documents.select("doc_id", C.uuid_suffix(value).alias("value"))


@query(
    f"WITH {GRID_SQL} SELECT uuid, coalesce(kind, '') AS kind, coalesce(author, '') AS author, when_ts_utc, message_index, coalesce(conversation_uuid, '') AS conversation_uuid, markdown_uuid, coalesce(text, '') AS text FROM grid"
)
def p_search_cols(t):
    g = chat_grid(t)
    return g.select("uuid", *[F.coalesce(c, F.lit("")).alias(c) for c in ("kind", "author", "conversation_uuid", "text")], "when_ts_utc", "message_index", "markdown_uuid")


_SNIPPET = """
SELECT doc_id, replace(CASE WHEN p = 0 THEN CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '…' ELSE text END
  ELSE CASE WHEN s > 1 THEN '…' ELSE '' END || substr(text, s, p + 4 + 120 - s) || CASE WHEN p + 4 + 120 <= length(text) THEN '…' ELSE '' END END, chr(10), ' ') AS snippet
FROM (SELECT *, greatest(p - 121, 1) AS s FROM (SELECT doc_id, text, instr(lower(text), 'then') AS p FROM documents))
"""


@query(_SNIPPET)
def p_snippet(t):
    return t.documents.select("doc_id", C.snippet(F.col("text"), "then").alias("snippet"))


@query("SELECT DISTINCT o.o_orderkey, o.o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def f_label_any(t):
    marked = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(marked, "o_orderkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 3 = 0 OR c_acctbal >= 0)")
def f_fringe_provider(t):
    k = F.col("c_custkey")
    channels = t.customer.select("c_custkey", "c_name", (k % 2 == 0).alias("is_member"), F.when(k % 3 != 0, F.col("c_acctbal") < 0).alias("is_archived"))
    return channels_to_read(channels).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def f_glob(t):
    return t.orders.select(*chosen(t.orders.columns, ["o_*key", "o_orderd*", "o_total*"], ["*price"]))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic = 1 OR (d.text IS NULL AND coalesce(l.quality, 0) > 0)")
def f_retry_failed(t):
    return t.documents.join(t.labels, "doc_id", "left").where((F.col("toxic") == 1) | (F.col("text").isNull() & (F.coalesce("quality", F.lit(0)) > 0))).select("doc_id")


@query(_grid("true", rest="ORDER BY when_ts_utc ASC NULLS FIRST, CASE WHEN kind IN ('Chat', 'Slack Thread') THEN 0 ELSE 1 END, uuid LIMIT 50"))
def s_grid_order(t):
    return search(chat_grid(t), Filters(rows="all"), 50).select(*SHOWN)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100")
def s_docs_newest(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(100)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def s_jobs(t):
    return t.orders.where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query(
    f"WITH {GRID_SQL} SELECT markdown_uuid, uuid, kind FROM (SELECT *, row_number() OVER (PARTITION BY markdown_uuid ORDER BY CASE WHEN kind = 'Chat' THEN 0 ELSE 1 END, when_ts_utc NULLS LAST, uuid) AS n FROM grid) WHERE n = 1"
)
def s_chat_meta(t):
    return grid.canonical(chat_grid(t)).select("markdown_uuid", "uuid", "kind")


@query(
    "SELECT loc, n FROM (SELECT p_size::VARCHAR || CASE WHEN p_partkey % 5 = 0 THEN 'a' ELSE '' END AS loc, count(*) AS n FROM part GROUP BY 1) ORDER BY try_cast(loc AS BIGINT) ASC NULLS LAST, loc LIMIT 40"
)
def s_numeric_locator(t):
    loc = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 5 == 0, "a").otherwise(""))
    counted = t.part.groupBy(loc.alias("loc")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.expr("try_cast(loc AS bigint)").asc_nulls_last(), "loc").limit(40)


@query(f"WITH {GRID_SQL} SELECT conversation_uuid, string_agg(uuid, ',' ORDER BY when_ts_utc, uuid) AS uuids FROM grid WHERE kind <> 'Chat' GROUP BY 1")
def s_thread_order(t):
    return chat_grid(t).where("kind <> 'Chat'").groupBy("conversation_uuid").agg(grid.ordered_text(F.col("uuid"), F.struct("when_ts_utc", "uuid"), delimiter=",").alias("uuids"))


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_BM25 = f"""
tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
cnt AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda w: starts_with(w, 'the'))) AS f0, len(list_filter(t, lambda w: starts_with(w, 'tion'))) AS f1 FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM cnt),
bm AS (SELECT doc_id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score
  FROM cnt, st WHERE f0 > 0 AND f1 > 0)
"""


@query(f"WITH {_BM25} SELECT doc_id, round(0.1 * (doc_id % 11) * 0.5 + 0.5 * score, 6) AS score FROM (SELECT * FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 30)")
def s_topk_rerank(t):
    best = retrieval.candidates(retrieval.bm25(t.documents, ["the", "tion"]).withColumn("score", F.round("score", 9)), "doc_id")
    return best.select("doc_id", F.round(0.1 * (F.col("doc_id") % 11) * 0.5 + 0.5 * F.col("score"), 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def r_bm25(t):
    return retrieval.bm25(t.documents, ["the", "tion"]).select("doc_id", F.round("score", 6).alias("score"))


_SYNTAX = f"""
tok AS (SELECT doc_id, lower(text) AS low, {_TOKENS} AS t FROM documents),
cnt AS (SELECT doc_id, low, len(t) AS dl, len(list_filter(t, lambda w: starts_with(w, 'thor'))) AS f0, len(list_filter(t, lambda w: starts_with(w, 'of'))) AS f1, len(list_filter(t, lambda w: starts_with(w, 'the'))) AS f2 FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM cnt)
"""
_PART = "ln(1 + (n - d{0} + 0.5) / (d{0} + 0.5)) * f{0} * 2.2 / (f{0} + 1.2 * (0.25 + 0.75 * dl / avgdl))"


@query(f"WITH {_SYNTAX} SELECT doc_id, round({_PART.format(0)} + {_PART.format(1)} + {_PART.format(2)}, 6) AS score FROM cnt, st WHERE f0 > 0 AND f1 > 0 AND f2 > 0 AND contains(low, 'of the') AND NOT contains(low, 'license')")
def r_bm25_syntax(t):
    return retrieval.lexical(t.documents, 'thor "of the" -license').select("doc_id", F.round("score", 6).alias("score"))


_PROBE = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _first_vector(t):
    return t.embeddings.where("vec_id = 0").first()["embedding"]  # the query's own vector


@query(f"SELECT vec_id, round(1 / (2 - list_cosine_similarity(embedding::DOUBLE[], {_PROBE})), 6) AS score FROM embeddings")
def r_vec(t):
    return retrieval.nearest(t.embeddings, _first_vector(t)).select("vec_id", F.round("score", 6).alias("score"))


_LISTS = f"""
lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank, 'lex' AS list FROM bm ORDER BY score DESC, doc_id LIMIT 50),
vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank, 'vec' AS list FROM (SELECT vec_id, 1 / (2 - list_cosine_similarity(embedding::DOUBLE[], {_PROBE})) AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 50),
both_lists AS (SELECT * FROM lex UNION ALL SELECT * FROM vec),
fused AS (SELECT doc_id, sum(CASE list WHEN 'lex' THEN 2.0 ELSE 1.0 END / (61.0 + rank)) AS rrf, min(rank) AS best FROM both_lists GROUP BY doc_id)
"""


def _lists(t):
    lex = retrieval.top(retrieval.bm25(t.documents, ["the", "tion"]), "doc_id", 50, "lex")
    near = retrieval.nearest(t.embeddings, _first_vector(t)).withColumnRenamed("vec_id", "doc_id")
    return lex.unionByName(retrieval.top(near, "doc_id", 50, "vec"))


@query(f"WITH {_BM25}, {_LISTS} SELECT doc_id, rank::BIGINT AS rank, list FROM both_lists")
def w_rrf_rank(t):
    return _lists(t).select("doc_id", "rank", "list")


@query(f"WITH {_BM25}, {_LISTS} SELECT doc_id, round(rrf, 6) AS rrf FROM fused")
def r_rrf(t):
    return retrieval.fuse(_lists(t), "doc_id", {"lex": 2.0}).select("doc_id", F.round("rrf", 6).alias("rrf"))


@query(f"WITH {_BM25}, {_LISTS} SELECT doc_id, round(rrf + CASE WHEN best = 0 THEN 0.05 WHEN best <= 2 THEN 0.02 ELSE 0 END, 6) AS score FROM fused")
def r_bonus(t):
    return retrieval.fuse(_lists(t), "doc_id", {"lex": 2.0}).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"WITH {_BM25}, {_LISTS}, b AS (SELECT doc_id, rrf + CASE WHEN best = 0 THEN 0.05 WHEN best <= 2 THEN 0.02 ELSE 0 END AS score FROM fused), r AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) "
    "SELECT doc_id, round(CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END * score + CASE WHEN rank <= 3 THEN 0.25 WHEN rank <= 10 THEN 0.4 ELSE 0.6 END * ((doc_id % 11) / 10.0), 6) AS score FROM r"
)
def r_blend(t):
    fused = retrieval.fuse(_lists(t), "doc_id", {"lex": 2.0})
    placed = fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "doc_id")))  # two lists of 50 at most
    return placed.select("doc_id", F.round(retrieval.blend(placed, (F.col("doc_id") % 11) / 10), 6).alias("score"))


@query(f"WITH {REVIEW_SQL}, h AS (SELECT uuid, conversation_uuid AS doc, (message_index * 7919 + length(author)) % 101 AS rank FROM reviews WHERE kind = 'PR Comment') SELECT doc, uuid, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY rank, uuid) AS n FROM h) WHERE n = 1")
def w_one_per_doc(t):
    hits = review_grid(t).where("kind = 'PR Comment'").select("uuid", F.col("conversation_uuid").alias("doc"), ((F.col("message_index") * 7919 + F.length("author")) % 101).alias("rank"))
    return retrieval.one_per_document(hits, "doc").select("doc", "uuid", "rank")


@query(
    f"WITH {GRID_SQL}, hits AS (SELECT uuid, min(r) AS rank FROM (SELECT 'conv-' || conv_id || '-' || turn AS uuid, (conv_id * 7 + turn) % 101 AS r FROM conversations UNION ALL SELECT 'conv-' || conv_id || '-' || turn, (conv_id * 3 + turn) % 101 FROM conversations) GROUP BY uuid) SELECT uuid, rank::BIGINT AS rank FROM grid JOIN hits USING (uuid) WHERE kind = 'User Input' ORDER BY rank, uuid LIMIT 25"
)
def j_uuid_rank(t):
    key = F.concat_ws("-", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid")
    hit = lambda k: t.conversations.select(key, ((F.col("conv_id") * k + F.col("turn")) % 101).cast("long").alias("rank"), F.lit(1.0).alias("score"))
    return ranked(chat_grid(t), hit(7).unionByName(hit(3)), Filters(equal=[("kind", "User Input")]), 25).select("uuid", "rank")


@query(f"WITH hits AS (SELECT 'conv-' || conv_id || '-' || turn AS uuid, (conv_id * 7 + turn) % 101 AS r FROM conversations UNION ALL SELECT 'conv-' || conv_id || '-' || turn, (conv_id * 3 + turn) % 101 FROM conversations) SELECT uuid, min(r)::BIGINT AS rank FROM hits GROUP BY uuid")
def w_dedupe_rank(t):
    key = F.concat_ws("-", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid")
    hit = lambda k: t.conversations.select(key, ((F.col("conv_id") * k + F.col("turn")) % 101).cast("long").alias("rank"))
    return hit(7).unionByName(hit(3)).groupBy("uuid").agg(F.min("rank").alias("rank"))


_NORM = "regexp_replace(lower({}), '[_-]+', '-', 'g')"


@query(f"SELECT a.page_id, count(*) AS n FROM (SELECT page_id, {_NORM.format('url')} AS p FROM pages) a JOIN (SELECT {_NORM.format('replace(url, chr(45), chr(95))')} AS p FROM pages) b USING (p) GROUP BY 1")
def j_hit_path(t):
    a = t.pages.select("page_id", C.norm_path(F.col("url")).alias("p"))
    b = t.pages.select(C.norm_path(F.replace("url", F.lit("-"), F.lit("_"))).alias("p"))
    return a.join(b, "p").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    WITH a AS (SELECT o_custkey AS doc, (o_orderkey % 1000) AS line, min('s' || o_orderkey) AS uuid FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2),
    h AS (SELECT o_custkey AS doc, o_orderkey % 1000 AS line, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT h.doc, h.line, h.o_orderkey, coalesce((SELECT max_by(a.uuid, a.line) FROM a WHERE a.doc = h.doc AND a.line <= h.line), (SELECT min_by(a.uuid, a.line) FROM a WHERE a.doc = h.doc)) AS section FROM h
    """
)
def j_asof_section(t):
    keyed = t.orders.select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 1000).alias("line"), "o_orderkey")
    anchors = keyed.where("o_orderkey % 3 = 0").groupBy("doc", F.col("line").alias("anchor_line")).agg(F.min(F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))).alias("uuid"))
    return retrieval.sections(keyed.where("o_orderkey % 3 <> 0"), anchors).select("doc", "line", "o_orderkey", "section")


@query(
    """
    WITH rel AS (SELECT label AS q, vec_id FROM embeddings WHERE vec_id % 2 = 0),
    rk AS (SELECT label AS q, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id * 7919 % 101, vec_id) - 1 AS rank FROM embeddings),
    hit AS (SELECT rk.q, count(rel.vec_id) AS hits, 1.0 / (min(CASE WHEN rel.vec_id IS NOT NULL THEN rank END) + 1) AS rr FROM rk LEFT JOIN rel USING (q, vec_id) WHERE rank < 10 GROUP BY rk.q),
    w AS (SELECT q, count(*) AS wanted FROM rel GROUP BY q)
    SELECT q, round(coalesce(hits, 0) / 10.0, 6) AS precision, round(coalesce(hits, 0) / wanted::DOUBLE, 6) AS recall, round(coalesce(rr, 0), 6) AS rr,
      round(CASE WHEN coalesce(hits, 0) > 0 THEN 2 * (hits / 10.0) * (hits / wanted::DOUBLE) / (hits / 10.0 + hits / wanted::DOUBLE) ELSE 0 END, 6) AS f1 FROM w LEFT JOIN hit USING (q)
    """
)
def r_eval(t):
    e = t.embeddings.select(F.col("label").alias("q"), "vec_id")
    ranks = e.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("vec_id") * 7919 % 101, "vec_id")) - 1)
    scored = retrieval.evaluate(ranks, e.where("vec_id % 2 = 0"), "q", "vec_id", 10)
    return scored.select("q", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "rr", "f1")])
