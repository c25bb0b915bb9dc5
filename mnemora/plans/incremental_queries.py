"""Queries of payloads, fingerprints, scopes, and of what maps a query's text and its hits to rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.durable import cut
from mnemora.operators import files as fs
from mnemora.operators import payloads, retrieval, scope
from mnemora.operators.search import DEFAULT_LIMIT, FIELDS, MOST_ROWS, Filters, default_order, filled_manifest, hit_limit, matching, routed
from mnemora.plans.registry import query
from mnemora.plans.views import GRID_SQL, ORDERS_SQL, chat_grid, dealt, new_orders, old_orders, tasks

# ---- payloads


def _payload():
    topic = F.struct("c_nationkey", F.struct(F.col("c_acctbal").cast("long").alias("last_set"), F.lit("").alias("value")).alias("topic"), F.col("c_custkey").alias("updated"), F.lit(None).cast("string").alias("parent"))
    return F.to_json(topic, {"ignoreNullFields": "false"})


_PATHS = [("updated",), ("topic", "last_set")]


@query("SELECT c_custkey, '{\"c_nationkey\":' || c_nationkey || ',\"parent\":null,\"topic\":{\"value\":\"\"}}' AS base, '{\"topic\":{\"last_set\":' || trunc(c_acctbal)::BIGINT || '},\"updated\":' || c_custkey || '}' AS volatile FROM customer")
def volatile_split(t):
    return t.customer.select("c_custkey", payloads.split_volatile(_payload(), _PATHS).alias("s")).select("c_custkey", "s.base", "s.volatile")


@query(
    "SELECT c_custkey, '{\"c_nationkey\":' || c_nationkey || ',\"parent\":null,\"topic\":{\"last_set\":' || trunc(c_acctbal)::BIGINT || ',\"value\":\"\"},\"updated\":' || c_custkey || '}' AS whole, '{\"a\":1,\"b\":null,\"c\":' || c_custkey || '}' AS over FROM customer"
)
def overlay(t):
    over = F.concat(F.lit('{"b":null,"c":'), F.col("c_custkey").cast("string"), F.lit("}"))
    customers = t.customer.select("c_custkey", "c_nationkey", "c_acctbal").repartition("c_custkey")  # few bytes to read, much to do for each row
    split = customers.select("c_custkey", payloads.split_volatile(_payload(), _PATHS).alias("s"))
    return split.select("c_custkey", payloads.overlay(F.col("s.base"), F.col("s.volatile")).alias("whole"), payloads.overlay(F.lit('{"a":1,"b":2}'), over).alias("over"))


# ---- fingerprints

_I = "coalesce('=' || ({}), '-')"


def _text(*values: str) -> str:
    return " || chr(31) || ".join(_I.format(v) for v in values)


@query(
    f"WITH i AS (SELECT 'conv-' || conv_id AS chat, conv_id, turn, sha256({_text('turn', 'role', 'turn * 60000', 'text', 'conv_id', chr(39) + 'a+b' + chr(39))}) AS h FROM conversations) "
    f"SELECT chat AS chat_uuid, sha256({_text('1', 'chat', chr(39) + 'all' + chr(39), 'NULL', 'NULL', 'chat')} || chr(30) || string_agg(h, chr(30) ORDER BY turn)) AS fingerprint FROM i GROUP BY chat"
)
def fp_chat_doc(t):
    chat = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    chats = t.conversations.select(chat.alias("chat_uuid"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("source_url"), chat.alias("org_uuid")).distinct()
    items = t.conversations.select(chat.alias("chat_uuid"), F.lit("all").alias("period"), F.col("turn").alias("uuid"), F.col("role").alias("author"), (F.col("turn") * 60000).alias("at_ms"), "text", F.array(F.col("conv_id").cast("string")).alias("attachments"), F.array(F.lit("b"), F.lit("a")).alias("reactions"))
    return payloads.chat_fingerprints(chats, items).select("chat_uuid", "fingerprint")


@query(f"SELECT c_custkey, sha256({_text('1', 'c_custkey', 'c_name', 'c_nationkey', chr(39) + 'segment=' + chr(39) + ' || c_mktsegment', '0')}) AS fingerprint FROM customer")
def fp_contact(t):
    fields = F.array(F.struct(F.lit("segment").alias("label"), F.col("c_mktsegment").alias("value")))
    return t.customer.select("c_custkey", payloads.contact_fingerprint(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), fields, F.lit(None).cast("long")).alias("fingerprint"))


_RECORD = """
WITH c AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS n, sha256('{{"flag":"' || l_returnflag || '","part":' || l_partkey || '}}') AS h FROM lineitem WHERE {where}),
a AS (SELECT l_orderkey, string_agg(h, chr(30) ORDER BY n, h) AS hs FROM c GROUP BY 1)
SELECT o_orderkey, sha256('{version}' || chr(30) || '{{"state":"' || o_orderstatus || '","title":"' || o_orderpriority || '"}}' || chr(30) || coalesce(hs, '')) AS fingerprint FROM orders LEFT JOIN a ON l_orderkey = o_orderkey
"""


def _records(t, version: int, where: str):
    records = t.orders.select("o_orderkey", F.to_json(F.struct(F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("state"))).alias("payload"))
    children = t.lineitem.where(where).select(F.col("l_orderkey").alias("o_orderkey"), F.to_json(F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))).alias("child"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("n"))
    return payloads.record_fingerprints(records, children, "o_orderkey", "payload", "child", "n", version)


@query(_RECORD.format(where="l_returnflag = 'R'", version=1))
def fp_pr(t):
    return _records(t, 1, "l_returnflag = 'R'")


@query(_RECORD.format(where="l_returnflag = 'A'", version=2))
def fp_mr(t):
    return _records(t, 2, "l_returnflag = 'A'")


@query(_RECORD.format(where="true", version=3))
def fp_page(t):
    return _records(t, 3, "true")


@query(
    f"WITH i AS (SELECT user_id, event_type, ts, event_id, sha256({_text('event_id', 'event_type')}) AS h FROM events) SELECT user_id, sha256({_text('1', 'user_id')} || chr(30) || string_agg(h, chr(30) ORDER BY event_type, event_id)) AS fingerprint FROM i GROUP BY 1"
)
def fp_beeper(t):
    item = payloads.item_text(F.col("event_id"), F.col("event_type"))
    return t.events.groupBy("user_id").agg(payloads.fingerprint(1, [F.col("user_id")], item, F.struct("event_type", "event_id")).alias("fingerprint"))


@query(f"WITH i AS (SELECT n_regionkey, n_nationkey, sha256({_text('n_nationkey', 'n_name')}) AS h FROM nation WHERE n_name <> '') SELECT n_regionkey, sha256({_text('1', chr(39) + 'chapter' + chr(39), 'n_regionkey')} || chr(30) || string_agg(h, chr(30) ORDER BY n_nationkey)) AS fingerprint FROM i GROUP BY 1")
def fp_perseus(t):
    """A chapter by its sections that have a text, in their order."""
    item = payloads.item_text(F.col("n_nationkey"), F.col("n_name"))
    return t.nation.where("n_name <> ''").groupBy("n_regionkey").agg(payloads.fingerprint(1, [F.lit("chapter"), F.col("n_regionkey")], item, F.col("n_nationkey")).alias("fingerprint"))


@query("SELECT count(*) AS n_series, count(*) AS n_fingerprints, count(*) FILTER (user_id % 5 = 0) AS n_changed FROM (SELECT DISTINCT user_id, event_type FROM events)")
def fp_yolink(t):
    """Series whose fingerprints differ once every fifth device has one value changed."""
    rows = t.events.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")
    first = F.col("ts_ms") == F.min("ts_ms").over(Window.partitionBy("user_id", "event_type"))
    changed = rows.withColumn("value", F.when((F.col("user_id") % 5 == 0) & first, F.col("value") + 1).otherwise(F.col("value")))
    a = payloads.series_fingerprints(rows, ["user_id", "event_type"])
    b = payloads.series_fingerprints(changed, ["user_id", "event_type"]).withColumnRenamed("fingerprint", "now").drop("n")
    return a.join(b, ["user_id", "event_type"]).agg(F.count(F.lit(1)).alias("n_series"), F.countDistinct("fingerprint").alias("n_fingerprints"), F.count(F.when(F.col("fingerprint") != F.col("now"), 1)).alias("n_changed"))


# ---- scopes

_SCOPES = """
s AS (SELECT c_custkey AS k, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN '{}' ELSE '{"media":' || (k % 2 = 0) || ',"blob_cap":' || CASE WHEN k % 3 = 0 THEN 'null' ELSE (k % 50)::VARCHAR END || ',"folders":' || CASE k % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["Inbox"]' ELSE '["Inbox","Sent"]' END || ',"since":"2024-0' || (k % 9 + 1) || '-01"}' END AS before,
  k % 5 <> 0 AS media, CASE WHEN k % 6 <> 0 THEN k % 40 END AS cap, CASE k % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Inbox', 'Spam'] ELSE ['Inbox'] END AS folders, '2024-05-01' AS since FROM customer)
"""


def _scopes(t):
    k = F.col("c_custkey")
    cap = F.when(k % 3 == 0, "null").otherwise((k % 50).cast("string"))
    lists = F.when(k % 4 == 0, "[]").when(k % 4 == 1, '["Inbox"]').otherwise('["Inbox","Sent"]')
    blob = F.concat(F.lit('{"media":'), (k % 2 == 0).cast("string"), F.lit(',"blob_cap":'), cap, F.lit(',"folders":'), lists, F.lit(',"since":"2024-0'), (k % 9 + 1).cast("string"), F.lit('-01"}'))
    before = F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, "{}").otherwise(blob)
    folders = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("Inbox"), F.lit("Spam"))).otherwise(F.array(F.lit("Inbox")))
    return t.customer.select(k.alias("k"), before.alias("before"), (k % 5 != 0).alias("media"), F.when(k % 6 != 0, k % 40).alias("cap"), folders.alias("folders"), F.lit("2024-05-01").alias("since"))


_KNOWN = "before IS NOT NULL AND k % 7 <> 0"
_RELAXED = f"({_KNOWN} AND k % 3 <> 0 AND (cap IS NULL OR cap > k % 50))"
_ADDED = "list_filter(folders, lambda x: NOT list_contains(CASE k % 4 WHEN 1 THEN ['Inbox'] ELSE ['Inbox', 'Sent'] END, x))"


@query(
    f"WITH {_SCOPES} SELECT k, {_KNOWN} AND media AND k % 2 <> 0 AS turned_on, {_RELAXED} AS relaxed, CASE WHEN NOT ({_KNOWN}) OR k % 4 = 0 THEN 'none' WHEN len(folders) = 0 THEN 'all' WHEN len({_ADDED}) > 0 THEN 'added' ELSE 'none' END AS change, "
    f"CASE WHEN {_KNOWN} AND k % 4 <> 0 THEN array_to_string({_ADDED}, ',') ELSE '' END AS added FROM s"
)
def scope_widen(t):
    widened = scope.filter_widened(F.col("before"), "folders", F.col("folders"))
    return _scopes(t).select("k", scope.turned_on(F.col("before"), "media", F.col("media")).alias("turned_on"), scope.limit_relaxed(F.col("before"), "blob_cap", F.col("cap")).alias("relaxed"), widened["change"].alias("change"), F.array_join(widened["added"], ",").alias("added"))


@query(f"WITH {_SCOPES} SELECT k, {_KNOWN} AND k % 9 + 1 > 5 AS backfill, ({_KNOWN} AND media AND k % 2 <> 0) OR (media AND {_RELAXED}) AS full_walk FROM s")
def slack_plan(t):
    plan = scope.channel_plan(F.col("before"), F.col("since"), F.col("media"), F.col("cap"))
    return _scopes(t).select("k", plan["backfill"].alias("backfill"), plan["full_walk"].alias("full_walk"))


@query("SELECT c_custkey, c_custkey % 3 <> 1 AS usable FROM customer")
def cursor_params(t):
    k = F.col("c_custkey")
    stored = F.when(k % 3 == 0, F.concat(F.lit('{"b": 1, "a": '), k.cast("string"), F.lit("}"))).when(k % 3 == 1, '{"a": "other", "b": 1}')
    params = F.concat(F.lit('{"a":'), k.cast("string"), F.lit(',"b":1}'))
    return t.customer.select("c_custkey", scope.cursor_usable(stored, params).alias("usable"))


@query(
    "WITH s AS (SELECT user_id AS k, CASE WHEN user_id % 4 <> 0 THEN max(ts) END AS cur, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 30 END AS days FROM events GROUP BY user_id), f AS (SELECT *, CASE WHEN days > 0 THEN TIMESTAMP '2024-02-01' - to_days(days::INTEGER) END AS low FROM s) "
    "SELECT k, CASE WHEN k % 10 = 0 THEN NULL WHEN cur IS NULL THEN low WHEN k % 2 = 0 THEN cur WHEN low IS NULL THEN NULL ELSE least(cur, low) END AS since FROM f"
)
def cursor_since(t):
    k = F.col("user_id")
    days = F.when(k % 3 == 0, 0).otherwise(k % 30).cast("int")
    cursors = t.events.groupBy("user_id").agg(F.max("ts").alias("last")).select(k.alias("k"), F.when(k % 4 != 0, F.col("last")).alias("cur"), days.alias("days"))
    now = F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz")
    k = F.col("k")
    return cursors.select("k", scope.since(F.col("cur"), now, F.col("days"), k % 10 == 0, k % 2 != 0).alias("since"))


@query(
    f"WITH {ORDERS_SQL}, d AS (SELECT coalesce(n.o_orderkey, o.o_orderkey) AS k, coalesce(n.o_custkey, o.o_custkey) AS c FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus) "
    "SELECT DISTINCT c || '/' || (k % 100) AS bucket FROM d"
)
def bucket_spec_slack(t):
    from mnemora.operators.versioned import diff

    changed = diff(old_orders(t), new_orders(t), ["o_orderkey"], ["o_orderstatus", "o_custkey"])
    keyed = changed.select("diff_type", F.coalesce("to_o_custkey", "from_o_custkey").alias("channel_id"), (F.col("o_orderkey") % 100).alias("thread_ts"))
    return scope.buckets_to_make("slack", {"messages": keyed, "users": keyed.limit(0)})


@query("SELECT 'email' AS kind, true AS some UNION ALL SELECT 'slack', false UNION ALL SELECT 'signal', false UNION ALL SELECT 'claude', false UNION ALL SELECT 'chatgpt', false")
def bucket_spec_fan_out(t):
    """Whether a change in every table leaves single buckets to make, or all of them."""
    one = t.nation.limit(1).select(F.lit("added").alias("diff_type"), *[F.lit("x").alias(c) for c in ("channel_id", "thread_ts", "thread_id", "period", "uuid", "id", "account")])
    rows = [(kind, scope.buckets_to_make(kind, {name: one for name in (*fan_out, *keyed)}) is not None) for kind, (fan_out, keyed) in scope.BUCKETS.items()]
    return t.spark.createDataFrame(rows, "kind string, some boolean")


@query("SELECT 'same' AS how, s_suppkey, s_name, NULL AS note FROM supplier UNION ALL SELECT 'added', s_suppkey, s_name, NULL FROM supplier")
def schema_reconcile(t):
    stored = t.supplier.select("s_suppkey", "s_name")
    outcomes = [scope.reconciled(stored, "s_suppkey long, s_name string"), scope.reconciled(stored, "s_suppkey long, note string, s_name string"), scope.reconciled(stored, "s_suppkey long")]
    parts = [d.select(F.lit(how).alias("how"), "s_suppkey", *[(F.col(c) if c in d.columns else F.lit(None)).cast("string").alias(c) for c in ("s_name", "note")]) for d, how in outcomes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "WITH d AS (SELECT p_partkey, string_split('root/' || replace(p_type, ' ', '/'), '/') AS p FROM part), e AS (SELECT DISTINCT p FROM d) "
    "SELECT array_to_string(p, '/') AS path, array_to_string(list_concat(['*.tmp'], CASE WHEN len(p) > 1 AND starts_with(p[2], 'S') THEN ['cache'] ELSE [] END), ',') AS ignore, len(p) > 1 AND starts_with(p[2], 'S') AS stamp, "
    "sha256('ignore:' || chr(10) || '*.tmp' || chr(10) || CASE WHEN len(p) > 1 AND starts_with(p[2], 'S') THEN 'cache' || chr(10) ELSE '' END || 'stamp:' || CASE WHEN len(p) > 1 AND starts_with(p[2], 'S') THEN '1' ELSE '0' END) AS fingerprint FROM e"
)
def fs_options_cascade(t):
    path = F.concat(F.lit("root/"), F.replace("p_type", F.lit(" "), F.lit("/")))
    directories = t.part.select(path.alias("path")).distinct()
    frames = directories.select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("path")).distinct().where("path like 'root/S%'").select("path", F.array(F.lit("cache")).alias("ignore"), F.lit(True).alias("stamp"))
    root = t.spark.range(1).select(F.lit("root").alias("path"), F.array(F.lit("*.tmp")).alias("ignore"), F.lit(None).cast("boolean").alias("stamp"))
    return fs.effective_options(directories, frames.unionByName(root)).select("path", F.array_join("ignore", ",").alias("ignore"), "stamp", "fingerprint")


# ---- a query's text


def _queries(t):
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.concat("lang", F.lit(" words"))).when(k % 3 == 1, F.concat(F.lit('say "two words" -not '), F.col("lang"))).otherwise(F.concat(F.lit('-only -"this one '), F.col("lang"), F.lit('"')))
    return t.documents.select("doc_id", text.alias("q"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS typed FROM documents WHERE lang IS NOT NULL")
def r_lex_detect(t):
    return _queries(t).where("q is not null").select("doc_id", retrieval.has_lex_syntax(F.col("q")).alias("typed"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ' words' WHEN 1 THEN 'say two words ' || lang ELSE '' END AS plain FROM documents WHERE lang IS NOT NULL")
def r_lex_strip(t):
    return _queries(t).where("q is not null").select("doc_id", retrieval.plain_words(F.col("q")).alias("plain"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ' words' WHEN 1 THEN 'lex: say \"two words\" -not ' || lang || chr(10) || 'vec: say two words ' || lang ELSE 'lex: -only -\"this one ' || lang || '\"' END AS doc FROM documents WHERE lang IS NOT NULL")
def r_build_doc(t):
    return _queries(t).where("q is not null").select("doc_id", retrieval.query_document(F.col("q")).alias("doc"))


@query(f"WITH {GRID_SQL} SELECT 'fields' AS how, uuid FROM grid WHERE author = 'user' UNION ALL SELECT 'text', uuid FROM grid WHERE contains(lower(text), 'th') AND kind NOT IN ('Chat', 'Slack Thread') UNION ALL SELECT 'ranked', uuid FROM grid WHERE kind = 'User Input' AND message_index % 5 = 0")
def r_route(t):
    rows = chat_grid(t)
    hits = lambda text, n: rows.where("message_index % 5 = 0").select("uuid", F.lit(0).cast("long").alias("rank"), F.lit(1.0).alias("score"))

    def fails(text, n):
        raise ValueError("no index")

    found = [("fields", routed(rows, Filters(equal=[("author", "user")]), hits, None)), ("text", routed(rows, Filters(text="th"), fails, None)), ("ranked", routed(rows, Filters(text="th", equal=[("kind", "User Input")]), hits, None))]
    parts = [d.select(F.lit(how).alias("how"), "uuid") for how, (d, _) in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- hits


def _hits(t):
    """Rendered reviews: a title line, then two lines for each comment, the first of which opens its section."""
    k = F.col("l_orderkey")
    own = dealt(t.lineitem.select("l_orderkey"), "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    line = lambda i: F.concat(F.lit('<div data-section-uuid="'), k.cast("string"), F.lit("-"), i.cast("string"), F.lit('">\nbody'))
    rendered = own.select(F.concat(F.lit("A_b/"), k.cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("title\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), line), "\n")).alias("text"), "n", "l_orderkey")
    rows = rendered.select("path", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"), "l_orderkey").select("path", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("i").cast("string")).alias("uuid"))
    at = F.col("l_orderkey") % 7
    snippet = F.when(at < 6, F.concat(F.lit("@@ -"), (at + 1).cast("string"), F.lit(",4 @@ (1 before, 2 after)"))).otherwise("no head")
    hits = own.select(k.alias("hit"), F.concat(F.lit("a-b/"), F.when(k % 13 == 0, F.lit("gone-")).otherwise(""), k.cast("string"), F.lit(".md")).alias("path"), snippet.alias("snippet"))
    return hits, rows, retrieval.anchors_of(rendered.select("path", "text"))


_HITS_SQL = """
o AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), h AS (SELECT k, n, k % 7 + 2 AS line FROM o WHERE k % 13 <> 0),
pinned AS (SELECT k AS hit, k || '-' || greatest(1, least(n, line // 2)) AS uuid FROM h WHERE k % 7 < 6),
every AS (SELECT k AS hit, k || '-' || i AS uuid FROM h, generate_series(1, n) g(i) WHERE k % 7 = 6),
found AS (SELECT * FROM pinned UNION ALL SELECT * FROM every)
"""


@query("SELECT l_orderkey AS hit, CASE WHEN l_orderkey % 7 < 6 THEN l_orderkey % 7 + 2 END AS line FROM lineitem GROUP BY 1")
def r_match_line(t):
    hits, _, _ = _hits(t)
    return hits.select("hit", retrieval.match_line(F.col("snippet")).alias("line"))


@query(f"WITH {_HITS_SQL} SELECT hit, uuid FROM found")
def r_rows_for_hit(t):
    return retrieval.rows_of_hits(*_hits(t), tasks(t.lineitem))


@query(f"WITH {_HITS_SQL} SELECT hit FROM found WHERE uuid = (SELECT min(uuid) FROM found)")
def r_hits_for_row(t):
    hits, rows, anchors = _hits(t)
    mapped = cut(retrieval.rows_of_hits(hits, rows, anchors, tasks(t.lineitem)))  # found once, for the least and for its hits
    uuid = mapped.agg(F.min("uuid")).first()[0]
    return retrieval.hits_of_row(hits, rows, anchors, uuid, mapped).select("hit")


@query("SELECT l_orderkey AS hit FROM lineitem WHERE l_orderkey % 13 = 0 GROUP BY 1")
def r_orphan_hits(t):
    hits, rows, _ = _hits(t)
    return retrieval.orphans(hits, rows).select("hit")


@query()
def r_chunk(t):
    return retrieval.chunks(t.documents)


# ---- what is shown


@query(
    f"""
    WITH {GRID_SQL}, m AS (SELECT * FROM (VALUES ('score', 'Score', true), ('source', 'Source', true), ('kind', 'Type', true), ('when', 'Time', true), ('snippet', 'Contents', true), ('author', 'Author', true), ('account', 'Account', true),
      ('org_name', 'Org', false), ('conversation_name', 'Conversation Name', false), ('project', 'Project', false), ('entire_chat', 'Entire Chat', false)) v(field, title, shown)),
    n AS (SELECT 'source' AS field, count(*) AS filled FROM grid UNION ALL SELECT 'kind', count(kind) FROM grid UNION ALL SELECT 'when', count(when_ts_utc) FROM grid UNION ALL SELECT 'snippet', count(text) FROM grid UNION ALL SELECT 'author', count(author) FROM grid UNION ALL SELECT 'entire_chat', count(entire_chat) FROM grid)
    SELECT field, title, shown, coalesce(filled, 0) AS filled FROM m LEFT JOIN n USING (field)
    """
)
def p_columns_manifest(t):
    """The columns of the result list with how many rows fill each."""
    return filled_manifest(chat_grid(t))


@query(f"WITH {GRID_SQL} (SELECT 'scored' AS how, uuid FROM grid WHERE message_index IS NOT NULL ORDER BY message_index DESC, uuid LIMIT 20) UNION ALL (SELECT 'timed', uuid FROM grid ORDER BY when_ts_utc NULLS FIRST, uuid LIMIT 20)")
def s_score_desc(t):
    rows = chat_grid(t)
    scored = default_order(rows.withColumn("score", F.col("message_index").cast("double"))).limit(20).select(F.lit("scored").alias("how"), "uuid")
    return scored.unionByName(default_order(rows).limit(20).select(F.lit("timed").alias("how"), "uuid"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY strftime(ts, '%Y-%m-%dT%H:%M'), event_id::VARCHAR) AS ids FROM events GROUP BY 1")
def s_slack_msgs(t):
    """Messages of a thread by two texts, the minute and the id, as they compare letter by letter."""
    from mnemora.operators.grid import ordered_text

    return t.events.groupBy("user_id").agg(ordered_text(F.col("event_id").cast("string"), F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("a"), F.col("event_id").cast("string").alias("b")), delimiter=",").alias("ids"))


@query(f"WITH {GRID_SQL}, c AS (SELECT count(*) AS rows FROM grid) SELECT n AS asked, least(greatest(2 * n, 50), 1000, rows) AS hits, least(n, 100000, rows) AS n_rows FROM c, (VALUES (10), (200), (600), (200000)) v(n)")
def s_limit_caps(t):
    """How many rows come back for what is asked, of hits to rank and of rows."""
    rows = chat_grid(t).select("uuid")
    counted = lambda n: rows.limit(n).agg(F.count(F.lit(1)).alias("n"))
    parts = [counted(hit_limit(n)).select(F.lit(n).alias("asked"), F.col("n").alias("hits"), counted(min(n, MOST_ROWS)).scalar().alias("n_rows")) for n in (10, DEFAULT_LIMIT, 600, 200000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {GRID_SQL} SELECT 'none' AS how, count(*) AS n FROM grid UNION ALL SELECT 'text', count(*) FROM grid WHERE contains(lower(text), 'th') AND kind <> 'Chat' UNION ALL SELECT 'all', count(*) FROM grid WHERE contains(lower(text), 'th') UNION ALL SELECT 'chat', count(*) FROM grid WHERE contains(lower(text), 'th') AND kind = 'Chat'")
def q_type_resolve(t):
    rows = chat_grid(t)
    asked = {"none": Filters(), "text": Filters(text="th"), "all": Filters(text="th", rows="all"), "chat": Filters(text="th", rows="chat")}
    parts = [matching(rows, q).agg(F.lit(how).alias("how"), F.count(F.lit(1)).alias("n")) for how, q in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {GRID_SQL} SELECT uuid FROM grid WHERE kind = 'User Input' AND author = 'user' AND conversation_uuid <> 'conv-1'")
def q_fields(t):
    assert {"kind", "author", "convo"} <= set(FIELDS)
    return matching(chat_grid(t), Filters(equal=[("kind", "User Input"), ("author", "user")], unequal=[("convo", "conv-1")])).select("uuid")
