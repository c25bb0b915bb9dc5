"""Queries of the provider dataflows, scalar functions, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemora.functions import columns as C
from mnemora.operators import align, files, flows, grid, timeseries
from mnemora.plans.registry import query
from mnemora.plans.views import GRID_SQL, READINGS_SQL, chat_grid, dealt, readings, tasks
from mnemora.streaming import events as stream


def _json_chats(t):
    """Conversations as JSON arrays of messages with content blocks, as an export has them."""
    block = F.struct(F.lit("text").alias("type"), F.col("text"))
    message = F.struct(F.col("turn").alias("o"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid"), F.col("role").alias("sender"), F.array(block, block).alias("content"))
    listed = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    return listed.select("conv_id", F.to_json(F.transform("m", lambda x: F.struct(x["uuid"].alias("uuid"), x["sender"].alias("sender"), x["content"].alias("content")))).alias("chat_messages"))


@query("SELECT conv_id, message_index, conv_id || '-' || turn AS message_uuid, role AS sender, b AS block_index, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message_index FROM conversations), (VALUES (0), (1)) v(b)")
def d_shred_claude(t):
    found = flows.shred_blocks(_json_chats(t), "conv_id", "chat_messages")
    return found.select("conv_id", F.col("message_index").cast("long").alias("message_index"), "message_uuid", "sender", "block_index", "text")


@query("SELECT conv_id, 'n' || turn AS message_id, role, text FROM conversations WHERE role <> 'system'")
def d_shred_chatgpt(t):
    content = F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts"))
    node = F.struct(F.when(F.col("role") != "system", F.struct(F.struct("role").alias("author"), content.alias("content"))).alias("message"), F.lit(None).cast("string").alias("parent"))
    mapping = t.conversations.groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("turn").cast("string")), node)))).alias("mapping"))
    return flows.shred_map(mapping, "conv_id", "mapping").select("conv_id", "message_id", "role", "text")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User Input' WHEN 'assistant' THEN 'LLM Response' WHEN 'system' THEN 'System Prompt' WHEN 'tool' THEN 'Tool Result' ELSE role END AS kind FROM conversations")
def d_role_kind(t):
    return t.conversations.select("conv_id", "turn", grid.role_kind(F.col("role")).alias("kind"))


@query(
    "WITH m AS (SELECT 'c' || (user_id % 3) AS channel, event_id, CASE WHEN event_id % 4 <> 0 THEN event_id - event_id % 4 ELSE event_id END AS root FROM events) "
    "SELECT event_id, channel, root AS root_ts, row_number() OVER (PARTITION BY channel, root ORDER BY event_id) - 1 AS place, min(CASE WHEN event_id = root THEN 'e' || event_id END) OVER (PARTITION BY channel, root) AS root_uuid FROM m"
)
def d_slack_threads(t):
    k = F.col("event_id")
    messages = t.events.select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("channel"), k.alias("ts"), F.when(k % 4 != 0, k - k % 4).alias("thread_ts"), F.concat(F.lit("e"), k.cast("string")).alias("uuid"))
    return flows.chat_threads(messages).select("event_id", "channel", "root_ts", F.col("place").cast("long").alias("place"), "root_uuid")


@query(
    "WITH m AS (SELECT 'a' || (l_orderkey % 3) AS account, l_orderkey AS thread_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || floor(l_extendedprice)::BIGINT AS id, l_shipdate AS sent, CASE WHEN l_linenumber > 1 THEN 'Re: ' ELSE '' END || l_orderkey AS subject, l_returnflag, l_linestatus FROM lineitem), "
    "lab AS (SELECT account, thread_id, string_agg(DISTINCT l, ',' ORDER BY l) AS labels FROM (SELECT account, thread_id, l_returnflag AS l FROM m UNION ALL SELECT account, thread_id, l_linestatus FROM m) GROUP BY 1, 2) "
    "SELECT account, thread_id, count(*) AS n, arg_min(subject, (sent, id)) AS subject, min(sent) AS first_at, max(sent) AS last_at, string_agg(id, ',' ORDER BY sent, id) AS ids, any_value(labels) AS labels FROM m JOIN lab USING (account, thread_id) GROUP BY 1, 2"
)
def d_email_threads(t):
    text = lambda c: F.col(c).cast("string")
    mails = t.lineitem.select(
        F.concat(F.lit("a"), (F.col("l_orderkey") % 3).cast("string")).alias("account"), F.col("l_orderkey").alias("thread_id"),
        F.concat_ws("-", text("l_linenumber"), text("l_partkey"), text("l_suppkey"), F.floor("l_extendedprice").cast("string")).alias("id"), F.col("l_shipdate").alias("received_at"),
        F.concat(F.when(F.col("l_linenumber") > 1, "Re: ").otherwise(""), text("l_orderkey")).alias("subject"), F.array("l_returnflag", "l_linestatus").alias("labels"),
    )
    return flows.mail_threads(mails)


@query(
    "SELECT doc_id, CASE WHEN trim(replace(replace(coalesce(text, ''), chr(10), ''), chr(9), '')) = '' THEN coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'On Monday someone wrote:' ELSE '' END || chr(10) || '> old' || chr(10) || '> words' ELSE text END AS own FROM documents"
)
def d_split_quoted(t):
    tail = F.concat(F.when(F.col("doc_id") % 2 == 0, "\nOn Monday someone wrote:").otherwise(""), F.lit("\n> old\n> words"))
    return t.documents.select("doc_id", flows.split_quoted(F.concat(F.coalesce("text", F.lit("")), tail)).alias("own"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'On Monday someone wrote:' || chr(10) ELSE '' END || '> old' || chr(10) || '> words' AS quoted FROM documents WHERE trim(replace(replace(coalesce(text, ''), chr(10), ''), chr(9), '')) <> ''")
def d_quoted_part(t):
    """What a mail quotes, with line ends as mails have them."""
    tail = F.concat(F.when(F.col("doc_id") % 2 == 0, "\r\nOn Monday someone wrote:").otherwise(""), F.lit("\r\n> old\r\n> words"))
    own = t.documents.where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\t]", "")) != "")
    return own.select("doc_id", flows.quoted_part(F.concat(F.coalesce("text", F.lit("")), tail)).alias("quoted"))


@query("SELECT r_regionkey * 1000 AS id, r_name AS path FROM region UNION ALL SELECT n_nationkey, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def d_mailbox_paths(t):
    nodes = t.region.select((F.col("r_regionkey") * 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name")).unionByName(t.nation.select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") * 1000).cast("long").alias("parent_id"), F.col("n_name").alias("name")).where("id > 0 or parent_id >= 0"))
    named = nodes.withColumn("id", F.when(F.col("parent_id").isNull(), F.col("id") + 1_000_000).otherwise(F.col("id"))).withColumn("parent_id", F.col("parent_id") + 1_000_000)
    return files.tree_paths(named, F.col("name")).select(F.when(F.col("id") >= 1_000_000, F.col("id") - 1_000_000).otherwise(F.col("id")).alias("id"), "path")


@query("SELECT event_id AS id, CASE WHEN event_id < 9 THEN 0 ELSE event_id - event_id % 9 END AS owner FROM events")
def d_notion_owner(t):
    blocks = t.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 9 == 0).alias("is_page"), (F.col("event_id") - 1).alias("parent_id"))
    return flows.owners(blocks)


@query("SELECT doc_id, 'c' || k AS child FROM documents, (VALUES (0), (1)) v(k)")
def d_notion_children(t):
    payload = F.to_json(F.struct(F.array(F.lit("c0"), F.lit("c1")).alias("content")))
    return flows.children(t.documents.select("doc_id", payload.alias("payload")), "doc_id", "payload")


@query(
    """
    WITH n AS (SELECT l_orderkey AS request, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_shipdate AS sent, l_returnflag, l_linestatus AS path, l_quantity::BIGINT AS line, l_linenumber FROM lineitem),
    i AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN id - 1 END AS reply_to FROM n WHERE l_returnflag = 'R'),
    p AS (SELECT i.request, i.id, i.sent, CASE WHEN u.id IS NULL THEN i.path ELSE u.path END AS path, CASE WHEN u.id IS NULL THEN i.line ELSE u.line END AS line, coalesce(i.reply_to, i.id) AS thread FROM i LEFT JOIN i u ON u.id = i.reply_to),
    b AS (SELECT request, id, sent, 1 AS section, NULL AS path, NULL AS line, NULL AS thread FROM n WHERE l_returnflag = 'A' UNION ALL SELECT request, id, sent, 0, NULL, NULL, NULL FROM n WHERE l_returnflag = 'N' UNION ALL SELECT request, id, sent, 2, path, line, thread FROM p)
    SELECT request, id, section, path, line, row_number() OVER (PARTITION BY request ORDER BY section, path NULLS FIRST, line NULLS FIRST, thread NULLS FIRST, sent, id) - 1 AS place FROM b
    """
)
def d_github_pr(t):
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = dealt(t.lineitem, "l_orderkey").withColumn("id", F.col("l_orderkey") * 1000 + F.row_number().over(own))  # the driver table has no key of its own
    notes = numbered.select(F.col("l_orderkey").alias("request"), "id", F.col("l_shipdate").alias("at"), F.col("l_suppkey").alias("author"), F.lit("").alias("body"), "l_returnflag", F.col("l_linestatus").alias("path"), F.col("l_quantity").cast("long").alias("line"), F.when(F.col("l_linenumber") % 2 == 0, F.col("id") - 1).alias("reply_to"))
    kind = lambda flag: notes.where(F.col("l_returnflag") == flag)
    return flows.review_timeline(kind("N"), kind("A"), kind("R"), tasks(t.lineitem)).select("request", "id", "section", "path", "line", "place")


@query(
    """
    WITH n AS (SELECT l_orderkey AS request, l_shipdate AS sent, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_linestatus = 'F' AND l_linenumber > 3 AS sys, CASE WHEN l_linenumber <> 7 THEN l_partkey % 2 END AS d FROM lineitem),
    o AS (SELECT *, coalesce(d::VARCHAR, 'note-' || id) AS e FROM n), h AS (SELECT request, e, min(sent) AS first_at, arg_min(id, (sent, id)) AS first_id, arg_min(sys, (sent, id)) AS first_sys FROM o GROUP BY 1, 2),
    x AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY first_at, first_id) - 1 AS discussion_index FROM h)
    SELECT request, id, discussion_index, row_number() OVER (PARTITION BY o.request, o.e ORDER BY sent, id) - 1 AS note_index,
           CASE WHEN first_sys THEN 'event' WHEN sys THEN 'system note' WHEN id = first_id THEN 'thread' ELSE 'reply' END AS kind FROM o JOIN x USING (request, e)
    """
)
def d_gitlab_mr(t):
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    notes = t.lineitem.select(
        F.col("l_orderkey").alias("request"), F.when(F.col("l_linenumber") != 7, F.col("l_partkey") % 2).alias("discussion"), (F.col("l_orderkey") * 1000 + F.row_number().over(own)).alias("id"), F.col("l_shipdate").alias("at"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") > 3)).alias("system"),
    )
    return flows.discussions(notes).select("request", "id", F.col("discussion_index").cast("long").alias("discussion_index"), F.col("note_index").cast("long").alias("note_index"), "kind")


@query("SELECT conv_id, conv_id || '-' || turn AS message_uuid, a AS attachment_index, CASE WHEN a < turn % 3 THEN 'attachment' ELSE 'file' END AS kind, CASE WHEN a < turn % 3 THEN 'att ' || a ELSE 'file ' || (a - turn % 3) END AS name FROM conversations, (VALUES (0), (1), (2), (3)) v(a) WHERE a < turn % 3 + conv_id % 3")
def d_shred_attachments(t):
    """Attachments and files of messages in one running index."""
    named = lambda label, n: F.transform(F.filter(F.array(*map(F.lit, range(3))), lambda i: i < n), lambda i: F.struct(F.concat(F.lit(label), i.cast("string")).alias("name")))
    message = F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("uuid"), named("att ", F.col("turn") % 3).alias("attachments"), named("file ", F.col("conv_id") % 3).alias("files"))
    chats = t.conversations.groupBy("conv_id").agg(F.to_json(F.collect_list(message)).alias("messages"))
    found = flows.shred_attachments(chats, "conv_id", "messages")
    return found.select("conv_id", "message_uuid", "attachment_index", "kind", F.get_json_object("payload", "$.name").alias("name"))


@query(f"WITH {READINGS_SQL} SELECT event_id, strftime(make_timestamp((ts_ms - 1710000000000) * 1000), '%Y-%m') AS month, strftime(make_timestamp((ts_ms - 1710000000000) * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(ts_ms * 1000), '%Y') AS year FROM readings")
def d_chat_periods(t):
    early = F.col("ts_ms") - 1710000000000
    return readings(t).select("event_id", C.period_key(early, "month").alias("month"), C.period_key(early, "day").alias("day"), C.period_key(F.col("ts_ms"), "year").alias("year"))


@query(f"WITH {GRID_SQL} SELECT uuid, kind, when_ts_utc, author, conversation_uuid, message_index, entire_chat, text, markdown_uuid FROM grid")
def d_grid_rows_chat(t):
    return chat_grid(t).select("uuid", "kind", "when_ts_utc", "author", "conversation_uuid", "message_index", "entire_chat", "text", "markdown_uuid")


@query(
    """
    WITH b AS (SELECT '+' || o_custkey AS number, epoch_us(o_orderdate) // 1000 AS at_ms, o_orderkey % 2 = 0 AS outgoing, o_orderpriority AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'Name ' || o_custkey END AS name, 'text' AS kind FROM orders
      UNION ALL SELECT '+' || l_suppkey, epoch_us(l_shipdate) // 1000, l_linenumber % 2 = 0, CASE WHEN l_linenumber % 2 = 0 THEN 'Outgoing' ELSE 'Incoming' END || ' call ' || (l_partkey // 3600) || ':' || lpad((l_partkey % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((l_partkey % 60)::VARCHAR, 2, '0'), '+' || l_suppkey, 'call' FROM lineitem),
    d AS (SELECT number, coalesce(arg_min(name, (at_ms, kind, text)) FILTER (name <> '' AND NOT regexp_matches(name, '^[+0-9]')), arg_min(name, (at_ms, kind, text)) FILTER (name <> '')) AS display FROM b GROUP BY 1)
    SELECT number, coalesce(display, number) AS display, strftime(make_timestamp(at_ms * 1000), '%Y-%m') AS period, count(*) AS n, count(*) FILTER (kind = 'call') AS calls, min(text) AS least FROM b JOIN d USING (number) GROUP BY 1, 2, 3
    """
)
def d_sms_merge(t):
    number = lambda c: F.concat(F.lit("+"), F.col(c).cast("string"))
    k = F.col("o_orderkey")
    texts = t.orders.select(number("o_custkey").alias("number"), C.epoch_ms(F.col("o_orderdate")).alias("at_ms"), (k % 2 == 0).alias("outgoing"), F.col("o_orderpriority").alias("body"), F.when(k % 3 == 0, F.concat(F.lit("Name "), F.col("o_custkey").cast("string"))).alias("name"))
    calls = t.lineitem.select(number("l_suppkey").alias("number"), C.epoch_ms(F.col("l_shipdate")).alias("at_ms"), (F.col("l_linenumber") % 2 == 0).alias("outgoing"), F.col("l_partkey").alias("seconds"), number("l_suppkey").alias("name"))
    log = flows.phone_log(texts, calls)
    return log.groupBy("number", "display", "period").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "call", 1)).alias("calls"), F.min("text").alias("least"))


@query("SELECT l_orderkey, CASE WHEN len(m) = 1 THEN m[1] ELSE 'group-' || substr(sha256(array_to_string(m, ',')), 1, 8) END AS channel FROM (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey::VARCHAR))) AS m FROM lineitem GROUP BY 1)")
def d_voice_channel(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("m")).select("l_orderkey", flows.channel_key(F.col("m")).alias("channel"))


@query(
    f"""
    WITH {READINGS_SQL}, m AS (SELECT device AS space, 'w' || (event_id % (length(device) - 6)) AS sender, ts_ms, strftime(make_timestamp(ts_ms * 1000), '%Y-%m') AS period FROM readings),
    w AS (SELECT space, count(DISTINCT sender) AS writers FROM m GROUP BY 1)
    SELECT space, period, count(*) AS n, count(DISTINCT sender) AS senders, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, any_value(writers) <= 2 AS direct FROM m JOIN w USING (space) GROUP BY 1, 2
    """
)
def d_takeout_chat(t):
    sender = F.concat(F.lit("w"), (F.col("event_id") % (F.length("device") - 6)).cast("string"))
    messages = readings(t).select(F.col("device").alias("space"), sender.alias("sender"), F.col("ts_ms").alias("at_ms"), F.col("metric").alias("text"))
    return flows.space_periods(messages)


@query(
    "WITH s AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'position:' || o_orderkey ELSE 'urn:li:' || CASE WHEN o_orderkey % 3 = 1 THEN 'share' ELSE 'activity' END || ':' || o_orderkey END AS k, o_orderdate AS at FROM orders WHERE o_orderkey % 2 = 0), "
    "c AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'https://x.org/p/' || l_orderkey ELSE 'urn:li:' || CASE WHEN l_orderkey % 3 = 1 THEN 'share' ELSE 'activity' END || ':' || l_orderkey END AS k, min(l_shipdate) AS first_at, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) "
    "SELECT coalesce(s.k, c.k) AS k, coalesce(s.at, c.first_at) AS at, coalesce(c.n, 0) AS n_comments FROM s FULL JOIN c ON s.k = c.k"
)
def d_linkedin_posts(t):
    def link(k, other):
        text = k.cast("string")
        return F.when(k % 3 == 1, F.concat(F.lit("https://x.org/feed/update/urn%3Ali%3Ashare%3A"), text, F.lit("/?a=1"))).when(k % 3 == 2, F.concat(F.lit("https://x.org/posts/some-words-activity-"), text, F.lit("-Ab_c"))).otherwise(other)

    o, l = F.col("o_orderkey"), F.col("l_orderkey")
    shares = t.orders.where("o_orderkey % 2 = 0").select(flows.post_key(link(o, None), o).alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("text"))
    stated = link(l, F.concat(F.lit("https://x.org/p/"), l.cast("string"), F.lit("/?q=1#top")))
    comments = t.lineitem.where("l_returnflag = 'R'").select(flows.post_key(stated, l).alias("k"), F.col("l_shipdate").alias("at"), F.col("l_linestatus").alias("text"))
    return flows.merged_threads(shares, comments, "k").select("k", "at", "n_comments")


_U5 = "(SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || CAST(c_mktsegment AS BLOB)) AS h FROM customer)"


@query(
    f"WITH i AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'uid-' || c_custkey WHEN c_custkey % 3 = 1 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER % 4 + 1)::INTEGER, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) ELSE 'pos-' || c_custkey END AS identity FROM {_U5}) SELECT c_custkey, identity, count(*) OVER (PARTITION BY identity) AS n_sharing FROM i"
)
def d_contact_identity(t):
    k = F.col("c_custkey")
    contacts = t.customer.select("c_custkey", F.when(k % 3 == 0, F.concat(F.lit("uid-"), k.cast("string"))).alias("uid"), F.when(k % 3 == 1, F.col("c_mktsegment")).alias("name"))
    return flows.contact_identity(contacts, "uid", "name", "c_custkey").select("c_custkey", "identity", "n_sharing")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'id-' || c_custkey ELSE c_name END || chr(10) || c_mktsegment || chr(10) || c_nationkey AS text FROM customer")
def d_contact_row(t):
    k = F.col("c_custkey")
    fields = F.array(F.struct(F.lit("segment").alias("label"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("label"), F.col("c_nationkey").cast("string").alias("value")))
    return t.customer.select("c_custkey", flows.contact_text(F.when(k % 4 != 0, F.col("c_name")), F.concat(F.lit("id-"), k.cast("string")), fields).alias("text"))


@query("SELECT DISTINCT a.l_orderkey AS k, a.l_partkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'")
def d_edges(t):
    groups = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_partkey").alias("a"), F.collect_list("l_suppkey").alias("b"))
    return flows.sentence_edges(groups, "k", "a", "b").select("k", "src", "dst")


@query(
    r"""
    WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])(\s+[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x, unnest(range(100000)[1:len(string_split(regexp_replace(text, '([.!?])(\s+[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))]) AS n FROM documents),
    s AS (SELECT doc_id, n, regexp_replace(x, '^\s+|\s+$', '', 'g') AS text, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY n) - length(x) + length(regexp_extract(x, '^\s*')) AS start FROM p)
    SELECT doc_id, text, start::BIGINT AS start, length(text)::BIGINT AS length FROM s WHERE text <> ''
    """
)
def d_sentence_split(t):
    each = t.documents.select("doc_id", F.explode(flows.sentences(F.col("text"))).alias("s"))
    return each.select("doc_id", "s.text", F.col("s.start").cast("long").alias("start"), F.col("s.length").cast("long").alias("length"))


@query(
    "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings) "
    "SELECT vec_id, array_to_string(list_transform(e, lambda x: round(CASE WHEN norm > 0 THEN x / norm ELSE x END * 10000)::BIGINT), ',') AS unit FROM n"
)
def d_embed_norm(t):
    unit = F.transform(align.normalised(F.col("embedding")), lambda x: F.round(x * 10000).cast("long").cast("string"))
    return t.embeddings.select("vec_id", F.array_join(unit, ",").alias("unit"))


@query()
def d_align_dp(t):
    side = lambda r: t.embeddings.where(F.col("vec_id") % 2 == r).select(F.col("label").alias("section"), F.col("vec_id").alias("place"), F.col("embedding").alias("vector"), (F.col("vec_id") % 13 + 5).alias("length"))
    return align.align(side(0), side(1))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'temperature' WHEN 'view' THEN 'volume' ELSE 'humidity' END AS quantity, round(CASE event_type WHEN 'click' THEN (value - 32) * 5.0 / 9.0 WHEN 'view' THEN value * 3.785411784 ELSE value END, 6) AS value FROM events")
def d_units(t):
    metric = F.when(F.col("event_type") == "click", "temperature_f").when(F.col("event_type") == "view", "water_meter_gal").otherwise("humidity_pct")
    return timeseries.to_si(t.events.select("event_id", metric.alias("metric"), "value")).select("event_id", "quantity", F.round("value", 6).alias("value"))


@query(f"WITH {GRID_SQL} SELECT uuid, coalesce(nullif(text, ''), conversation_uuid, uuid) AS name FROM grid")
def d_dactal_row(t):
    return chat_grid(t).select("uuid", F.coalesce(F.nullif("text", F.lit("")), "conversation_uuid", "uuid").alias("name"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a [label](https://x.org) b' WHEN 1 THEN 'a  b' WHEN 2 THEN 'a open ' || lang ELSE text END AS text FROM documents")
def d_clean_sentinels(t):
    o, p, c = flows.REGION_OPENS, flows.REGION_PARTS, flows.REGION_CLOSES
    n = F.col("doc_id") % 4
    raw = F.when(n == 0, F.lit(f"a {o}url{p}label{p}https://x.org{c} b")).when(n == 1, F.lit(f"a {o}cite{p}one{p}two{p}three{c} b")).when(n == 2, F.concat(F.lit(f"a {o}open "), F.col("lang"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", flows.clean_regions(raw).alias("text"))


@query(
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || chr(10) || 'more' WHEN 1 THEN text WHEN 2 THEN 'short' || chr(10) || chr(10) || text WHEN 3 THEN lang WHEN 4 THEN source ELSE '' END AS text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL"
)
def d_content_text(t):
    n = F.col("doc_id") % 6
    kind = lambda name: F.lit(name).alias("content_type")
    made = (
        F.when(n == 0, F.to_json(F.struct(kind("text"), F.array(F.to_variant_object(F.struct("text")), F.lit("more").cast("variant"), F.lit(7).cast("variant")).alias("parts"))))
        .when(n == 1, F.to_json(F.struct(kind("code"), "text")))
        .when(n == 2, F.to_json(F.struct(kind("thoughts"), F.array(F.struct(F.lit("short").alias("summary"), F.col("text").alias("content"))).alias("thoughts"))))
        .when(n == 3, F.to_json(F.struct(kind("reasoning_recap"), F.col("lang").alias("content"))))
        .when(n == 4, F.to_json(F.struct(kind("model_editable_context"), F.col("source").alias("model_set_context"))))
        .otherwise(F.to_json(F.struct(kind("image"), "text")))
    )
    return t.documents.where("text is not null and source is not null").select("doc_id", flows.content_text(made).alias("text"))


@query(
    "SELECT conv_id, turn, '**' || role || '** ~~old~~ [' || role || '](https://x.org) <https://y.org> @' || CASE WHEN role = 'user' THEN 'Ann Lee' ELSE 'U_OTHER' END || ' @bob #ops @here a & b <3 👍 :nosuch:' || chr(10) || '> q' || chr(10) || chr(10) || 'after' AS md FROM conversations"
)
def d_slack_mrkdwn(t):
    mention = F.when(F.col("role") == "user", "<@U_ANN>").otherwise("<@U_OTHER>")
    raw = F.concat(F.lit("*"), F.col("role"), F.lit("* ~old~ <https://x.org|"), F.col("role"), F.lit("> <https://y.org> "), mention, F.lit(" <@U_BOB|bob> <#C_OPS|ops> <!here> a &amp; b &lt;3 :thumbsup: :nosuch:\n> q\nafter"))
    names = F.create_map(F.lit("U_ANN"), F.lit("Ann Lee"))
    return t.conversations.select("conv_id", "turn", flows.to_markdown(raw, names, F.create_map(F.lit("thumbsup"), F.lit("👍"))).alias("md"))


# ---- scalar functions


@query("SELECT page_id, regexp_replace(lower(url), '[_-]+', '-', 'g') AS path, trim(substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60), '-') AS slug FROM pages")
def fn_text(t):
    return t.pages.select("page_id", C.norm_path(F.col("url")).alias("path"), C.slugify(F.col("url")).alias("slug"))


@query("SELECT doc_id, md5(text) AS m, sha256(text) AS s, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM documents")
def fn_hash(t):
    return t.documents.select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"), C.escape_html(F.col("text")).alias("html"))


@query("SELECT p_partkey, replace(replace(replace(p_name || '/a b?' || p_partkey, ' ', '%20'), '/', '%2F'), '?', '%3F') AS url, 'see <a href=\"https://x.org/' || p_partkey || '\">https://x.org/' || p_partkey || '</a>.' AS linked, CASE WHEN p_partkey % 2 = 0 THEN 'plain words' ELSE '\"a: \\\"b\\\"\"' END AS yaml, replace(format('{:,}', p_partkey * 1000), '.', ',') AS n, 'x' || p_partkey AS token FROM part")
def fn_url(t):
    k = F.col("p_partkey")
    address = F.concat(F.lit("https://x.org/"), k.cast("string"))
    return t.part.select(
        "p_partkey", C.percent_encode(F.concat("p_name", F.lit("/a b?"), k.cast("string"))).alias("url"), C.autolink(F.concat(F.lit("see "), address, F.lit("."))).alias("linked"),
        C.yaml_safe(F.when(k % 2 == 0, "plain words").otherwise('a: "b"')).alias("yaml"), C.thousands(k * 1000).alias("n"), C.id_token(F.concat(F.lit("https://x.org/some/x"), k.cast("string"), F.lit("?q=1"))).alias("token"),
    )


@query("SELECT c_custkey, '{\"a\":{\"b\":' || c_nationkey || ',\"c\":null},\"z\":\"' || c_mktsegment || '\"}' AS canonical FROM customer")
def fn_canonical_json(t):
    raw = F.concat(F.lit('{ "z": "'), F.col("c_mktsegment"), F.lit('", "a": {"c": null, "b": '), F.col("c_nationkey").cast("string"), F.lit("}}"))
    return t.customer.select("c_custkey", C.canonical_json(raw).alias("canonical"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {READINGS_SQL} SELECT event_id, CASE WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN (s // 60) || ' min' WHEN s < 86400 THEN (s // 3600) || ' h' ELSE (s // 86400) || ' d' END AS gap FROM (SELECT event_id, (ts_ms % 200000000) // 1000 AS s FROM readings)")
def fn_gap(t):
    return readings(t).select("event_id", C.human_gap(F.col("ts_ms") % 200000000).alias("gap"))


# ---- streams


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_tumbling(t):
    return stream.run_once(stream.tumbling(stream.read(t.spark, t.sf_dir), "1 day"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 hours THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 hours AS \"end\", count(*) AS n FROM s GROUP BY user_id, s.n"
)
def st_sessions(t):
    found = stream.run_once(stream.sessions(stream.read(t.spark, t.sf_dir), "12 hours"), "complete")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_id FROM events")
def st_deduplicated(t):
    events = stream.read(t.spark, t.sf_dir)
    return stream.run_once(stream.deduplicated(events.unionByName(events), "event_id")).select("event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def st_upsert(t):
    return stream.latest(t.spark, stream.read(t.spark, t.sf_dir), ["user_id"]).select("user_id", "event_id")
