"""Queries of the readers: driver rows are written as a source's files to the shared folder and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.durable import shared_dir
from mnemora.operators import versioned
from mnemora.plans.registry import query
from mnemora.plans.views import GRID_SQL, chat_grid
from mnemora.sources import readers, takeout, tei


#: Files are moved to their place by the tasks that wrote them, not one by one by the driver at the end.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def _tasks(t) -> int:
    """How many tasks write files, stated: left to Spark few bytes are one task, however many files they are."""
    return int(t.spark.conf.get("spark.sql.shuffle.partitions"))


def _folder(t) -> str:
    return f"{shared_dir(t.spark)}/mnemora-source-{uuid.uuid4().hex}"


def _lines(lines: DataFrame, path: str, separator: str = "\n") -> str:
    """A column of texts as text files."""
    lines.write.option("lineSep", separator).text(path)
    return path


def _bucketed(t, lines: DataFrame, head: str = "", tail: str = "", separator: str = "\n", by: str = "bucket") -> str:
    """``lines (bucket, line)`` as a text file for each bucket, between a head and a tail; a bucket is few lines, however many there are."""
    path = _folder(t)
    whole = F.concat(F.lit(head), F.array_join(F.collect_list("line"), separator), F.lit(tail))
    lines.groupBy(by).agg(whole.alias("value")).repartition(_tasks(t), by).write.options(**BY_TASKS).partitionBy(by).text(path)
    return path


@query("SELECT doc_id AS id, lang FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0")
def src_raw_payloads(t):
    whole = F.to_json(F.struct("lang", "source"))
    payload = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.lit("{bad")).otherwise(whole)
    return readers.raw_payloads(t.documents.select(F.col("doc_id").alias("id"), payload.alias("payload")), "lang string, source string").select("id", "data.lang")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS v FROM customer")
def src_jsonl_latest(t):
    root = _folder(t)
    row = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    row.write.json(f"{root}/created")
    row.where("id % 3 = 0").withColumn("v", F.lit("changed")).write.json(f"{root}/updated")
    return readers.jsonl_latest(t.spark, f"{root}/created", f"{root}/updated", ["id"], "id long, v string")


def _renamed(t, root: str, name: str) -> str:
    """The files that Spark wrote below the folders of ``root``, each under ``name`` in its folder, as an export has them."""
    jvm = t.spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/*/part-*")
    store = at.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    for k, status in enumerate(store.globStatus(at)):
        path = status.getPath()
        own = path.getParent().getName().partition("=")[2]  # what the folder is of
        store.rename(path, jvm.org.apache.hadoop.fs.Path(path.getParent(), name.format(k, parent=own)))
    return root


@query(f"WITH {GRID_SQL} SELECT markdown_uuid, 'first' AS source_name, count(*) AS n, count(DISTINCT uuid) AS n_uuids FROM grid GROUP BY 1")
def src_sidecars(t):
    root = _folder(t)
    rows = chat_grid(t).select("markdown_uuid", "uuid", "kind", "text", "when_ts_utc")
    listed = rows.groupBy("markdown_uuid").agg(F.collect_list(F.struct("uuid", "kind", "text")).alias("rows"))
    document = F.to_json(F.struct("markdown_uuid", "rows"))
    bucket = F.floor(F.regexp_extract("markdown_uuid", "([0-9]+)$", 1).cast("long") / 50)  # a file holds few documents, however many there are
    files = listed.groupBy(bucket.alias("bucket")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(document), ",\n"), F.lit("\n]")).alias("value"))
    files.repartition(_tasks(t), "bucket").write.options(**BY_TASKS).partitionBy("bucket").text(f"{root}/first/rendered_md")
    files.where("bucket = 0").write.partitionBy("bucket").text(f"{root}/first/rendered_md/system")
    _renamed(t, f"{root}/first/rendered_md", "part_{}.grid_rows.json")
    _renamed(t, f"{root}/first/rendered_md/system", "own_{}.grid_rows.json")
    own = readers.sidecars(t.spark, root, "markdown_uuid string, rows array<struct<uuid:string>>")
    return own.select("markdown_uuid", "source_name", F.explode("rows").alias("r")).groupBy("markdown_uuid", "source_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("r.uuid").alias("n_uuids"))


_MAILS = "SELECT conv_id, turn, role, replace(coalesce(text, ''), chr(10), ' ') AS text FROM conversations"


@query(f"WITH m AS ({_MAILS}) SELECT role || '@example.org' AS sender, 'Mail ' || conv_id || '-' || turn AS subject, text || chr(10) || 'From here' || chr(10) || '>From there' AS body, 'Inbox,A, B' AS labels FROM m")
def src_mbox(t):
    one_line = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    body = F.concat(F.regexp_replace(one_line, "^(>*From )", ">$1"), F.lit("\n>From here\n>>From there"))
    head = F.concat(F.lit("From x Mon Jan 1\nFrom: "), F.col("role"), F.lit("@example.org\nSubject: Mail "), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    mail = F.concat(head, F.lit('\nX-Gmail-Labels: Inbox,"A, B"\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n'), body)
    path = _lines(t.conversations.select(mail.alias("value")), _folder(t))
    read = readers.mailbox(t.spark, path)
    return read.select("sender", "subject", F.regexp_replace("body", r"\n\z", "").alias("body"), F.array_join("labels", ",").alias("labels"))


@query("SELECT doc_id, 'a, b|plain|with \"quotes\"|' || lang AS labels FROM documents")
def src_gmail_labels(t):
    stated = F.concat(F.lit('"a, b",plain,"with \\"quotes\\"", '), F.col("lang"))
    return t.documents.select("doc_id", F.array_join(readers.gmail_labels(stated), "|").alias("labels"))


@query("SELECT 'uid-' || c_custkey AS uid, c_name AS name, 2 + 1 AS n_fields, c_mktsegment AS org FROM customer")
def src_vcf(t):
    card = F.concat(F.lit("BEGIN:VCARD\r\nUID:uid-"), F.col("c_custkey").cast("string"), F.lit("\r\nFN:"), F.substring("c_name", 1, 5), F.lit("\r\n "), F.expr("substring(c_name, 6)"), F.lit("\r\nitem1.ORG;type=work:"), F.col("c_mktsegment"), F.lit("\r\nEND:VCARD"))
    read = readers.cards(t.spark, _lines(t.customer.select(card.alias("value")), _folder(t), "\r\n"))
    org = F.get(F.filter("fields", lambda f: f["label"] == "ORG"), F.lit(0))["value"]
    return read.select("uid", "name", F.size("fields").alias("n_fields"), org.alias("org"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'text' ELSE 'call' END AS kind, '+' || o_custkey AS address, o_orderkey AS at_ms, o_orderkey % 3 = 0 AS outgoing, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE (o_orderkey % 50)::VARCHAR || ' s' END AS body FROM orders")
def src_sms_xml(t):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "2").otherwise("1")
    head = lambda tag, name: F.concat(F.lit(f'<{tag} {name}="+'), F.col("o_custkey").cast("string"), F.lit('" date="'), k.cast("string"), F.lit('" type="'), kind, F.lit('" contact_name="A" '))
    line = F.when(k % 2 == 0, F.concat(head("sms", "address"), F.lit('body="'), F.col("o_orderpriority"), F.lit('"/>'))).otherwise(F.concat(head("call", "number"), F.lit('duration="'), (k % 50).cast("string"), F.lit('"/>')))
    path = _bucketed(t, t.orders.select(F.floor(k / 500).alias("bucket"), line.alias("line")), "<smses>", "</smses>")
    return readers.sms_backup(t.spark, path).select("kind", "address", "at_ms", "outgoing", "body")


@query("SELECT c_custkey::VARCHAR AS id, c_name || ', \"' || c_mktsegment || '\"' || chr(10) || 'more' AS \"Note\", c_mktsegment AS \"Note_2\" FROM customer")
def src_csv_export(t):
    note = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"\nmore'))
    quoted = F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), quoted, F.lit(","), F.col("c_mktsegment"))
    root = f"{_bucketed(t, t.customer.select(F.floor(F.col('c_custkey') / 500).alias('bucket'), line.alias('line')), 'Key,Note,Note' + chr(10))}/*"
    return readers.csv_export(t.spark, root, "Key").select("id", "Note", "Note_2")


@query("SELECT 'region_' || n_regionkey AS table_name, n_nationkey::VARCHAR AS id, n_name || ', \"' || n_regionkey || '\"' AS \"Name\", CASE WHEN n_regionkey % 2 = 0 THEN 'new' ELSE 'old' END AS \"State\" FROM nation WHERE n_regionkey % 2 = 1 OR n_nationkey % 3 <> 0")
def src_csv_replace(t):
    """Exports with notes before their header; one that comes again replaces its whole table and leaves the others."""
    def exported(rows, state):
        root = _folder(t)
        line = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit(', ""'), F.col("n_regionkey").cast("string"), F.lit(f'""",{state}'))
        lines = F.concat(F.lit("Notes:\n\"When exporting, some rows are missing\"\n\nKey,Name,State\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n"))
        rows.groupBy(F.col("n_regionkey").alias("region")).agg(lines.alias("value")).repartition("region").write.partitionBy("region").text(root)
        return _renamed(t, root, "Region {parent}.csv")

    def read(root, regions):
        tables = []
        for k in regions:  # files of an export
            path = f"{root}/region={k}/Region {k}.csv"
            table = readers.csv_export(t.spark, path, "Key", readers.preamble(t.spark, path, ["Key", "Name"]))
            tables.append(table.select(F.lit(readers.table_name(path)).alias("table_name"), "id", "Name", "State"))
        return reduce(DataFrame.unionByName, tables)

    regions = sorted(r[0] for r in t.region.select("r_regionkey").collect())
    stored = read(exported(t.nation, "old"), regions)
    fresh = read(exported(t.nation.where("n_regionkey % 2 = 0 and n_nationkey % 3 <> 0"), "new"), [k for k in regions if k % 2 == 0])
    return versioned.replace_documents(stored, fresh, "table_name")


@query("SELECT 'space=' || (conv_id // 20) AS space, role AS sender, TIMESTAMP '2024-01-01 10:00:00' + to_minutes(turn) AS at, text FROM conversations")
def src_takeout(t):
    minute = F.expr("timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, turn, 0)")
    message = F.struct(F.struct(F.col("role").alias("name")).alias("creator"), F.concat(F.lit("Monday, "), F.date_format(minute, "MMMM d, y 'at' h:mm:ss a"), F.lit(" UTC")).alias("created_date"), F.col("text"))
    groups = t.conversations.groupBy(F.floor(F.col("conv_id") / 20).alias("space")).agg(F.collect_list(message).alias("messages"))  # a group's folder
    root = _folder(t)
    groups.select("space", F.to_json(F.struct("messages")).alias("value")).repartition("space").write.partitionBy("space").text(root)
    return readers.takeout_messages(t.spark, _renamed(t, root, "messages.json"))


_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
_UUID5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER % 4 + 1)::INTEGER, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(
    f"""
    WITH r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN '0xa' || c_custkey || ':0xb' ELSE c_custkey::VARCHAR END AS key, '2024-01-01T00:00:' || lpad((c_custkey % 60)::VARCHAR, 2, '0') || 'Z' AS date, c_name AS name, c_custkey % 5 + 1 AS rating, c_mktsegment || ' "said"' AS text FROM customer WHERE c_custkey % 7 <> 0),
    u AS (SELECT *, sha1(unhex('{_NAMESPACE.replace("-", "")}') || CAST('maps_review:' || key || ':' || date AS BLOB)) AS h FROM r)
    SELECT {_UUID5} AS id, key, date, name, rating, text FROM u
    """
)
def src_takeout_places(t):
    k = F.col("c_custkey")
    text = k.cast("string")
    url = F.when(k % 7 == 0, "https://maps.example.org/").when(k % 2 == 0, F.concat(F.lit("https://maps.example.org/p/data=!4m2!3m1!1s0xa"), text, F.lit(":0xb!8m"))).otherwise(F.concat(F.lit("https://maps.example.org/?cid="), text))
    date = F.concat(F.lit("2024-01-01T00:00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("Z"))
    properties = F.struct(date.alias("date"), url.alias("google_maps_url"), F.struct(F.col("c_name").alias("name")).alias("location"), (k % 5 + 1).alias("five_star_rating_published"), F.concat("c_mktsegment", F.lit(' "said"')).alias("review_text_published"))
    lines = t.customer.select(F.floor(k / 500).alias("bucket"), F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"))).alias("line"))
    root = _bucketed(t, lines, '{"type": "FeatureCollection", "features": [', "]}", ",\n")
    return takeout.places(t.spark, _renamed(t, root, "Reviews.json"), "Reviews.json", "maps_review", _NAMESPACE).select("id", "key", "date", "name", "rating", "text")


@query("SELECT 'UC' || s_suppkey AS channel_id, 'https://x.org/' || s_suppkey AS url, s_name || ', the \"official\"' AS title FROM supplier")
def src_takeout_subscriptions(t):
    k = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("UC"), k, F.lit(",https://x.org/"), k, F.lit(',"'), F.col("s_name"), F.lit(', the ""official"""'))
    root = _bucketed(t, t.supplier.select(F.floor(F.col("s_suppkey") / 500).alias("bucket"), line.alias("line")), "Channel Id,Channel Url,Channel Title\n")
    return takeout.subscriptions(t.spark, f"{root}/*")


@query("SELECT 'Video ' || event_id AS title, 'https://v.org/' || event_id AS url, CASE WHEN event_id % 2 = 0 THEN event_type END AS channel, date_trunc('second', ts) AS at FROM events WHERE event_id % 9 <> 0")
def src_takeout_history(t):
    k = F.col("event_id").cast("string")
    entry = F.struct(
        F.concat(F.lit("Watched Video "), k).alias("title"), F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("https://v.org/"), k)).alias("titleUrl"), F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.col("event_type").alias("name")))).alias("subtitles"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("time"),
    )
    root = _bucketed(t, t.events.select(F.floor(F.col("event_id") / 500).alias("bucket"), F.to_json(entry).alias("line")), "[", "]", ",\n")
    return readers.takeout_history(t.spark, f"{root}/*")


@query("SELECT 'Ann ' || conv_id AS conversation, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, '2024-01-01T10:' || lpad((turn % 60)::VARCHAR, 2, '0') || ':00.000-05:00' AS at, role = 'user' AS is_me, CASE WHEN role = 'user' THEN 'Me' ELSE 'Ann & Co' END AS name, '+1' || conv_id AS tel, 'line <1>' || chr(10) || 'it''s ' || turn AS body, CASE WHEN turn % 4 = 0 THEN 'pic-' || turn ELSE '' END AS attachments FROM conversations")
def src_takeout_voice(t):
    """Text conversations as HTML files with bare line breaks, one for each conversation."""
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    message = F.concat(
        F.lit('<div class="message"><abbr class="dt" title="2024-01-01T10:'), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(':00.000-05:00">Jan</abbr>: <cite class="sender vcard"><a class="tel" href="tel:+1'), conv,
        F.lit('"><span class="fn">'), F.when(F.col("role") == "user", "Me").otherwise("Ann &amp; Co"), F.lit("</span></a></cite>: <q>line &lt;1&gt;<br>it&#39;s "), turn, F.lit("</q>"),
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit('<div><img src="pic-'), turn, F.lit('" alt="x"/></div>'))).otherwise(""), F.lit("</div>"),
    )
    listed = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), "\n").alias("x"))
    pages = listed.select("conv_id", F.concat(F.lit('<?xml version="1.0" ?><html><body><div class="participants"><a class="tel" href="tel:+0"><span class="fn">All</span></a></div><div class="hChatLog hfeed">'), "x", F.lit("</div></body></html>")).alias("value"))
    root = _folder(t)
    pages.withColumn("file", F.concat(F.lit("Ann "), F.col("conv_id").cast("string"), F.lit(" - Text - 2024.html"))).select("file", "value").repartition(_tasks(t), "file").write.options(**BY_TASKS).partitionBy("file").text(root)
    read = takeout.voice_messages(t.spark, root)
    return read.select("conversation", F.col("place").cast("long").alias("place"), "at", "is_me", "name", "tel", "body", F.array_join("attachments", ",").alias("attachments"))


@query("SELECT n_regionkey || '.' || n_nationkey || '.1' AS locator, 'ed' AS edition, n_name || ' ' || n_regionkey AS text FROM nation")
def src_tei_xml(t):
    text = lambda c: F.col(c).cast("string")
    chapter = F.concat(F.lit('<div subtype="chapter" n="'), text("n_nationkey"), F.lit('"><p>'), F.col("n_name"), F.lit(" </p><p>"), text("n_regionkey"), F.lit("</p></div>"))
    books = t.nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list(chapter), "").alias("x"))
    files = books.select(F.col("n_regionkey").alias("region"), F.concat(F.lit('<TEI><body><div subtype="book" n="'), text("n_regionkey"), F.lit('">'), F.col("x"), F.lit("</div></body></TEI>")).alias("value"))
    root = _folder(t)
    files.repartition("region").write.partitionBy("region").text(root)
    read = tei.editions(t.spark, _renamed(t, root, "ed.xml"))
    return read.select(F.concat_ws(".", "book", "chapter", "section").alias("locator"), "edition", "text")


@query("SELECT 'm-' || o_orderkey AS address, o_orderkey AS at_ms, o_orderkey % 2 = 0 AS outgoing, o_orderpriority || chr(10) || 'more & more' AS body, 'p' || o_orderkey || '.png' AS name, 'image/png' AS content_type, length(o_orderstatus || o_orderkey)::BIGINT AS size, sha256(o_orderstatus || o_orderkey) AS hash FROM orders")
def src_mms(t):
    k = F.col("o_orderkey").cast("string")
    part = lambda *attributes: F.concat(F.lit("<part "), *[x if not isinstance(x, str) else F.lit(x) for x in attributes], F.lit("/>"))
    line = F.concat(
        F.lit('<mms address="m-'), k, F.lit('" date="'), k, F.lit('" msg_box="'), F.when(F.col("o_orderkey") % 2 == 0, "2").otherwise("1"), F.lit('" m_id="null"><parts>'), part('ct="application/smil" text="layout"'),
        part('ct="text/plain" text="', F.col("o_orderpriority"), '"'), part('ct="text/plain" text="more &amp; more"'), part('ct="image/png" name="null" cl="p', k, '.png" data="', F.base64(F.concat("o_orderstatus", k).cast("binary")), '"'), F.lit("</parts></mms>"),
    )
    root = _bucketed(t, t.orders.select(F.floor(F.col("o_orderkey") / 500).alias("bucket"), line.alias("line")), "<smses>", "</smses>")
    messages, attachments = readers.mms_backup(t.spark, root)
    return messages.join(attachments, "id").select("address", "at_ms", "outgoing", "body", "name", "content_type", F.col("size").cast("long").alias("size"), "hash")


@query("SELECT 'f ' || conv_id || '-' || turn || '.txt' AS name, 'application/pdf' AS content_type, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS hash, 0 AS place FROM conversations WHERE turn % 2 = 0")
def src_mbox_attachments(t):
    which = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    head = F.concat(F.lit('From x Mon Jan 1\nFrom: a@example.org\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b0"\n\n--b0\nContent-Type: text/plain\n\nSee it.\n'))
    file = F.concat(F.lit('--b0\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="f '), which, F.lit('.txt"\nContent-Transfer-Encoding: base64\n\n'), F.base64(F.coalesce("text", F.lit("")).cast("binary")), F.lit("\n"))
    mail = F.concat(head, F.when(F.col("turn") % 2 == 0, file).otherwise(""), F.lit("--b0--"))
    return readers.mail_attachments(t.spark, _lines(t.conversations.select(mail.alias("value")), _folder(t))).select("name", "content_type", "size", "hash", "place")


@query("SELECT 'd' || (user_id % 4) AS device, m AS metric, epoch_us(date_trunc('second', ts)) // 1000 AS ts_ms, event_id::DOUBLE + o AS value FROM events, (VALUES ('temperature_f', 0), ('humidity_pct', 1)) v(m, o)")
def src_sensor_csv(t):
    at = F.date_format(F.date_trunc("second", F.col("ts")), "yyyy-MM-dd HH:mm:ss")
    a, b = F.col("event_id").cast("double").cast("string"), (F.col("event_id") + 1).cast("double").cast("string")
    odd = F.col("user_id") % 2 == 1  # every second file has its columns in another order
    line = F.when(odd, F.concat_ws(",", at, a, b)).otherwise(F.concat_ws(",", b, at, a))
    head = F.when(odd, "time,temperature_f,humidity_pct").otherwise("humidity_pct,time,temperature_f")
    name = F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string"), F.lit("-"), F.floor(F.col("event_id") / 500).cast("string"))  # a file holds few readings
    files = t.events.groupBy(name.alias("device"), head.alias("head")).agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    root = _folder(t)
    files.select("device", F.concat_ws("\n", "head", "lines").alias("value")).repartition(_tasks(t), "device").write.options(**BY_TASKS).partitionBy("device").text(root)
    return readers.sensor_csv(t.spark, f"{root}/*", device=r"/device=(d[0-9]+)-[^/]*/[^/]+$")


@query(
    """
    WITH f AS (SELECT r_regionkey AS k, n_nationkey AS n, n_name || chr(10) AS content, 'region=' || r_regionkey || '/nation=' || n_nationkey || '/' AS dir, CASE WHEN n_nationkey % 2 = 0 THEN 'a.txt' ELSE 'a.tmp' END AS name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT dir || name AS path, octet_length(encode(content))::BIGINT AS size, sha256(content) AS hash FROM f WHERE k <> 2 AND (n % 2 = 0 OR k = 1)
    """
)
def src_fs_walk(t):
    """Files of a tree with their hashes, less what ignore files in it leave out: one folder, one ending, and that ending kept in another."""
    root = _folder(t)
    rows = t.nation.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("n_name").alias("value"))
    for name, some in (("a.txt", rows.where("nation % 2 = 0")), ("a.tmp", rows.where("nation % 2 = 1"))):
        some.repartition("nation").write.mode("append").partitionBy("region", "nation").text(root)
        _renamed(t, f"{root}/*", name)
    lines = t.spark.createDataFrame([("*.tmp",), ("region=2/",)], "value string")
    _lines(lines.coalesce(1), f"{root}/top")
    t.spark.createDataFrame([("!*.tmp",)], "value string").coalesce(1).write.text(f"{root}/region=1/own")
    _renamed(t, root, "ignore.txt")
    _renamed(t, f"{root}/region=1", "ignore.txt")
    # Spark writes folders: the lines of `top` and `own` hold for the folders around them
    found = readers.walked(t.spark, root, "ignore.txt", held_by=r"(^|/)(top|own)$")
    return found.where("kept").select("path", "size", "hash")


@query(f"WITH {GRID_SQL} SELECT markdown_uuid, count(*)::INT AS n_rows, min(uuid) AS least FROM grid GROUP BY 1")
def snk_sidecar(t):
    root = _folder(t)
    readers.write_sidecars(chat_grid(t).select("markdown_uuid", "uuid", "kind", "when_ts_utc", "text"), root)
    read = t.spark.read.schema("header struct<markdown_uuid:string,n_rows:int>, rows array<struct<uuid:string>>").json(root)
    return read.select("header.markdown_uuid", "header.n_rows", F.array_min(F.transform("rows", lambda r: r["uuid"])).alias("least"))


@query("SELECT s_suppkey, s_name, 2::BIGINT AS n FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier WHERE s_suppkey % 2 = 1")
def snk_tape(t):
    root = _folder(t)
    rows = t.supplier.select("s_suppkey", "s_name")
    readers.append_tape(rows, root)
    readers.append_tape(rows.where("s_suppkey % 2 = 0"), root)
    return t.spark.read.schema("s_suppkey long, s_name string").json(root).groupBy("s_suppkey", "s_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'customer' AS name, 'c_custkey' AS key, 'stable' AS origin, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'orders', 'o_orderkey', 'stated', (SELECT count(*) FROM orders) UNION ALL SELECT 'lineitem', '', 'none', (SELECT count(*) FROM lineitem)")
def mirror_table(t):
    tables = readers.mirrored({n: getattr(t, n) for n in ("customer", "orders", "lineitem", "region")}, ["*"], ["reg*"], ["customer.c_acct*"])
    keys = {n: readers.mirror_key(d, ["o_orderkey"] if n == "orders" else [], ["c_mktsegment", "c_custkey", "l_orderkey"]) for n, d in tables.items()}
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), F.lit(",".join(keys[n][0])).alias("key"), F.lit(keys[n][1]).alias("origin"), "n") for n, d in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey, c_name AS customer FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 6 <> 0) ON o_custkey = c_custkey")
def mirror_wa(t):
    names = t.customer.where("c_custkey % 6 <> 0").select("c_custkey", "c_name")
    return readers.with_natural_keys(t.orders.select("o_orderkey", "o_custkey"), names, {"o_custkey": "customer"}, "c_custkey", "c_name")
