"""Queries of editions, outlines, attachments, ignore lines, resumed series, times, SQL functions, exploration and durable streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mnemora.durable import cut, shared_dir
from mnemora.functions import registered, times
from mnemora.operators import attachments, explore, ignore, outline, resume
from mnemora.plans.registry import query
from mnemora.plans.views import READINGS_SQL, readings
from mnemora.sources import tei
from mnemora.streaming import buckets, events


def _folder(t) -> str:
    return f"{shared_dir(t.spark)}/mnemora-source-{uuid.uuid4().hex}"


# ---- editions


@query(
    """
    WITH s AS (SELECT s_suppkey // 40 + 1 AS book, s_suppkey % 40 // 8 + 1 AS chapter, s_suppkey % 8 + 1 AS section, s_name AS name, s_suppkey AS k FROM supplier)
    SELECT book::VARCHAR AS book, chapter::VARCHAR AS chapter, section::VARCHAR AS section,
           'x-grc2: ' || name || ' says ' || k || ' & more' || CASE WHEN k % 3 = 0 THEN '' ELSE '|x-eng1: ' || name || ' in English' END AS texts,
           row_number() OVER (ORDER BY book, chapter, section) - 1 AS place
    FROM s
    """
)
def src_tei_editions(t):
    """Nested books, chapters and sections in files of two editions, united by locator."""
    root = _folder(t)
    k = F.col("s_suppkey")
    at = [(F.floor(k / 40) + 1).cast("string").alias("book"), (F.floor(k % 40 / 8) + 1).cast("string").alias("chapter"), (k % 8 + 1).cast("string").alias("section")]
    texts = {
        "x-grc2": F.concat(F.lit("<p>"), F.col("s_name"), F.lit("\n  <q>says <hi>"), k.cast("string"), F.lit("</hi></q> &amp; <![CDATA[more]]></p>")),
        "x-eng1": F.concat(F.lit("<p>"), F.col("s_name"), F.lit(" in</p><note> </note><p>English</p>")),
    }
    for edition, text in texts.items():
        rows = t.supplier.where("s_suppkey % 3 <> 0") if edition == "x-eng1" else t.supplier
        inner = rows.select(*at, text.alias("text")).groupBy("book", "chapter").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<div type="textpart" subtype="section" n="'), F.col("section"), F.lit('">'), F.col("text"), F.lit("</div>")))), "\n").alias("x"))
        wrap = lambda kind, n, x: F.concat(F.lit(f'<div subtype="{kind}" n="'), n, F.lit('">'), x, F.lit("</div>"))
        whole = inner.groupBy("book").agg(F.array_join(F.collect_list(wrap("chapter", F.col("chapter"), F.col("x"))), "\n").alias("x"))
        head = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><div subtype="section" n="9">no text</div></teiHeader><text><body><div type="edition"><head>Title</head><div subtype="book" n="front"><div subtype="chapter" n="1">Preface</div></div>'
        files = whole.select("book", F.concat(F.lit(head), wrap("book", F.col("book"), F.col("x")), F.lit("</div></body></text></TEI>")).alias("value"))
        files.repartition("book").write.partitionBy("book").text(f"{root}/{edition}")  # a file for each book
    united = tei.united(tei.editions(t.spark, root, edition=r"/(x-[a-z0-9]+)/book="))
    ordered = tei.in_order(united.select("book", "chapter", "section", F.array_join(F.transform("texts", lambda x: F.concat(x["edition"], F.lit(": "), x["text"])), "|").alias("texts")))
    book, chapter, section = (F.col(c).cast("long") for c in ("book", "chapter", "section"))
    place = (book - 1) * 40 + (chapter - 1) * 8 + section - 1  # what the numbers of the locators say; the driver table has every one from the first
    return ordered.select("book", "chapter", "section", "texts", (place - t.supplier.agg(F.min("s_suppkey")).first()[0]).alias("place"))


@query("SELECT 'ed' AS edition, s_suppkey::VARCHAR AS book, '2' AS chapter, '1' AS section, s_name || ' one quoted tail' AS text FROM supplier")
def fn_tei_sql(t):
    """The same divisions by a table function in SQL alone."""
    registered.register(t.spark)
    t.supplier.createOrReplaceTempView("mn_supplier")
    return t.spark.sql(
        """
        SELECT 'ed' AS edition, s.book, s.chapter, s.section, s.text
        FROM mn_supplier, LATERAL mn_tei(concat('<TEI><body><div subtype="book" n="', s_suppkey, '"><div subtype="chapter" n="2"><p>', s_name, '</p><p> one <q>quoted</q> tail</p></div></div></body></TEI>')) s
        """
    )


# ---- outlines


_BLOCKS = """
blocks AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 20 THEN NULL WHEN p_partkey % 50 = 0 THEN -1 ELSE p_partkey // 3 END AS parent, p_size AS place, CASE WHEN p_partkey % 4 < 2 THEN 'numbered' ELSE 'text' END AS kind FROM part)
"""


def _blocks(t):
    k = F.col("p_partkey")
    parent = F.when(k < 20, None).when(k % 50 == 0, -1).otherwise(F.floor(k / 3))
    return t.part.select(k.alias("id"), parent.cast("long").alias("parent"), F.col("p_size").cast("long").alias("place"), F.when(k % 4 < 2, "numbered").otherwise("text").alias("kind"))


@query(
    f"""
    WITH RECURSIVE {_BLOCKS},
    r AS (SELECT id, id AS root, 0 AS depth, [place, id] AS path FROM blocks WHERE parent IS NULL OR parent NOT IN (SELECT id FROM blocks)
          UNION ALL SELECT b.id, r.root, r.depth + 1, list_concat(r.path, [b.place, b.id]) FROM blocks b JOIN r ON b.parent = r.id)
    SELECT id, root, depth, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS position FROM r
    """
)
def d_notion_tree_render(t):
    """Blocks of pages in the order of reading, with their depth."""
    # ids take part in paths as texts; padded, they sort as the numbers do
    blocks = _blocks(t).select(F.lpad(F.col("id").cast("string"), 12, "0").alias("id"), F.lpad(F.col("parent").cast("string"), 12, "0").alias("parent"), "place")
    return outline.read_order(blocks).select(F.col("id").cast("long").alias("id"), F.col("root").cast("long").alias("root"), "depth", F.col("position").cast("long").alias("position"))


@query(
    f"""
    WITH {_BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY place, id) - sum((kind = 'numbered')::INT) OVER (PARTITION BY parent ORDER BY place, id) AS run FROM blocks)
    SELECT id, kind, CASE WHEN kind = 'numbered' THEN row_number() OVER (PARTITION BY parent, kind, run ORDER BY place, id) END AS number FROM o
    """
)
def d_list_numbers(t):
    """Numbers of list items, beginning anew after another kind of block."""
    return outline.numbered(_blocks(t)).select("id", "kind", F.col("number").cast("long").alias("number"))


# ---- files


@query(
    """
    WITH f AS (SELECT p_partkey % 7 AS folder, p_partkey AS k, 'photo ' || p_name || ' ' || p_partkey AS stem, CASE WHEN p_partkey % 2 = 0 THEN 'JPG' ELSE 'txt' END AS ext FROM part),
    files AS (
      SELECT folder, stem || '.' || ext AS name FROM f WHERE k % 4 = 0 UNION SELECT folder, substr(stem, 1, 12) || '.' || lower(ext) FROM f WHERE k % 4 = 1
      UNION SELECT folder, substr(stem, 1, 9) || '.' || ext FROM f WHERE k % 4 = 2 UNION SELECT folder, substr(stem, 1, 9) || '.' || lower(ext) FROM f WHERE k % 8 = 2),
    r AS (SELECT folder, k, stem || '.' || ext AS name, stem, lower(ext) AS ext FROM f),
    p AS (SELECT folder, name AS file, regexp_extract(name, '^(.+)\\.[^.]*$', 1) AS stem, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM files),
    c AS (SELECT r.k, p.file, length(p.stem) AS n FROM r JOIN p ON r.folder = p.folder AND r.ext = p.ext AND starts_with(r.stem, p.stem)),
    b AS (SELECT k, min(file) AS file, count(*) AS n FROM c WHERE n = (SELECT max(n) FROM c d WHERE d.k = c.k) GROUP BY 1),
    e AS (SELECT r.k, f2.name FROM r JOIN files f2 ON r.folder = f2.folder AND r.name = f2.name)
    SELECT r.k, CASE WHEN e.name IS NOT NULL THEN 'exact' WHEN b.n = 1 THEN 'truncated' ELSE 'missing' END AS how, CASE WHEN e.name IS NOT NULL THEN e.name WHEN b.n = 1 THEN b.file END AS found
    FROM r LEFT JOIN e USING (k) LEFT JOIN b USING (k)
    """
)
def src_takeout_attachments(t):
    """Files of an export whose names were cut short, found for the full names that messages state."""
    k = F.col("p_partkey")
    stem, ext = F.concat(F.lit("photo "), F.col("p_name"), F.lit(" "), k.cast("string")), F.when(k % 2 == 0, "JPG").otherwise("txt")
    rows = t.part.select((k % 7).alias("folder"), k.alias("k"), stem.alias("stem"), ext.alias("ext"))
    named = lambda part, n, end: rows.where(part).select("folder", F.concat(F.substring("stem", 1, n) if n else F.col("stem"), F.lit("."), end).alias("name"))
    files = named("k % 4 = 0", None, F.col("ext")).unionByName(named("k % 4 = 1", 12, F.lower("ext"))).unionByName(named("k % 4 = 2", 9, F.col("ext"))).unionByName(named("k % 8 = 2", 9, F.lower("ext")))
    references = rows.select("folder", "k", F.concat("stem", F.lit("."), F.col("ext")).alias("name"))
    return attachments.resolved(references, files).select("k", "how", "found")


_PATHS = "n AS (SELECT p_partkey AS k, p_type AS a, CASE WHEN p_partkey % 5 < 3 THEN 'POLISHED' ELSE 'PLATED' END AS b, CASE WHEN p_partkey % 2 = 0 THEN 'TIN' ELSE 'STEEL' END AS c, p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.tmp' ELSE '.txt' END AS name FROM part)"


@query(
    f"""
    WITH {_PATHS}, d AS (
      SELECT a || '/' || b || '/' || c || '/' || name AS path,
        CASE WHEN a = 'PROMO' THEN 'PROMO/' WHEN a = 'ECONOMY' AND c = 'TIN' THEN '/ECONOMY/*/TIN'
             WHEN a = 'STANDARD' AND b = 'POLISHED' AND name LIKE '%7.%' THEN '*7.*' WHEN a = 'STANDARD' AND name LIKE '5%.tmp' THEN NULL WHEN name LIKE '%.tmp' THEN '*.tmp' END AS pattern,
        a, b, c FROM n)
    SELECT path, pattern IS NULL AS kept, pattern, CASE WHEN pattern = 'PROMO/' THEN a WHEN pattern = '/ECONOMY/*/TIN' THEN a || '/' || b || '/' || c WHEN pattern IS NOT NULL THEN path END AS at FROM d
    """
)
def src_fs_ignore(t):
    """Files below a tree with ignore lines at three levels."""
    k = F.col("p_partkey")
    parts = F.array("p_type", F.when(k % 5 < 3, "POLISHED").otherwise("PLATED"), F.when(k % 2 == 0, "TIN").otherwise("STEEL"))
    directory = F.array_join(parts, "/")
    files = t.part.select(F.concat(directory, F.lit("/"), k.cast("string"), F.when(k % 3 == 0, ".tmp").otherwise(".txt")).alias("path"), F.lit(False).alias("is_dir"))
    directories = t.part.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    frames = t.spark.createDataFrame([("", ["# lines of the root", "*.tmp", "PROMO/", "/ECONOMY/*/TIN"]), ("STANDARD", ["!5*.tmp"]), ("STANDARD/POLISHED", ["*7.*"])], "directory string, patterns array<string>")
    return ignore.ignored(files.unionByName(directories), frames).where("not is_dir").select("path", "kept", "pattern", "at")


# ---- series fetched anew

_SIZE, _STRIDE, _NOW, _BUDGET = 6 * 3_600_000, 4 * 3_600_000, 1_706_745_600_000, 3
_CURSORS = f"cursors AS (SELECT device, greatest(min(ts_ms) - 3600000, 1704067200000) AS cursor FROM readings GROUP BY 1), w AS (SELECT device, (s - cursor) // {_STRIDE} AS n, s AS start, least(s + {_SIZE}, {_NOW}) AS end_ FROM cursors, LATERAL (SELECT unnest(range(cursor, {_NOW}, {_STRIDE})) AS s)), l AS (SELECT device, n FROM w WHERE (n % 11 IN (4, 5)) OR (length(device) % 2 = 0 AND n IN (29, 30, 31, 32)))"


@query(
    f"""
    WITH {READINGS_SQL}, {_CURSORS}, i AS (SELECT device, n, n - row_number() OVER (PARTITION BY device ORDER BY n) AS island FROM l),
    e AS (SELECT device, min(low) + {_BUDGET - 1} AS last FROM (SELECT device, min(n) AS low, count(*) AS run FROM i GROUP BY device, island) WHERE run >= {_BUDGET} GROUP BY 1),
    m AS (SELECT w.*, CASE WHEN n > last THEN 'not tried' WHEN l.device IS NOT NULL THEN 'failed' ELSE 'fetched' END AS state FROM w LEFT JOIN l USING (device, n) LEFT JOIN e USING (device)),
    g AS (SELECT m.device, count(*) AS given, count(DISTINCT event_id) AS stored FROM m JOIN readings r ON r.device = m.device AND r.ts_ms >= m.start AND r.ts_ms < m.end_ WHERE state = 'fetched' GROUP BY 1)
    SELECT device, count(*) AS windows, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'not tried') AS not_tried, coalesce(any_value(given), 0) AS given, coalesce(any_value(stored), 0) AS stored
    FROM m LEFT JOIN g USING (device) GROUP BY 1
    """
)
def resume_windows(t):
    """Windows of a resumed series, those that failed or were given up, and what the others gave once and twice."""
    r = readings(t)
    cursors = cut(r.groupBy("device").agg(resume.start(F.min("ts_ms"), F.lit(1_704_067_200_000), 3_600_000)["cursor"].alias("cursor")))
    planned = resume.windows(cursors, _SIZE, _STRIDE, _NOW)
    failed = planned.where("n % 11 in (4, 5) or (length(device) % 2 = 0 and n in (29, 30, 31, 32))")
    states = cut(resume.given_up(planned, failed, _BUDGET))
    given = resume.fetched(r, states.where("state = 'fetched'"), _SIZE, _STRIDE, cursors)
    events_given = given.repartition("device").groupBy("device", "event_id").agg(F.count(F.lit(1)).alias("m"))  # each stored once, given m times
    counts = events_given.groupBy("device").agg(F.sum("m").alias("given"), F.count(F.lit(1)).alias("stored"))
    own = states.groupBy("device").agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed"), F.count(F.when(F.col("state") == "not tried", 1)).alias("not_tried"))
    return own.join(counts, "device", "left").select("device", "windows", "failed", "not_tried", F.coalesce("given", F.lit(0)).alias("given"), F.coalesce("stored", F.lit(0)).alias("stored"))


@query("SELECT (to_timestamp(s * 3600))::TIMESTAMP AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(range((epoch_us(ts) // 3600000000) - 5, (epoch_us(ts) // 3600000000) + 1)) AS s FROM events) WHERE s % 2 = 0 GROUP BY 1, 2")
def st_sliding(t):
    """Counts of a stream in windows of six hours, every two."""
    stream = events.read(t.spark, t.sf_dir).withWatermark("at", "1 day")
    counted = stream.groupBy(F.window("at", "6 hours", "2 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return events.run_once(counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "complete")


@query(
    """
    WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS bucket, event_id % 5 = 0 AND day(ts) % 2 = 0 AS late FROM events),
    l AS (SELECT bucket, user_id, event_id, row_number() OVER (PARTITION BY bucket, user_id ORDER BY ts DESC, event_id DESC) AS r FROM e)
    SELECT bucket, any_value(v) AS version, count(*) AS n, sum(event_id)::BIGINT AS total, any_value(made) AS times_made
    FROM l JOIN (SELECT bucket, max(late::INT)::BIGINT AS v, count(DISTINCT late) AS made FROM e GROUP BY 1) USING (bucket) WHERE r = 1 GROUP BY 1
    """
)
def st_late_buckets(t):
    """A stream that stops and starts anew: late rows make their own day anew, and no other."""
    root = _folder(t)
    late = F.expr("event_id % 5 = 0 and day(ts) % 2 = 0")
    schema = t.events.schema

    def arrive(rows):
        rows.write.mode("append").parquet(f"{root}/arriving")
        stream = t.spark.readStream.schema(schema).parquet(f"{root}/arriving")
        buckets.keep(stream, f"{root}/kept", F.date_format("ts", "yyyy-MM-dd"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).awaitTermination()

    arrive(t.events.where(~late))
    arrive(t.events.where(late))
    made = buckets.changed(t.spark, f"{root}/kept", schema).groupBy("bucket").agg(F.count(F.lit(1)).alias("times_made"))
    rows = buckets.current(t.spark, f"{root}/kept", schema)
    return rows.groupBy("bucket").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total")).join(made, "bucket")


# ---- times

_ZONES = "z AS (SELECT o_orderkey AS k, o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS local, [0, 330, -420, 765, -30][o_orderkey % 5 + 1] AS m, ['+00:00', '+05:30', '-07:00', '+12:45', '-00:30'][o_orderkey % 5 + 1] AS off FROM orders)"


def _zoned(t):
    k = F.col("o_orderkey")
    local = F.date_format(F.expr("cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, 0, 0, o_orderkey % 86400)"), "yyyy-MM-dd'T'HH:mm:ss")
    off = F.element_at(F.array(*map(F.lit, ["+00:00", "+05:30", "-07:00", "+12:45", "-00:30"])), (k % 5 + 1).cast("int"))
    return t.orders.select(k.alias("k"), local.alias("local"), off.alias("off"))


@query(
    f"""
    WITH {_ZONES} SELECT k, strftime(local - to_minutes(m), '%Y-%m-%dT%H:%M:%S') || '.250000Z' AS utc, off AS utc_offset,
    strftime(local, '%Y-%m-%dT%H:%M:%S') || off AS coerced, epoch_us(local - to_minutes(m)) AS micros, strftime(local + to_microseconds(250007), '%Y-%m-%dT%H:%M:%S.%f') || off AS bumped FROM z
    """
)
def fn_times(t):
    """Times of several zones split, spelled out, parsed by a format and moved."""
    rows = _zoned(t)
    strict = F.concat("local", F.lit(".25"), F.when(F.col("off") == "+00:00", "Z").otherwise(F.col("off")))
    basic = F.concat(F.regexp_replace("local", "[-:]", ""), F.when(F.col("off") == "+00:00", "Z").otherwise(F.regexp_replace("off", ":", "")))
    written = F.concat(F.date_format(F.col("local").cast("timestamp_ntz"), "dd MMM yyyy hh:mm:ss a "), F.regexp_replace("off", ":", ""))
    split = times.split_when(strict)
    return rows.select("k", split["utc"].alias("utc"), split["offset"].alias("utc_offset"), times.coerce_when(basic).alias("coerced"), times.strptime(written, "%d %b %Y %I:%M:%S %p %z")["micros"].alias("micros"), times.bump_micros(strict, F.lit(7)).alias("bumped"))


# ---- SQL functions and exploration


@query("SELECT conv_id, turn, upper(role) AS who, turn * 2 AS n FROM conversations WHERE turn % 4 <> 3")
def fn_shred_sql(t):
    """Payloads shredded by a table function whose schema its argument states."""
    registered.register(t.spark)
    t.conversations.createOrReplaceTempView("mn_conversations")
    payload = """CASE WHEN turn % 4 = 3 THEN '{bad' ELSE to_json(named_struct('who', upper(role), 'n', turn * 2, 'more', array(1))) END"""
    return t.spark.sql(f"SELECT conv_id, turn, s.who, s.n FROM mn_conversations, LATERAL mn_shred({payload}, 'who string, n bigint') s")


@query("SELECT page_id, regexp_replace(lower(url), '[_-]+', '-', 'g') AS path, CASE WHEN length(url) > 12 THEN substr(url, 1, 12) || '…' ELSE url END AS short, len(list_filter(regexp_split_to_array(lower(url), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS n_terms FROM pages")
def fn_scalars_sql(t):
    """Scalar functions called from SQL."""
    registered.register(t.spark)
    t.pages.createOrReplaceTempView("mn_pages")
    return t.spark.sql("SELECT page_id, mn_norm_path(url) AS path, mn_first_chars(url, 12) AS short, size(mn_terms(url)) AS n_terms FROM mn_pages")


def _graph(t) -> explore.Graph:
    tables = {n: getattr(t, n) for n in ("lineitem", "orders", "customer", "nation")}
    return explore.Graph(tables, {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey"}, {("lineitem", "l_orderkey"): "orders", ("orders", "o_custkey"): "customer", ("customer", "c_nationkey"): "nation"})


@query("SELECT n_name AS l_orderkey_o_custkey_c_nationkey_n_name, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F' GROUP BY 1")
def x_group_linked(t):
    """Rows filtered by their own and a linked property, grouped by one three links away."""
    walk = _graph(t).start("lineitem").where("l_returnflag", lambda c: c == "R").where("l_orderkey.o_orderstatus", lambda c: c == "F")
    return walk.group("l_orderkey.o_custkey.c_nationkey.n_name", n="count", quantity=("total", "l_quantity")).sort("-n").rows


@query("SELECT c_custkey AS customer, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45))")
def x_follow(t):
    """What rows refer to, in two steps, each once."""
    return _graph(t).start("lineitem").where("l_quantity", lambda c: c > 45).follow("l_orderkey").follow("o_custkey").pick(customer="c_custkey", nation="c_nationkey.n_name")


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def x_back(t):
    """The rows that refer to the rows at hand."""
    return _graph(t).start("customer").where("c_mktsegment", lambda c: c == "BUILDING").back("orders", "o_custkey").pick(k="o_orderkey", price="o_totalprice")
