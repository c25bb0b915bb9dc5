import uuid
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.functions import columns as C
from mnemora.operators import align, files, flows, retrieval, timeseries, versioned
from mnemora.operators.search import Filters, predicates, time_bound, uuid_value
from mnemora.sources import readers
from mnemora.streaming import events as stream

UUID = "00000001-1701-4d00-8000-000000000001"


def test_uuid_values():
    assert uuid_value("author", f"picard-jean-luc-{UUID}") == UUID
    assert uuid_value("author", UUID) == UUID
    assert uuid_value("author", "plain-name") == "plain-name"
    assert uuid_value("kind", f"x-{UUID}") == f"x-{UUID}"
    assert uuid_value("convo", f"x{UUID}") == f"x{UUID}"


@pytest.mark.parametrize(
    "value, zone, want",
    [
        ("2024-03-01", "UTC", datetime(2024, 3, 1)),
        ("2024-03-01", "Europe/Berlin", datetime(2024, 2, 29, 23)),
        ("2024-07-01T10:00:00+02:00", "UTC", datetime(2024, 7, 1, 8)),
        ("2024-07-01T10:00:00Z", "America/New_York", datetime(2024, 7, 1, 10)),
        ("soon", "UTC", None),
    ],
)
def test_time_bounds(value, zone, want):
    assert time_bound(value, zone) == want


def test_free_text_means_messages(spark):
    assert len(predicates(Filters(text="x"))) == 2
    assert len(predicates(Filters())) == 0
    assert len(predicates(Filters(text="x", rows="all"))) == 1


def test_since():
    now = datetime(2024, 5, 1, tzinfo=timezone.utc)
    assert versioned.since("c", 30, now, full=True) is None
    assert versioned.since(None, 0, now) is None
    assert versioned.since(None, 30, now) == "2024-04-01T00:00:00+00:00"
    assert versioned.since("2024-04-20", 30, now) == "2024-04-20"
    assert versioned.since("2024-04-20", 30, now, widened=True) == "2024-04-01T00:00:00+00:00"
    assert versioned.since("2024-03-20", 30, now, widened=True) == "2024-03-20"


def test_uuid5_is_the_standard(spark):
    names = ["", "a", "Äöü", "x" * 300]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", C.uuid5(str(uuid.NAMESPACE_DNS), F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in rows} == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}


def test_periods_before_1970(spark):
    row = spark.createDataFrame([(-1,)], "ms long").select(C.period_key(F.col("ms"), "month"), C.period_key(F.col("ms"), "year"), C.period_key(F.col("ms"), "all")).first()
    assert tuple(row) == ("1969-12", "1969", "all")


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "id long, v string, w string")
    once = versioned.upsert(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", None), (2, None, "y"), (3, "c", None)]
    assert sorted(map(tuple, versioned.upsert(once, new, ["id"]).collect())) == sorted(map(tuple, once.collect()))
    kept = versioned.upsert(old, new, ["id"], ("v",))
    assert {r.id: r.v for r in kept.collect()} == {1: "a", 2: "b", 3: "c"}


def test_diff_of_equal_versions_is_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, "b")], "id long, v string")
    assert versioned.diff(rows, rows, ["id"]).count() == 0
    assert versioned.diff_stat(rows, rows, ["id"]).first()["rows_unmodified"] == 2


def test_fan_out_change_means_all(spark):
    some = spark.createDataFrame([(1, "added")], "id long, diff_type string")
    none = some.limit(0)
    assert versioned.changed_buckets({"users": some, "items": some}, {"users"}, {"items": F.col("id")}) is None
    assert [r.bucket for r in versioned.changed_buckets({"users": none, "items": some}, {"users"}, {"items": F.col("id")}).collect()] == [1]


def test_merkle_and_paths(spark):
    tree = spark.createDataFrame([("r/a/x", "1"), ("r/a/y", "2"), ("r/z", "3")], "path string, hash string")
    got = {r.path: r.hash for r in files.merkle(tree).collect()}
    import hashlib

    a = hashlib.sha256(b"x\0F1\ny\0F2\n").hexdigest()
    assert got == {"r/a": a, "r": hashlib.sha256(f"a\0D{a}\nz\0F3\n".encode()).hexdigest()}
    nodes = spark.createDataFrame([(1, None, "A"), (2, 1, "B"), (3, 2, "C"), (8, 9, "loop"), (9, 8, "loop")], "id long, parent_id long, name string")
    assert {r.id: r.path for r in files.tree_paths(nodes, F.col("name")).collect()} == {1: "A", 2: "A/B", 3: "A/B/C"}


def test_owners_of_deep_chains_and_cycles(spark):
    rows = [(0, True, None)] + [(i, False, i - 1) for i in range(1, 100)] + [(200, False, 201), (201, False, 200)]
    got = {r.id: r.owner for r in flows.owners(spark.createDataFrame(rows, "id long, is_page boolean, parent_id long")).collect()}
    assert all(got[i] == 0 for i in range(100)) and got[200] is None and got[201] is None


@pytest.mark.parametrize(
    "body, own",
    [
        ("hello", "hello"),
        ("hello\nOn Mon, A wrote:\n> x", "hello"),
        ("salut\nLe lundi, A a écrit :\n> x\n> y", "salut"),
        ("fresh\n> a\n> b", "fresh"),
        ("fresh\n> only one", "fresh\n> only one"),
        ("> a\n> b", "> a\n> b"),
        ("x\n> a\n> b\ntail", "x\n> a\n> b\ntail"),
        ("top\n-----Original Message-----\nold", "top"),
    ],
)
def test_split_quoted(spark, body, own):
    assert spark.createDataFrame([(body,)], "b string").select(flows.split_quoted(F.col("b"))).first()[0] == own


def test_alignment_finds_the_cheapest_groups():
    a, b = np.eye(4)[:3], np.eye(4)[[0, 1, 1, 2]]
    ones = np.ones(4)
    found = align.groups(a, b, ones[:3] * 10, ones * 10)
    assert [(list(x), list(y)) for x, y in found] == [([0], [0]), ([1], [1, 2]), ([2], [3])]
    assert align.groups(a, b[:0], ones, ones) == []
    far = align.groups(np.eye(9)[:1], np.eye(9)[:8], np.ones(1), np.ones(8))
    assert [(list(x), list(y)) for x, y in far] == [([0], list(range(8)))]


def test_unknown_metric_is_an_error(spark):
    readings = spark.createDataFrame([("d", "temperature_f", 0, 212.0)], "device string, metric string, ts_ms long, value double")
    assert abs(timeseries.to_si(readings).first()["value"] - 100) < 1e-9
    with pytest.raises(Exception, match="no unit for metric"):
        timeseries.to_si(readings.withColumn("metric", F.lit("bogus"))).collect()


def test_sections_before_the_first_anchor(spark):
    anchors = spark.createDataFrame([("d", 5, "a"), ("d", 9, "b")], "doc string, anchor_line long, uuid string")
    hits = spark.createDataFrame([("d", 1), ("d", 5), ("d", 8), ("d", 20), ("e", 3)], "doc string, line long")
    assert {(r.doc, r.line): r.section for r in retrieval.sections(hits, anchors).collect()} == {("d", 1): "a", ("d", 5): "a", ("d", 8): "a", ("d", 20): "b", ("e", 3): None}


def test_json_events_keep_first_seen_order(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"b","v":1}\n{"id":"a","v":1}\n')
    (tmp_path / "u.jsonl").write_text('{"id":"a","v":2}\n{"id":"c","v":1}\n')
    got = readers.jsonl_latest(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "u.jsonl"), ["id"], "id string, v long").collect()
    assert [(r.id, r.v) for r in got] == [("b", 1), ("a", 2), ("c", 1)]
    (tmp_path / "u.jsonl").write_text('{"v":2}\n')
    with pytest.raises(Exception, match="record without id"):
        readers.jsonl_latest(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "u.jsonl"), ["id"], "id string, v long").collect()


def test_csv_sms_mail_and_cards(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Notes:\n"about"\n\nFirst,URL,URL\nA,u1,"v,1"\nB,u2,v2\n')
    rows = readers.csv_export(spark, str(tmp_path / "x.csv"), preamble_lines=3).collect()
    assert [(r.First, r.URL, r.URL_2) for r in rows] == [("A", "u1", "v,1"), ("B", "u2", "v2")] and len({r.id for r in rows}) == 2
    (tmp_path / "s.xml").write_text('<smses><sms address="+1" date="1000" type="2" body="hi" contact_name="A"/><call number="+1" date="2000" type="1" duration="5" contact_name="A"/></smses>')
    got = readers.sms_backup(spark, str(tmp_path / "s.xml")).orderBy("at_ms").collect()
    assert [(r.kind, r.address, r.outgoing, r.body) for r in got] == [("text", "+1", True, "hi"), ("call", "+1", False, "5 s")]
    (tmp_path / "m.mbox").write_text('From a@x Mon\nFrom: a@x\nSubject: One\nX-Gmail-Labels: Inbox,"A, B"\n\nbody\n>From here\n\nFrom b@x Tue\nFrom: b@x\nSubject: Two\n\nsecond\n')
    mails = readers.mailbox(spark, str(tmp_path / "m.mbox")).orderBy("position").collect()
    assert [m.subject for m in mails] == ["One", "Two"] and mails[0].labels == ["Inbox", "A, B"] and "From here" in mails[0].body and ">From" not in mails[0].body
    (tmp_path / "c.vcf").write_text("BEGIN:VCARD\r\nUID:1\r\nFN:Ann\r\n Lee\r\nTEL;TYPE=cell:+1\r\nEND:VCARD\r\nBEGIN:VCARD\r\nFN:Bob\r\nEND:VCARD\r\n")
    found = readers.cards(spark, str(tmp_path / "c.vcf")).orderBy("position").collect()
    assert [(r.uid, r.name) for r in found] == [("1", "AnnLee"), (None, "Bob")] and found[0].fields[2].label == "TEL"


def test_sensor_csv_and_file_tree(spark, tmp_path):
    (tmp_path / "porch.csv").write_text("time,temperature_f,humidity_pct\n2024-01-01 00:00:00,50,40\n2024-01-01 00:05:00,,41\n")
    assert readers.sensor_csv(spark, str(tmp_path / "porch.csv")).count() == 3
    (tmp_path / "bad.csv").write_text("time,temperature_f,temperature_c\n2024-01-01 00:00:00,1,2\n")
    with pytest.raises(Exception, match="two units"):
        readers.sensor_csv(spark, str(tmp_path / "bad.csv")).collect()
    tree = readers.file_tree(spark, str(tmp_path), ignore="bad").collect()
    assert len(tree) == 1 and tree[0].size > 0


def test_stream_sessions_and_dedup(spark, sf_dir):
    rows = stream.run_once(stream.sessions(stream.read(spark, sf_dir), "12 hours"), "complete")
    assert rows.selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert stream.run_once(stream.deduplicated(stream.read(spark, sf_dir), "event_id")).count() == rows.selectExpr("sum(n)").first()[0]


def test_deep_trees(spark):
    """80 levels: every directory has a hash, every node its path and its owner."""
    import hashlib

    path = "/".join(f"d{k}" for k in range(80))
    got = {r.path: r.hash for r in files.merkle(spark.createDataFrame([(f"{path}/x", "1")], "path string, hash string")).collect()}
    name, tag, want = "x", "F", "1"
    for k in range(79, -1, -1):
        want, tag = hashlib.sha256(f"{name}\0{tag}{want}\n".encode()).hexdigest(), "D"
        name = f"d{k}"
    assert len(got) == 80 and got["d0"] == want
    rows = [(0, None, "n0")] + [(k, k - 1, f"n{k}") for k in range(1, 80)] + [(900, 901, "a"), (901, 900, "b"), (902, 777, "c")]
    paths = {r.id: r.path for r in files.tree_paths(spark.createDataFrame(rows, "id long, parent_id long, name string"), F.col("name")).collect()}
    assert len(paths) == 80 and paths[79].count("/") == 79 and paths[2] == "n0/n1/n2"
    blocks = spark.createDataFrame([(k, k == 0, p) for k, p, _ in rows], "id long, is_page boolean, parent_id long")
    owned = {r.id: r.owner for r in flows.owners(blocks).collect()}
    assert all(owned[k] == 0 for k in range(80)) and owned[900] is None and owned[902] is None


def test_alignment_is_the_cheapest_of_all():
    r = np.random.default_rng(5)

    def every(m, n):
        if not m and not n:
            yield []
        for p, q in align.MOVES:
            if m >= p and n >= q:
                for head in every(m - p, n - q):
                    yield [*head, (range(m - p, m), range(n - q, n))]

    def cost(found, a, b, la, lb):
        total = 0.0
        for x, y in found:
            u, v = a[x].mean(0), b[y].mean(0)
            total += 1 - u @ v / np.linalg.norm(u) / np.linalg.norm(v) + align.PENALTY * abs(np.log((la[x].sum() + 1) / (lb[y].sum() + 1)))
        return total

    for m, n in ((1, 3), (3, 3), (4, 5), (5, 4), (2, 6)):
        a, b, la, lb = r.normal(size=(m, 4)), r.normal(size=(n, 4)), r.integers(1, 30, m), r.integers(1, 30, n)
        best = min(cost(f, a, b, la, lb) for f in every(m, n))
        assert abs(cost(align.groups(a, b, la, lb), a, b, la, lb) - best) < 1e-9


def test_split_and_overlay_of_payloads(spark):
    """Null is a value, absent paths change nothing, and laying over gives the payload back."""
    import json

    from mnemora.operators import payloads

    given = [
        {"id": "C", "parent": None, "updated": 17, "topic": {"creator": "U", "last_set": 0, "value": ""}, "names": [], "ids": ["T"]},
        {"id": "C", "name": "x"}, {"id": "C", "topic": "text", "updated": None}, {"topic": {"last_set": {"deep": {"k": [1]}}}},
    ]
    split = payloads.split_volatile(F.col("p"), [("updated",), ("topic", "last_set")])
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(given)], "n int, p string").select("n", split.alias("s"))
    got = {r.n: r for r in rows.select("n", "s.*", payloads.overlay(F.col("s.base"), F.col("s.volatile")).alias("whole")).collect()}
    for k, p in enumerate(given):
        assert json.loads(got[k].whole) == p, k
    assert json.loads(got[0].volatile) == {"updated": 17, "topic": {"last_set": 0}} and json.loads(got[0].base)["parent"] is None
    assert got[1].volatile is None and json.loads(got[2].volatile) == {"updated": None} and json.loads(got[3].base) == {"topic": {}}
    over = spark.createDataFrame([('{"a":1,"b":2}', '{"b":null}'), ('{"a":{"x":1}}', '{"a":{"y":{"z":2}}}'), ('{"a":1}', '[2]')], "b string, v string")
    assert [json.loads(r[0]) for r in over.select(payloads.overlay(F.col("b"), F.col("v"))).collect()] == [{"a": 1, "b": None}, {"a": {"x": 1, "y": {"z": 2}}}, [2]]


def test_chunks_cover_texts_and_cut_at_headings(spark):
    text = "\n".join(f"# Part {k}\n" + "word " * 120 for k in range(12)) + "\n```\n" + "code\n" * 300 + "```\nend"
    spans = retrieval.chunk_spans(text, 2000, 500)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < d and c <= b and b < d for (a, b), (c, d) in zip(spans, spans[1:]))
    assert all(text[b:].startswith("# Part") for _, b in spans[:5])
    assert retrieval.chunk_spans("") == [] and retrieval.chunk_spans("short") == [(0, 5)]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x" * 9000)], "doc_id long, text string")
    got = retrieval.chunks(docs).collect()
    assert {r.doc_id for r in got} == {1, 3} and all((text if r.doc_id == 1 else "x" * 9000)[r.pos : r.pos + len(r.text)] == r.text for r in got)


def test_query_syntax():
    assert retrieval.parsed_lex('auth "rate Limiter" -saml -"test data" perf') == (["auth", "perf"], ("rate limiter",), ("saml", "test data"))


@pytest.mark.parametrize(
    "raw, want",
    [("hello *world*", "hello **world**"), ("~old~ news", "~~old~~ news"), ("hi <@U_ANN>!", "hi @Ann Lee!"), ("<@U_X> <@U_ANN>", "@U_X @Ann Lee"), ("<https://x.com|X>", "[X](https://x.com)"), ("<https://x.com>", "<https://x.com>"),
     ("see <#C_B|bridge>", "see #bridge"), ("<!subteam^S_O|ops> go", "@ops go"), ("<!here> up", "@here up"), ("a &amp; b &lt;3 &gt;_&lt;", "a & b <3 >_<"), (":nosuch:", ":nosuch:"), ("> q\nplain", "> q\n\nplain"), ("2*3*4 a * b", "2*3*4 a * b")],
)
def test_chat_markup(spark, raw, want):
    names = F.create_map(F.lit("U_ANN"), F.lit("Ann Lee"))
    assert spark.createDataFrame([(raw,)], "t string").select(flows.to_markdown(F.col("t"), names)).first()[0] == want


def test_times_in_another_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.123' as ts, 1709251200000L as ms, -1L as old")
        assert tuple(rows.select(C.epoch_ms(F.col("ts")), C.period_key(F.col("ms"), "month"), C.period_key(F.col("old"), "day")).first()) == (1710037800123, "2024-03", "1969-12-31")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_readers_of_odd_files(spark, tmp_path):
    table = spark.createDataFrame([(1, '{"x":1}'), (2, "{bad"), (3, None)], "id int, payload string")
    assert [(r.id, r.data.x) for r in readers.raw_payloads(table, "x int").collect()] == [(1, 1)]
    (tmp_path / "a.csv").write_text("time,temperature_f,humidity_pct\n2024-01-01 00:00:00,50,40\n")
    (tmp_path / "b.csv").write_text("time,humidity_pct,temperature_f\n2024-01-01 00:00:00,77,60\n")
    got = {(r.device, r.metric): r.value for r in readers.sensor_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("a", "temperature_f"): 50, ("a", "humidity_pct"): 40, ("b", "temperature_f"): 60, ("b", "humidity_pct"): 77}
    (tmp_path / "x.txt").write_text('A,B,A\n1,"two\nlines, ""q""",3\n')
    row = readers.csv_export(spark, str(tmp_path / "x.txt"), "A").collect()
    assert [(r.A, r.B, r.A_2) for r in row] == [("1", 'two\nlines, "q"', "3")]
    (tmp_path / "m.mbox").write_bytes(b"From a Mon\nFrom: a@x\nContent-Type: text/plain; charset=nosuch\n\nb\xf6dy\n>>From x\n")
    mail = readers.mailbox(spark, str(tmp_path / "m.mbox")).collect()
    assert len(mail) == 1 and "dy" in mail[0].body and ">From x" in mail[0].body
    assert readers.table_name("/x/My Export (2).csv") == "my_export_2"


def test_stream_results_are_tables(spark, sf_dir):
    rows = stream.latest(spark, stream.read(spark, sf_dir, 1), ["user_id"])
    assert rows.count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()


def test_a_content_at_many_paths_gives_all_pairs(spark, monkeypatch):
    """Pairs of one content are made by several tasks, each pair once."""
    from mnemora.operators import files

    monkeypatch.setattr(files, "DEALT", 7)
    old = spark.range(60).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") < 50, "x").otherwise(F.col("id").cast("string")).alias("hash"))
    new = old.where("hash <> '59'").select(F.concat("path", F.lit(".moved")).alias("path"), "hash")
    found = files.moved(old, new).withColumn("task", F.spark_partition_id())
    rows = found.collect()
    want = {(h, f"a/{i}", f"a/{j}.moved") for h, own in [("x", range(50)), *[(str(k), [k]) for k in range(50, 59)]] for i in own for j in own}
    assert len(rows) == len(want) and {(r.hash, r.from_path, r.to_path) for r in rows} == want
    assert len({r.task for r in rows if r.hash == "x"}) > 1


def test_pairs_of_a_content_are_made_by_blocks_of_paths(spark, monkeypatch):
    """No path is followed by all paths that its content came to, which would be too long a list to compress; unknown paths keep their pairs."""
    from itertools import groupby

    from mnemora.operators import files

    monkeypatch.setattr(files, "DEALT", 7)
    old = spark.range(60).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("path"), F.lit("x").alias("hash")).unionByName(spark.sql("select cast(null as string) as path, 'x' as hash"))
    new = old.select(F.concat("path", F.lit(".moved")).alias("path"), "hash")
    rows = files.moved(old, new).collect()
    own = [None, *[f"a/{i}" for i in range(60)]]
    assert len(rows) == 61 * 61 and {(r.from_path, r.to_path) for r in rows} == {(a, b and f"{b}.moved") for a in own for b in own}
    assert max(len(list(run)) for _, run in groupby(r.from_path for r in rows)) < 30


def test_ignore_lines_broadcast_no_entries(spark):
    """Tables of entries aren't taken to the driver, however few bytes they were read from."""
    from mnemora.operators import ignore

    entries = spark.range(40).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit(".tmp")).alias("path"), F.lit(False).alias("is_dir")).unionByName(spark.sql("select 'd' as path, true as is_dir"))
    found = ignore.ignored(entries, spark.createDataFrame([("", ["*.tmp", "!3*"])], "directory string, patterns array<string>"))
    assert found.where("kept").count() == 12  # 3, 30 to 39 and the directory
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("BroadcastHashJoin") <= 1  # the frames' lines alone


def test_a_search_for_all_rows_is_not_cut(spark, monkeypatch):
    from mnemora.operators import search

    monkeypatch.setattr(search, "MOST_ROWS", 5)
    rows = spark.range(40).select(F.col("id").cast("string").alias("uuid"), F.lit("User Input").alias("kind"), F.lit("the").alias("text"), F.lit(None).cast("timestamp_ntz").alias("when_ts_utc"))
    hits = lambda text, n: rows.select("uuid", F.lit(0).alias("rank"), F.lit(1.0).alias("score")) if n is None else None
    for q, retrieve in ((search.Filters(), None), (search.Filters(text="th"), None), (search.Filters(text="th"), hits)):
        assert search.routed(rows, q, retrieve, None)[0].count() == 40
    assert search.search(rows, search.Filters(), 9).count() == 5


def test_an_alignment_takes_no_table_of_both_sides(monkeypatch):
    """Many strips and blocks give the groups that one gives, and the memory isn't the product of the sides."""
    import tracemalloc

    r = np.random.default_rng(5)
    a, b, la, lb = r.normal(size=(1500, 8)), r.normal(size=(1300, 8)), r.integers(1, 20, 1500), r.integers(1, 20, 1300)
    whole = align.groups(a, b, la, lb)
    monkeypatch.setattr(align, "STRIP_CELLS", 1 << 14, raising=False)
    tracemalloc.start()
    found = align.groups(a, b, la, lb)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == whole
    assert peak < 1500 * 1300 * 8


def test_overlay_reads_each_side_once(spark):
    """However deep objects may be, a payload is parsed once and not for each name and level."""
    import re

    from mnemora.operators import payloads

    rows = spark.createDataFrame([('{"a":{"x":1},"n":null}', '{"a":{"y":null},"c":2}')], "b string, v string").repartition(1)
    found = rows.select(payloads.overlay(F.col("b"), F.col("v")).alias("o"))
    assert found.first().o == '{"a":{"x":1,"y":null},"c":2,"n":null}'
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"parse_?json\(b#|parseJson[^,]*, b#|b#\d+", plan.split("\n")[0], re.I)) <= 2


def test_mails_share_their_header_classes():
    """The default policy makes a class for each header of each mail, which a task's memory grows with."""
    import pyarrow as pa

    mails = [f"From x\nFrom: a{n}@example.org\nSubject: =?utf-8?q?caf=C3=A9?= {n}\nX-Own: v\n\nbody".encode() for n in range(600)]
    runs = list(readers._mails([pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(mails)], ["position", "value"])]))
    assert [p for run in runs for p, _ in run] == list(range(600)) and len(runs) > 1
    found = [m for run in runs for _, m in run]
    assert str(found[5]["Subject"]) == "café 5" and str(found[5]["From"]) == "a5@example.org" and str(found[5]["X-Own"]) == "v"
    assert len({type(m[h]) for m in found for h in ("From", "Subject", "X-Own")}) == 3
