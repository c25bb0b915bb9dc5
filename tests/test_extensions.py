"""Editions, outlines, attachments, ignore lines, resumed series, times, exploration and durable streams on odd rows."""

import pytest
from pyspark.sql import functions as F

from mnemora.functions import registered, times
from mnemora.operators import attachments, explore, files, flows, ignore, outline, resume
from mnemora.sources import readers, takeout, tei
from mnemora.streaming import buckets

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader/><text><body><div type="edition">
<div subtype="book" n="1"><div subtype="chapter" n="2"><head>Head</head><div subtype="section" n="10"><p>one <q>quoted</q> tail<note>n</note></p><milestone n="x"/></div>
<div subtype="section" n="9"><p>a</p>
<p>b &amp; <![CDATA[c]]></p></div></div><div subtype="chapter" n="3"><p>whole  chapter</p></div></div>
<div subtype="section" n="7">no book</div><div subtype="book" n="2"><div subtype="section" n="7">no chapter</div><div subtype="chapter" n="1"><div subtype="section" n="1"> </div></div></div>
</div></body></text></TEI>"""


def test_tei_sections_nest():
    assert list(tei.sections(TEI.encode())) == [("1", "2", "10", "one quoted tailn"), ("1", "2", "9", "a b & c"), ("1", "3", "1", "whole chapter"), ("2", "1", "1", "")]
    assert list(tei.sections(b"<TEI/>")) == []


def test_tei_editions_unite_in_order(spark, tmp_path):
    (tmp_path / "w-eng4.xml").write_text(TEI)
    (tmp_path / "w-grc2.xml").write_text(TEI.replace("quoted", "other").replace('n="3"', 'n="front"'))
    read = tei.editions(spark, str(tmp_path))
    rows = tei.in_order(tei.united(read)).collect()
    assert [(r.book, r.chapter, r.section, [x.edition for x in r.texts]) for r in rows] == [("1", "2", "9", ["w-grc2", "w-eng4"]), ("1", "2", "10", ["w-grc2", "w-eng4"]), ("1", "3", "1", ["w-eng4"])]


def plain_order(rows):
    """Depth-first walk by recursion over children."""
    ids = {i for i, _, _ in rows}
    below = {}
    for i, parent, place in rows:
        below.setdefault(parent if parent in ids else None, []).append((place, i))
    out = []

    def walk(i, root, depth):
        out.append((i, root, depth, sum(r == root for _, r, _, _ in out)))
        for _, child in sorted(below.get(i, [])):
            walk(child, root, depth + 1)

    for _, i in below.get(None, []):
        walk(i, i, 0)
    return sorted(out)


def test_outline_of_deep_trees_cycles_and_orphans(spark):
    chain = [(f"c{i:03}", f"c{i - 1:03}" if i else None, 0) for i in range(200)]
    bush = [("r", "gone", 5), ("a", "r", 2), ("b", "r", 10), ("d", "r", 2), ("e", "a", 0), ("f", "b", 1)]
    ring = [("x", "y", 0), ("y", "x", 0), ("z", "x", 1)]
    table = spark.createDataFrame(chain + bush + ring, "id string, parent string, place long").repartition(3)
    assert sorted(tuple(r) for r in outline.read_order(table).select("id", "root", "depth", "position").collect()) == plain_order(chain + bush)
    assert outline.read_order(table.limit(0)).count() == 0


def test_list_numbers_begin_anew(spark):
    rows = [(i, "p", i, k) for i, k in enumerate("n n t n q n n".split())] + [(10, None, 0, "n")]
    table = spark.createDataFrame(rows, "id long, parent string, place long, kind string")
    got = {r.id: r.number for r in outline.numbered(table, listed="n").collect()}
    assert got == {0: 1, 1: 2, 2: None, 3: 1, 4: None, 5: 1, 6: 2, 10: 1}


def test_attachments_exact_cut_tied_missing(spark):
    files = [("d", n) for n in ("course-laid-in.txt", "a very long na.jpg", "a very.jpg", "tie.PNG", "tie.png", "noext", ".hidden", "ü ber.txt")]
    wanted = {"course-laid-in.txt": "course-laid-in.txt", "a very long name indeed.JPG": "a very long na.jpg", "a very short.jpg": "a very.jpg", "tied up.png": None, "other.txt": None, "noextension": "noext", "ü berall.txt": "ü ber.txt", "a very long name.txt": None}
    references = spark.createDataFrame([("d", n) for n in wanted] + [("e", "course-laid-in.txt"), ("d", "noextension"), (None, "x")], "folder string, name string")
    got = attachments.resolved(references, spark.createDataFrame(files + files[:1], "folder string, name string")).collect()
    assert {r.name: r.found for r in got if r.folder == "d"} == wanted and len(got) == references.count()
    assert {r.name: r.how for r in got if r.folder == "d"}["tied up.png"] == "missing" and next(r for r in got if r.folder == "e").how == "missing"


@pytest.mark.parametrize(
    "lines, path, is_dir, kept",
    [
        (["*.tmp"], "a/b/x.tmp", False, False), (["*.tmp", "!x.tmp"], "a/x.tmp", False, True), (["/x.tmp"], "a/x.tmp", False, True), (["/x.tmp"], "x.tmp", False, False), (["build/"], "build", False, True), (["build/"], "a/build", True, False),
        (["build/"], "a/build/deep/x", False, False), (["a/*/c"], "a/b/c", False, False), (["a/*/c"], "a/b/b/c", False, True), (["a/**/c"], "a/b/b/c", False, False), (["a/**/c"], "a/c", False, False), (["**/c"], "a/b/c", False, False),
        (["a/**"], "a/b/c", False, False), (["x?.(1)"], "xy.(1)", False, False), (["x.1"], "xa1", False, True), (["# x", "", "y"], "# x", False, True), (["a", "!a/keep"], "a/keep", False, False),
    ],
)
def test_ignore_lines(spark, lines, path, is_dir, kept):
    parts = path.split("/")
    above = [("/".join(parts[:k]), True) for k in range(1, len(parts))]
    entries = spark.createDataFrame([(path, is_dir), *above], "path string, is_dir boolean")
    got = ignore.ignored(entries, spark.createDataFrame([("", lines)], "directory string, patterns array<string>"))
    assert {r.path: r.kept for r in got.collect()}[path] is kept


def test_ignore_lines_of_inner_directories(spark):
    entries = spark.createDataFrame([("a", True), ("a/b", True), ("a/x.log", False), ("a/b/x.log", False), ("a/b/y.log", False), ("c", True), ("c/x.txt", False)], "path string, is_dir boolean")
    frames = spark.createDataFrame([("", ["*.log"]), ("a/b", ["!x.log"]), ("c", ["c/"])], "directory string, patterns array<string>")
    got = {r.path: (r.kept, r.pattern, r.at) for r in ignore.ignored(entries, frames).collect()}
    assert got["a/x.log"] == (False, "*.log", "a/x.log") and got["a/b/x.log"][0] and not got["a/b/y.log"][0]
    assert got["c"] == (False, "c/", "c") and got["c/x.txt"] == (False, "c/", "c")  # a directory is tested by its own lines too


def test_resume_start_notes(spark):
    rows = spark.createDataFrame([(1000, 100, False, False), (None, 100, False, False), (1000, 100, True, False), (1000, 2000, False, True), (1000, 2000, False, False)], "w long, b long, wide boolean, narrow boolean")
    got = rows.select(resume.start(F.col("w"), F.col("b"), 300, F.col("wide"), F.col("narrow")).alias("s")).collect()
    assert [tuple(r.s) for r in got] == [(700, "normal"), (100, "normal"), (100, "backfill"), (2000, "skips ahead"), (2000, "normal")]


def test_resume_gives_up_after_a_run_of_failures(spark):
    cursors = spark.createDataFrame([("a", 0), ("b", 0), ("c", 99)], "device string, cursor long")
    planned = resume.windows(cursors, 15, 10, 95)
    assert [(r.n, r.start, r.end) for r in planned.where("device = 'a'").orderBy("n").collect()][-2:] == [(8, 80, 95), (9, 90, 95)] and planned.where("device = 'c'").count() == 0
    failed = spark.createDataFrame([("a", n) for n in (1, 2, 4, 5, 6, 8)] + [("b", 1), ("b", 3)], "device string, n long")
    states = resume.given_up(planned, failed, 3)
    assert [r.state for r in states.where("device = 'a'").orderBy("n").collect()] == ["fetched", "failed", "failed", "fetched", "failed", "failed", "failed", "not tried", "not tried", "not tried"]
    assert states.where("device = 'b' and state = 'not tried'").count() == 0
    readings = spark.createDataFrame([("b", t) for t in range(0, 95, 5)] + [("z", 1)], "device string, ts_ms long")
    given = resume.fetched(readings, states.where("state = 'fetched'"), 15, 10, cursors)
    spans = [(n * 10, min(n * 10 + 15, 95)) for n in range(10) if n not in (1, 3)]
    want = sorted(t for a, b in spans for t in range(0, 95, 5) if a <= t < b)
    assert sorted(r.ts_ms for r in given.collect()) == want and sorted(r.ts_ms for r in resume.stored(given, ["device", "ts_ms"]).collect()) == sorted(set(want))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_keep_their_offset(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x
        assert tuple(one("2026-03-08T02:30:00.1234567-08:00", times.split_when)) == ("2026-03-08T10:30:00.123456Z", "-08:00")
        assert tuple(one("1969-12-31T23:59:59Z", times.parse_strict)) == (-1_000_000, "+00:00") and one("1969-12-31T23:59:59.5Z", lambda c: times.split_when(c)["utc"]) == "1969-12-31T23:59:59.500000Z"
        for wrong in ("", None, "2026-02-30T00:00:00Z", "2026-01-01T24:00:00Z", "2026-01-01T00:00:00", "2026-01-01", "x"):
            assert one(wrong, times.parse_strict) is None
        assert tuple(one("2026-06-10T21:23:00.5", times.parse_assumed_utc))[1] == "+00:00" and one("2026-06-10", times.parse_assumed_utc) is None
        assert one("20260605T191839Z", times.coerce_when) == "2026-06-05T19:18:39+00:00" and one(" 2026-06-05T19:18:39Z ", times.coerce_when) == "2026-06-05T19:18:39Z"
        assert one("20260605T191839.25-0730", times.coerce_when) == "2026-06-05T19:18:39-07:30" and one("20261305T191839Z", times.coerce_when) is None
        assert one("2026-01-01T00:00:00Z", lambda c: times.bump_micros(c, F.lit(-1))) == "2025-12-31T23:59:59.999999+00:00"
        assert one("2026/06/10 14:23:00-0700", lambda c: times.strptime(c, "%Y/%m/%d %H:%M:%S%z")).micros == 1_781_126_580_000_000
        assert one("Jun 1, 2026 12:05 AM +00:00", lambda c: times.strptime(c, "%b %d, %Y %I:%M %p %:z")).micros == 1_780_272_300_000_000
        assert one("Foo 1, 2026 12:05 AM +00:00", lambda c: times.strptime(c, "%b %d, %Y %I:%M %p %:z")) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    with pytest.raises(ValueError, match="offset"):
        times.strptime(F.lit("x"), "%Y")
    with pytest.raises(ValueError, match="known"):
        times.strptime(F.lit("x"), "%Q%z")


def test_sql_functions(spark):
    registered.register(spark)
    rows = spark.sql("""SELECT s.* FROM (VALUES ('[{"a": 1, "b": "x"}, {"a": 2.5, "c": 1}, 7]'), ('{bad'), (null)) t(p), LATERAL mn_shred(p, 'a bigint, b string') s""").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, None)]
    assert [r.text for r in spark.sql("SELECT * FROM mn_sentences('One two.  Three! 3.14 is it? Last') ORDER BY number").collect()] == ["One two.", "Three!", "3.14 is it?", "Last"]
    assert spark.sql("SELECT mn_slug('Hello, World!') AS a, mn_period(1709251200000, 'month') AS b, round(mn_cosine(array(1D, 0D), array(1D, 1D)), 4) AS c").first() == ("hello-world", "2024-03", 0.7071)
    assert spark.sql("SELECT count(*) AS n FROM mn_chunks(repeat('word ', 3000))").first().n > 1
    with pytest.raises(Exception, match="name and type"):
        spark.sql("SELECT * FROM mn_shred('{}', 'a map<int,int>')").collect()


def test_walks(spark):
    people = spark.createDataFrame([(1, "qi", 10), (2, "ann", None), (3, "bo", 99)], "id long, name string, team long")
    teams = spark.createDataFrame([(10, "red")], "id long, name string")
    posts = spark.createDataFrame([(1, 1, "slack", 5), (2, 1, "mail", 7), (3, 2, "slack", 1), (4, None, "slack", 2)], "id long, author long, source string, n long")
    graph = explore.Graph({"posts": posts, "people": people, "teams": teams}, {"posts": "id", "people": "id", "teams": "id"}, {("posts", "author"): "people", ("people", "team"): "teams"})
    by_team = graph.start("posts").where("source", lambda c: c == "slack").group("author.team.name", n="count", most=("max", "n")).rows
    assert {tuple(r) for r in by_team.collect()} == {("red", 1, 5), (None, 2, 2)}
    assert [r.name for r in graph.start("posts").follow("author").sort("-name").rows.collect()] == ["qi", "ann"]
    assert graph.start("posts").follow("author.team").rows.count() == 1 and graph.start("people").where("team.name", lambda c: c == "red").back("posts", "author").rows.count() == 2
    assert [tuple(r) for r in graph.start("posts").sort("-n", limit=2).pick(who="author.name", n="n").collect()] == [("qi", 7), ("qi", 5)]
    with pytest.raises(ValueError, match="links to no table"):
        graph.start("posts").where("source.name", lambda c: c == "x")
    with pytest.raises(ValueError, match="link to"):
        graph.start("teams").back("posts", "author")


def test_walks_push_filters_to_the_scan(spark, sf_dir):
    line, orders = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders"))
    graph = explore.Graph({"lineitem": line, "orders": orders}, {"orders": "o_orderkey"}, {("lineitem", "l_orderkey"): "orders"})
    walk = graph.start("lineitem").where("l_returnflag", lambda c: c == "R").where("l_orderkey.o_orderstatus", lambda c: c == "F").group("l_orderkey.o_orderpriority", n="count")
    plan = walk.rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "EqualTo(o_orderstatus,F)" in plan and "l_comment" not in plan


def test_late_rows_make_only_their_bucket_anew(spark, tmp_path):
    """Three drivers one after the other, and a batch that runs again."""
    schema = "at string, k long, v long"
    day, order = F.substring("at", 1, 10), [F.desc("at"), F.desc("v")]

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        buckets.keep(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/kept", day, ["k"], order).awaitTermination()

    arrive([("2026-01-01 01", 1, 1), ("2026-01-01 02", 1, 2), ("2026-01-02 01", 1, 3)])
    arrive([("2026-01-03 01", 1, 4)])
    arrive([("2026-01-01 00", 2, 5), ("2026-01-01 03", 1, 6)])
    of = spark.createDataFrame([], schema).schema
    rows = sorted((r.bucket, r.k, r.v, r.version) for r in buckets.current(spark, f"{tmp_path}/kept", of).collect())
    assert rows == [("2026-01-01", 1, 6, 2), ("2026-01-01", 2, 5, 2), ("2026-01-02", 1, 3, 0), ("2026-01-03", 1, 4, 1)]
    assert sorted((r.version, r.bucket) for r in buckets.changed(spark, f"{tmp_path}/kept", of).collect()) == [(0, "2026-01-01"), (0, "2026-01-02"), (1, "2026-01-03"), (2, "2026-01-01")]
    commits = tmp_path / "kept" / "checkpoint" / "commits"
    for name in ("2", ".2.crc"):
        (commits / name).unlink()  # as after a crash between a batch's rows and its commit
    arrive([])
    assert sorted((r.bucket, r.k, r.v, r.version) for r in buckets.current(spark, f"{tmp_path}/kept", of).collect()) == rows


@pytest.mark.parametrize(
    "raw, want",
    [
        ("*<https://x.org|a*b>* and *c*", "**[a*b](https://x.org)** and **c**"), ("*a\nb*", "*a\nb*"), ("* a* b*c*d **", "* a* b*c*d **"), ("(*x y*), ~z~.", "(**x y**), ~~z~~."), ("<mailto:a@b|a@b>", "[a@b](mailto:a@b)"),
        ("<#C_9>", "#C_9"), ("<!subteam^S9>", "@group"), ("a < b > c", "a < b > c"), ("&amp;lt;", "&lt;"), ("> a\n> b\n\nc", "> a\n> b\n\nc"), ("", ""), (None, None), ("12:30:45 :+1: :x:", "12:30:45 👍 :x:"), ("*é*ü", "*é*ü"),
    ],
)
def test_chat_markup_beyond_the_plain_cases(spark, raw, want):
    emoji = F.create_map(F.lit("+1"), F.lit("👍"))
    assert spark.createDataFrame([(raw,)], "t string").select(flows.to_markdown(F.col("t"), None, emoji)).first()[0] == want


def test_split_quoted_reads_line_ends_of_mail(spark):
    assert spark.createDataFrame([("a\r\n> b\r\n> c\r\n",)], "b string").select(flows.split_quoted(F.col("b"))).first()[0] == "a"


def test_latest_goes_on_in_its_folder(spark, tmp_path):
    from mnemora.streaming import events

    schema = "event_id long, ts timestamp_ntz, user_id long"

    def arrive(rows):
        spark.sql(f"select * from values {rows} t(event_id, ts, user_id)").select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp_ntz"), F.col("user_id").cast("long")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("at", F.col("ts").cast("timestamp"))
        return sorted((r.user_id, r.event_id) for r in events.latest(spark, stream, ["user_id"], f"{tmp_path}/kept", 4).collect())

    assert arrive("(1, '2026-01-01', 1), (2, '2026-01-02', 1), (3, '2026-01-01', 2)") == [(1, 2), (2, 3)]
    assert arrive("(4, '2026-01-01', 1), (5, '2026-01-03', 2), (6, null, 3)") == [(1, 2), (2, 5), (3, 6)]


@pytest.mark.parametrize(
    "link, want",
    [
        ("https://x.org/feed/update/urn:li:share:12/", "urn:li:share:12"), ("https://x.org/feed/update/urn%3Ali%3Aactivity%3A34?a=b", "urn:li:activity:34"), ("https://x.org/posts/a-b-ugcPost-56-Zz", "urn:li:ugcPost:56"),
        ("https://x.org/p/1/?q#t", "https://x.org/p/1"), ("50% off", "50% off"), ("", "position:9"), (None, "position:9"),
    ],
)
def test_post_keys(spark, link, want):
    assert spark.createDataFrame([(link, 9)], "l string, p long").select(flows.post_key(F.col("l"), F.col("p"))).first()[0] == want


def test_contents_are_put_once(spark):
    blobs = spark.createDataFrame([(1, b"a"), (2, b"a"), (3, b"b"), (4, None), (5, b""), (1, b"a")], "o long, c binary")
    stored = spark.createDataFrame([(b"b",)], "c binary").select(F.sha2("c", 256).alias("hash"))
    fresh, edges = files.put(blobs, stored, "o", "c")
    assert sorted((bytes(r.content), r.first_owner, r.size) for r in fresh.collect()) == [(b"", 5, 0), (b"a", 1, 1)] and edges.count() == 4


def test_exports_with_odd_parts(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Notes:\n"When exporting, some are missing"\n\nFirst,"Last Name",URL\nA,"B, C",u\n')
    n = readers.preamble(spark, str(tmp_path / "x.csv"), ["First", "Last Name"])
    assert n == 3 and [(r.First, r["Last Name"]) for r in readers.csv_export(spark, str(tmp_path / "x.csv"), None, n).collect()] == [("A", "B, C")]
    assert readers.preamble(spark, str(tmp_path / "x.csv"), ["None such"]) == 0
    (tmp_path / "m.xml").write_text('<smses><mms address="1" date="5" msg_box="1"/><mms address="2" date="6" msg_box="2"><parts><part ct="text/plain" text="a"/><part ct="image/gif" name="g.gif" cl="null" data="!!"/></parts></mms></smses>')
    messages, attachments = readers.mms_backup(spark, str(tmp_path / "m.xml"))
    assert sorted((r.address, r.outgoing, r.body, r.n_attachments) for r in messages.collect()) == [("1", False, "", 0), ("2", True, "a", 1)]
    assert [(r.name, r.content_type, r.size, r.hash) for r in attachments.collect()] == [("g.gif", "image/gif", None, None)]
    (tmp_path / "b.mbox").write_bytes(b"From a\nSubject: plain\n\nbody\nFrom b\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/plain\n\nx\n--q\nContent-Type: image/png\nContent-Disposition: attachment; filename=\"\xc3\xa4.png\"\nContent-Transfer-Encoding: base64\n\nAAE=\n--q--\n")
    got = readers.mail_attachments(spark, str(tmp_path / "b.mbox")).collect()
    assert [(r.place, r.content_type, r.size) for r in got] == [(0, "image/png", 2)]


def test_discussions_of_notes_without_one(spark):
    notes = spark.createDataFrame([(1, None, 10, 3, True), (1, "d", 11, 1, False), (1, "d", 12, 5, True), (1, "d", 13, 1, False), (1, None, 14, 2, False)], "request long, discussion string, id long, at long, system boolean")
    got = [(r.id, r.discussion_index, r.note_index, r.kind) for r in flows.discussions(notes).orderBy("discussion_index", "note_index").collect()]
    assert got == [(11, 0, 0, "thread"), (13, 0, 1, "reply"), (12, 0, 2, "system note"), (14, 1, 0, "thread"), (10, 2, 0, "event")]


def test_takeout_calls_and_odd_messages(spark, tmp_path):
    call = '<html><body><div class="haudio"><span class="fn">Voicemail from</span><div class="contributor vcard"><a class="tel" href="tel:+15551"><span class="fn">Bo</span></a></div><abbr class="published" title="2024-02-03T04:05:06.000-08:00">x</abbr><span class="full-text">Hi &amp; bye<br>now</span><audio src="a.mp3"></audio><abbr class="duration" title="PT1H2M3S">(1)</abbr></div></body></html>'
    (tmp_path / "Bo - Voicemail - 2024-02-03T12_05_06Z.html").write_text(call)
    (tmp_path / " - Missed - 2024-02-03T12_05_06Z.html").write_text('<html><div class="haudio"><abbr class="published" title="2024-02-03T04:05:06Z">x</abbr></div>')
    (tmp_path / "Cy - Text - 2024.html").write_text('<div class="hChatLog"><div class="message"><q></q></div><div class="message"><abbr class="dt" title="t">x</abbr><q>a<br/>b</div></div>')
    (tmp_path / "Bills.html").write_text("<html><table/></html>")
    calls = {r.conversation: r for r in takeout.voice_calls(spark, str(tmp_path)).collect()}
    assert (calls["Bo"].kind, calls["Bo"].tel, calls["Bo"].seconds, calls["Bo"].transcript, calls["Bo"].attachments) == ("voicemail", "+15551", 3723, "Hi & bye\nnow", ["a.mp3"])
    assert (calls[""].kind, calls[""].tel, calls[""].seconds) == ("missed", None, None) and len(calls) == 2
    texts = takeout.voice_messages(spark, str(tmp_path)).where("conversation = 'Cy'").orderBy("place").collect()
    assert [(r.place, r.at, r.body, r.is_me) for r in texts] == [(0, None, "", False), (1, "t", "a\nb", False)]


def test_voice_folders_that_spark_wrote_stand_for_files(spark, tmp_path):
    page = '<div class="message"><cite class="sender"><span class="fn">Me</span></cite>: <q>hi</q></div>'
    spark.createDataFrame([("Ann = B - Text - 2024.html", page), ("Cy - Text - 2024.html", page)], "file string, value string").write.partitionBy("file").text(str(tmp_path / "out"))
    (tmp_path / "out" / "Di=E - Text - 2024.html").write_text(page)
    assert sorted(r.conversation for r in takeout.voice_messages(spark, str(tmp_path / "out")).collect()) == ["Ann = B", "Cy", "Di=E"]
