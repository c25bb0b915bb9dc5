"""Dataflows of the sources: shredding of JSON, threads, periods, merges, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.durable import cut
from mnemora.functions.columns import period_key, uuid5
from mnemora.operators.grid import ordered_text


def by_period(items: DataFrame, room: str, at_ms: str, period: str = "month") -> DataFrame:
    """``(room, period, first_ts, last_ts, n)`` of items without reactions."""
    return items.groupBy(room, period_key(F.col(at_ms), period).alias("period")).agg(F.min(at_ms).alias("first_ts"), F.max(at_ms).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def reaction_periods(items: DataFrame, reactions: DataFrame, key: str, target: str, at_ms: str, period: str = "month") -> DataFrame:
    """Reactions with the period of what they react to, else their own."""
    aim = items.select(F.col(key).alias(target), period_key(F.col(at_ms), period).alias("__p"))
    return reactions.join(aim, target, "left").withColumn("period", F.coalesce("__p", period_key(F.col(at_ms), period))).drop("__p")


def thread_anchor(comments: DataFrame, key: str, parent: str, anchor: list[str]) -> DataFrame:
    """Replies take their parent's place; others keep their own."""
    up = comments.select(F.col(key).alias(parent), F.lit(True).alias("__has"), *[F.col(c).alias(f"__{c}") for c in anchor])
    joined = comments.join(up, parent, "left")
    return joined.select(*[c for c in comments.columns if c not in anchor], *[F.when(F.col("__has"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in anchor])


def with_orphans(chats: DataFrame, messages: DataFrame, key: str, name: Column) -> DataFrame:
    """Messages with their chat's name; a chat that isn't there gets one made from its key."""
    return messages.join(chats.select(key, name.alias("__name")), key, "left").withColumn("chat_name", F.coalesce("__name", F.concat(F.lit("chat "), F.col(key).cast("string")))).drop("__name")


def merged_threads(shares: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """Posts by key: the share opens, comments follow in time; without a share the first comment's time stands in."""
    listed = comments.groupBy(key).agg(F.count(F.lit(1)).alias("n_comments"), F.min("at").alias("__first"), ordered_text(F.col("text"), F.struct("at", "text")).alias("comments"))
    joined = shares.select(key, F.col("at").alias("__opened"), F.col("text").alias("share")).join(listed, key, "full_outer")
    return joined.select(key, F.coalesce("__opened", "__first").alias("at"), "share", F.coalesce("n_comments", F.lit(0)).alias("n_comments"), "comments")


def contact_identity(contacts: DataFrame, uid: str, name: str, position: str, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> DataFrame:
    """A contact's id: its own, else one from its name, else its place; with the number of contacts that share it."""
    found = F.coalesce(F.nullif(F.col(uid), F.lit("")), F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) != "", uuid5(namespace, F.trim(F.col(name)))), F.concat(F.lit("pos-"), F.col(position).cast("string")))
    identified = contacts.withColumn("identity", found)
    shared = identified.groupBy("identity").agg(F.count(F.lit(1)).alias("n_sharing"))
    return identified.join(shared, "identity")


def channel_key(members: Column) -> Column:
    """A channel by its only member, else by a hash of all in order."""
    distinct = F.array_sort(F.array_distinct(members))
    return F.when(F.size(distinct) == 1, distinct[0]).otherwise(F.concat(F.lit("group-"), F.substring(F.sha2(F.array_join(distinct, ","), 256), 1, 8)))


def display_name(label: Column, order: Column) -> Column:
    """Aggregate: the first label that isn't a number, else the first not empty."""
    item = lambda keep: F.min(F.when(keep, F.struct(order.alias("o"), label.alias("l"))))["l"]
    return F.coalesce(item(label.isNotNull() & (label != "") & ~label.rlike("^[+0-9]")), item(label.isNotNull() & (label != "")))


def shred_map(conversations: DataFrame, key: str, mapping: str) -> DataFrame:
    """Messages of a JSON map of nodes; nodes without a message are left out, a message without an id takes its node's."""
    node = "struct<message:struct<id:string,author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:array<string>,text:string>>,parent:string>"
    nodes = conversations.select(key, F.explode(F.from_json(mapping, f"map<string,{node}>")).alias("node_id", "node")).where("node.message is not null")
    content = F.col("node.message.content")
    text = F.when(content["content_type"].isin("code", "execution_output"), content["text"]).otherwise(F.array_join(F.filter(content["parts"], lambda p: p != ""), "\n"))
    return nodes.select(key, F.coalesce("node.message.id", "node_id").alias("message_id"), F.col("node.message.author.role").alias("role"), F.col("node.message.create_time").alias("create_time"), "node.parent", text.alias("text"))


def shred_blocks(conversations: DataFrame, key: str, messages: str) -> DataFrame:
    """A row for each content block of each message of a JSON array, with both positions."""
    block = "array<struct<uuid:string,sender:string,created_at:string,content:array<struct<type:string,text:string>>>>"
    each = conversations.select(key, F.posexplode(F.from_json(messages, block)).alias("message_index", "m"))
    return each.select(key, "message_index", F.col("m.uuid").alias("message_uuid"), F.col("m.sender").alias("sender"), F.posexplode_outer("m.content").alias("block_index", "b")).select(key, "message_index", "message_uuid", "sender", "block_index", F.col("b.type").alias("type"), F.col("b.text").alias("text"))


def shred_attachments(conversations: DataFrame, key: str, messages: str) -> DataFrame:
    """A row for each attachment, then each file, of each message of a JSON array, in one running index; messages without a uuid are left out."""
    each = conversations.select(key, F.explode(F.from_json(messages, "array<struct<uuid:string,attachments:array<variant>,files:array<variant>>>")).alias("m")).where("m.uuid is not null")
    kind = lambda name, label: F.transform(F.coalesce(F.col(f"m.{name}"), F.array().cast("array<variant>")), lambda v: F.struct(F.lit(label).alias("kind"), v.alias("payload")))
    both = F.concat(kind("attachments", "attachment"), kind("files", "file"))
    placed = each.select(key, F.col("m.uuid").alias("message_uuid"), F.posexplode(both).alias("attachment_index", "a"))
    return placed.select(key, "message_uuid", "attachment_index", F.col("a.kind").alias("kind"), F.to_json("a.payload").alias("payload"))


def children(blocks: DataFrame, key: str, payload: str) -> DataFrame:
    """Child ids of a JSON payload's ``content`` array."""
    return blocks.select(key, F.explode(F.from_json(F.get_json_object(payload, "$.content"), "array<string>")).alias("child"))


def owners(blocks: DataFrame, key: str = "id", parent: str = "parent_id", is_page: str = "is_page") -> DataFrame:
    """``(id, owner)``: the nearest ancestor that is a page, itself included; on a cycle or without one null.

    Pointers double each round, so a chain of n levels takes log2 n joins; it ends when no row is open or none moves on.
    """
    step = cut(blocks.select(F.col(key).alias("id"), F.when(F.col(is_page), F.col(key)).alias("owner"), F.when(~F.coalesce(F.col(is_page), F.lit(False)), F.col(parent)).alias("up")))
    open_rows = step.where("owner is null and up is not null").count()
    while open_rows:
        above = step.select(F.col("id").alias("up"), F.col("owner").alias("__o"), F.col("up").alias("__u"))
        ended = F.col("owner").isNull() & F.col("__o").isNull()
        step = cut(step.join(above, "up", "left").select("id", F.coalesce("owner", "__o").alias("owner"), F.when(ended, F.col("__u")).alias("up")))
        left = step.where("owner is null and up is not null").count()
        if left == open_rows:
            break  # what is left goes round in circles
        open_rows = left
    return step.select("id", "owner")


#: How the lines begin and end that attribute a quotation.
ATTRIBUTIONS = (("On ", "wrote:"), ("Le ", "a écrit :"), ("> On ", "wrote:"))
ORIGINAL = "-----Original Message-----"


def split_quoted(body: Column) -> Column:
    """A mail's own text: up to an attribution line, or up to a run of two or more quoted lines at its end; all of it where nothing is its own."""
    body = F.replace(body, F.lit("\r\n"), F.lit("\n"))
    lines = F.split(body, "\n")

    def attributes(line: Column) -> Column:
        stated = line.contains(ORIGINAL)
        for begin, end in ATTRIBUTIONS:
            stated |= F.trim(line).startswith(begin) & F.trim(line).endswith(end)
        return stated

    at = F.array_position(F.transform(lines, attributes), F.lit(True)).cast("int")
    quoted = F.regexp_extract(body, r"(?s)(?:^|\n)((?:[ \t]*>[^\n]*(?:\n[ \t]*)*)+)$", 1)
    run = F.size(F.filter(F.split(quoted, "\n"), lambda x: F.trim(x) != ""))
    before = F.regexp_replace(F.substring(body, F.lit(1), F.length(body) - F.length(quoted)), r"\n\z", "")
    own = F.when(at > 0, F.array_join(F.slice(lines, F.lit(1), at - 1), "\n")).when((quoted != "") & (run >= 2), before).otherwise(body)
    return F.when(F.regexp_replace(own, r"\s+", "") == "", body).otherwise(own)


def quoted_part(body: Column) -> Column:
    """What ``split_quoted`` leaves out of a mail, from the attribution or the first quoted line on; empty where all is the mail's own."""
    plain = F.replace(body, F.lit("\r\n"), F.lit("\n"))
    own = split_quoted(body)
    rest = F.substring(plain, F.length(own) + 1, F.length(plain))
    return F.when(own == plain, "").otherwise(F.regexp_replace(rest, r"\A\n", ""))


#: What opens, parts and closes a marked region of an assistant's text.
REGION_OPENS, REGION_PARTS, REGION_CLOSES = "\ue200", "\ue202", "\ue201"


def clean_regions(text: Column) -> Column:
    """Marked regions of the form (url, label, address) as links, other regions left out; an opener without an end alone goes."""
    o, p, c = REGION_OPENS, REGION_PARTS, REGION_CLOSES
    links = F.regexp_replace(text, f"{o}url{p}([^{p}{c}]*){p}([^{p}{c}]*){c}", "[$1]($2)")
    return F.replace(F.regexp_replace(links, f"(?s){o}[^{c}]*{c}", ""), F.lit(o), F.lit(""))


def content_text(content: Column) -> Column:
    """The text of a JSON content by its type: parts of a text, code, output, thoughts, recap, context; other types are empty."""
    kind = F.get_json_object(content, "$.content_type")
    field = lambda name: F.coalesce(F.get_json_object(content, f"$.{name}"), F.lit(""))
    parts = F.from_json(F.get_json_object(content, "$.parts"), "array<variant>")
    part = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")), F.try_variant_get(v, "$.text", "string"))
    thoughts = F.from_json(F.get_json_object(content, "$.thoughts"), "array<struct<summary:string,content:string>>")
    said = F.filter(F.flatten(F.transform(thoughts, lambda t: F.array(t["summary"], t["content"]))), lambda x: x.isNotNull())
    text = (
        F.when(kind == "text", clean_regions(F.array_join(F.filter(F.transform(parts, part), lambda x: x.isNotNull()), "\n")))
        .when(kind.isin("code", "execution_output"), field("text"))
        .when(kind == "thoughts", clean_regions(F.array_join(said, "\n\n")))
        .when(kind == "reasoning_recap", clean_regions(field("content")))
        .when(kind == "model_editable_context", clean_regions(field("model_set_context")))
    )
    return F.coalesce(text, F.lit(""))


#: Characters that stand for a reference and for the text's edges while its marks are read.
_HOLE, _EDGE = "\ue000", "\ue001"


def _reference(inside: Column, names: Column | None) -> Column:
    """What stands between angle brackets, as Markdown: a sign, a target and perhaps a label after a bar."""
    bar = F.locate("|", inside)
    target = F.when(bar > 0, F.substring(inside, F.lit(1), bar - 1)).otherwise(inside)
    label = F.when(bar > 0, F.substring(inside, bar + 1, F.length(inside)))
    label = F.when(label != "", label)
    sign, name = F.substring(target, 1, 1), F.substring(target, F.lit(2), F.length(target))
    known = F.element_at(names, name) if names is not None else F.lit(None).cast("string")
    group = name.startswith("subteam^")
    address = F.when(label.isNull() | (label == target), F.concat(F.lit("<"), target, F.lit(">"))).otherwise(F.concat(F.lit("["), label, F.lit("]("), target, F.lit(")")))
    return (
        F.when(sign == "@", F.concat(F.lit("@"), F.coalesce(label, known, name)))
        .when(sign == "#", F.concat(F.lit("#"), F.coalesce(label, name)))
        .when((sign == "!") & group, F.concat(F.lit("@"), F.coalesce(F.ltrim(label, F.lit("@")), F.lit("group"))))
        .when(sign == "!", F.coalesce(F.when(~name.isin("here", "channel", "everyone"), label), F.concat(F.lit("@"), name)))
        .when(target.contains(":"), address)
        .otherwise(F.concat(F.lit("<"), inside, F.lit(">")))
    )


def _marked(text: Column, mark: str, by: str) -> Column:
    """Pairs of ``mark`` around words as ``by``: a fold over the pieces between marks.

    A pair has no mark, line end or outer space inside; it begins after and ends before what is no letter or digit. State: what is
    done, the last piece, what was before it, and whether the mark before it can open.
    """
    state = lambda done, lead, held, opens: F.struct(done.alias("done"), lead.alias("lead"), held.alias("held"), opens.alias("opens"))
    empty = F.lit("")

    def step(s: Column, piece: Column) -> Column:
        closes = s["opens"] & s["held"].rlike(r"^\S(.*\S)?$") & ~s["held"].contains("\n") & piece.rlike(r"^[^\p{L}\p{N}_]")
        ready = s["held"].rlike(r"[^\p{L}\p{N}_]$")
        return F.when(s["held"].isNull(), state(empty, empty, piece, F.lit(False))).when(closes, state(F.concat(s["done"], F.lit(by), s["held"], F.lit(by)), empty, piece, F.lit(False))).otherwise(
            state(F.concat(s["done"], s["lead"], s["held"]), F.lit(mark), piece, ready)
        )

    first = state(empty, empty, F.lit(None).cast("string"), F.lit(False))
    return F.aggregate(F.split(text, f"[{mark}]"), first, step, lambda s: F.concat(s["done"], s["lead"], s["held"]))


def to_markdown(text: Column, names: Column | None = None, emoji: Column | None = None) -> Column:
    """A chat program's markup as Markdown.

    The text is cut into references (between angle brackets) and what is around them; marks are read with a hole for
    each reference, which is then filled. ``names``: a map from the ids of users to their names, ``emoji``: one from names between
    colons to signs; ids and names that they lack stand for themselves. A line after a quoted one is parted from it by an empty line.
    """
    clean = F.translate(text, _HOLE + _EDGE, "")
    tokens = F.regexp_extract_all(clean, F.lit(r"<[^<>\n]+>|[^<]+|<"), F.lit(0))
    is_reference = lambda x: x.rlike("(?s)^<.+>$")
    filled = F.transform(F.filter(tokens, is_reference), lambda x: _reference(F.substring(x, F.lit(2), F.length(x) - 2), names))
    holes = F.array_join(F.transform(tokens, lambda x: F.when(is_reference(x), _HOLE).otherwise(x)), "")
    marked = _marked(_marked(F.concat(F.lit(_EDGE), holes, F.lit(_EDGE)), "*", "**"), "~", "~~")
    whole = F.array_join(F.zip_with(F.split(F.translate(marked, _EDGE, ""), _HOLE), filled, lambda around, inside: F.concat(F.coalesce(around, F.lit("")), F.coalesce(inside, F.lit("")))), "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        whole = F.replace(whole, F.lit(entity), F.lit(sign))
    lines = F.split(whole, "\n")
    parted = F.zip_with(lines, F.concat(F.array(F.lit("")), lines), lambda line, above: F.when(line.isNull(), None).when(above.startswith(">") & (line != "") & ~line.startswith(">"), F.concat(F.lit("\n"), line)).otherwise(line))
    out = F.array_join(parted, "\n")
    if emoji is None:
        return out
    pieces = F.regexp_extract_all(out, F.lit(r"(?s):[a-z0-9_+'-]+:|[^:]+|:"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.when(x.rlike("^:.+:$"), F.element_at(emoji, F.substring(x, F.lit(2), F.length(x) - 2))), x)), "")


def sentences(text: Column, terminators: str = ".!?") -> Column:
    """The sentences of a text as ``array<struct<text,start,length>>``, in characters from 0.

    One ends after a terminator that white space and a capital follow (Latin and Greek ones; all of the extended Greek letters count).
    """
    marks = "".join("\\" + c for c in terminators)
    parts = F.split(text, rf"(?<=[{marks}])(?=\s+[A-Z\u0391-\u03A9\u1F00-\u1FFD])")
    placed = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,length:int>>").alias("found")),
        lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["found"], F.array(F.struct(F.regexp_replace(x, r"^\s+|\s+$", "").alias("text"), (s["at"] + F.length(F.regexp_extract(x, r"^\s*", 0))).alias("start"), F.length(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("length")))).alias("found")),
        lambda s: s["found"],
    )
    return F.filter(placed, lambda x: x["length"] > 0)


def mail_threads(mails: DataFrame, labels: str = "labels") -> DataFrame:
    """``(account, thread_id, n, subject, first_at, last_at, ids, labels)`` from mails ``(account, thread_id, id, received_at, subject, labels)``.

    Mails are in the order of (received_at, id); the subject is the first's; labels are distinct and in order.
    """
    order = F.struct("received_at", "id")
    return mails.groupBy("account", "thread_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("subject", order).alias("subject"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"),
        ordered_text(F.col("id").cast("string"), order, delimiter=",").alias("ids"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(labels)))), ",").alias("labels"),
    )


def chat_threads(messages: DataFrame) -> DataFrame:
    """Messages ``(channel, ts, thread_ts, uuid)`` with their thread's root time, its uuid where it is there, and their place, by (time, uuid)."""
    root = F.coalesce("thread_ts", "ts").alias("root_ts")
    placed = messages.select("*", root)
    own = Window.partitionBy("channel", "root_ts").orderBy("ts", "uuid")
    whole = Window.partitionBy("channel", "root_ts")
    return placed.withColumn("place", F.row_number().over(own) - 1).withColumn("root_uuid", F.min(F.when(F.col("ts") == F.col("root_ts"), F.col("uuid"))).over(whole))


def phone_log(texts: DataFrame, calls: DataFrame) -> DataFrame:
    """Texts ``(number, at_ms, outgoing, body, name)`` and calls ``(number, at_ms, outgoing, seconds, name)`` as items of one chat for each number.

    A call's text states its direction and its length as h:mm:ss. The chat's name is the first that isn't a number, else the first at all, else the number; items have their month.
    """
    s = F.col("seconds")
    length = F.concat_ws(":", F.floor(s / 3600).cast("string"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))
    spoken = calls.select("number", "at_ms", "outgoing", F.concat(F.when(F.col("outgoing"), "Outgoing").otherwise("Incoming"), F.lit(" call "), length).alias("text"), "name", F.lit("call").alias("kind"))
    both = texts.select("number", "at_ms", "outgoing", F.col("body").alias("text"), "name", F.lit("text").alias("kind")).unionByName(spoken)
    named = both.groupBy("number").agg(display_name(F.col("name"), F.struct("at_ms", "kind", "text")).alias("display"))
    return both.drop("name").join(named, "number", "left").withColumn("display", F.coalesce("display", F.col("number"))).withColumn("period", period_key(F.col("at_ms"), "month"))


def review_timeline(reviews: DataFrame, general: DataFrame, inline: DataFrame, tasks: int | None = None) -> DataFrame:
    """A request's notes in their order: reviews and general comments by time, then inline ones by (path, line) of the thread they are in, then time.

    ``reviews`` and ``general``: ``(request, id, at, author, body)``; ``inline`` also ``path``, ``line`` and ``reply_to``: a reply takes its parent's place.
    ``tasks``: how many tasks the notes are dealt to, where their number isn't left to Spark.
    """
    placed = thread_anchor(inline.withColumn("thread", F.coalesce("reply_to", "id")).withColumnRenamed("reply_to", "parent"), "id", "parent", ["path", "line"])
    head = lambda d, n: d.select("request", "id", "at", "author", "body", F.lit(n).alias("section"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("line"), F.col("id").alias("thread"))
    both = head(reviews, 0).unionByName(head(general, 1)).unionByName(placed.select("request", "id", "at", "author", "body", F.lit(2).alias("section"), "path", F.col("line").cast("long").alias("line"), "thread"))
    both = both.repartition(tasks, "request") if tasks else both
    order = [F.col("section"), F.col("path").asc_nulls_first(), F.col("line").asc_nulls_first(), F.when(F.col("section") == 2, F.col("thread")).asc_nulls_first(), F.col("at"), F.col("id")]
    return both.withColumn("place", (F.row_number().over(Window.partitionBy("request").orderBy(*order)) - 1).cast("long"))


def discussions(notes: DataFrame) -> DataFrame:
    """Notes ``(request, discussion, id, at, system)`` with ``discussion_index``, ``note_index`` and ``kind``.

    Discussions are in the order of their first note's time, notes in theirs. A discussion whose first note the system wrote is an event and
    not a thread; a system note inside a thread keeps its place. A note without a discussion is one of its own.
    """
    owned = notes.withColumn("discussion", F.coalesce(F.col("discussion").cast("string"), F.concat(F.lit("note-"), F.col("id").cast("string"))))
    heads = owned.groupBy("request", "discussion").agg(F.min(F.struct("at", "id", "system")).alias("head"))
    ordered = heads.withColumn("discussion_index", F.row_number().over(Window.partitionBy("request").orderBy("head.at", "head.id")) - 1)
    placed = owned.join(ordered, ["request", "discussion"])
    index = F.row_number().over(Window.partitionBy("request", "discussion").orderBy("at", "id")) - 1
    kind = F.when(F.col("head.system"), "event").when(F.col("system"), "system note").when((F.col("at") == F.col("head.at")) & (F.col("id") == F.col("head.id")), "thread").otherwise("reply")
    return placed.select(*notes.columns, "discussion_index", index.alias("note_index"), kind.alias("kind"))


def space_periods(messages: DataFrame, period: str = "month") -> DataFrame:
    """A document for each room and period of ``messages (space, sender, at_ms, text)``: counts, who wrote, first and last time, and whether it is a direct chat.

    A room is direct where no more than two ever wrote in it.
    """
    writers = messages.groupBy("space").agg(F.countDistinct("sender").alias("writers"))
    by = messages.withColumn("period", period_key(F.col("at_ms"), period)).groupBy("space", "period")
    documents = by.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sender").alias("senders"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))
    return documents.join(writers, "space").withColumn("direct", F.col("writers") <= 2).drop("writers")


def post_key(link: Column, position: Column) -> Column:
    """A post's key: the name (URN) that its link states, plain or percent-encoded, else the link without query and end slash, else its place."""
    plain = F.url_decode(F.replace(F.regexp_replace(link, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))
    urn = F.regexp_extract(plain, r"urn:li:[A-Za-z]+:[0-9]+", 0)
    numbered = F.regexp_extract(plain, r"-(activity|share|ugcPost)-([0-9]+)", 2)
    kind = F.regexp_extract(plain, r"-(activity|share|ugcPost)-([0-9]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(link, r"[?#].*$", ""), "/+$", "")
    return F.when(urn != "", urn).when(numbered != "", F.concat(F.lit("urn:li:"), kind, F.lit(":"), numbered)).when(bare != "", bare).otherwise(F.concat(F.lit("position:"), position.cast("string")))


def contact_text(display: Column, key: Column, fields: Column) -> Column:
    """A contact's search text: its name (its id where it has none), then the value of every field on a line of its own."""
    title = F.coalesce(F.nullif(F.trim(display), F.lit("")), key)
    return F.concat_ws("\n", title, F.transform(fields, lambda f: f["value"]))


def sentence_edges(groups: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """A link for each pair of sentences in an aligned group, and one for each pair of documents."""
    return groups.select(key, F.explode(left).alias("src"), right).select(key, "src", F.explode(right).alias("dst")).distinct()
