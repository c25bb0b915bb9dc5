import hashlib
import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from mnemora.llm import byte_bpe, class_lm, html_extract, media, packing, quality

from .data import corpus, frame, odd_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@lru_cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@lru_cache
def _word_tokens():
    return packing.WordTokens(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
@example("hello <|startoftext|> world")
@example("Up<|endoftext|>DOWN <|ENDOFTEXT|> <| X")
def test_word_tokens_are_the_tokenizers(text):
    ids = np.frombuffer(_word_tokens().of(text.encode("utf-8", "replace")), "<u4").tolist()
    assert ids == _tokenizer().encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids


def test_packing_keeps_every_id_once(spark):
    rows = corpus(80) + [(900, "word " * 5000)]
    tokenizer = _tokenizer()
    pieces = packing.pack(frame(spark, rows), WORDS, size=256).collect()
    whole = defaultdict(dict)
    for p in pieces:
        assert p.length == len(p.ids) // 4
        whole[p.id][p.start] = np.frombuffer(p.ids, "<u4").tolist()
    for i, t in rows:
        ids = [x for s in sorted(whole[i]) for x in whole[i][s]]
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids + [1]
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0


def test_level_rule_is_the_least_sum_of_squares():
    packer = packing.Packer(size=16)
    rng = np.random.default_rng(1)
    packer.counts[1:16] = rng.integers(0, 4, 15)
    for length in range(1, 16):
        total = lambda n: int((n[1:16] ** 2).sum())
        options = {}
        for level in range(0, 16 - length + 1):
            if level == 0 or packer.counts[level]:
                n = packer.counts.copy()
                n[level] -= level > 0
                n[level + length] += 1
                options[level] = total(n)
        assert options[packer.level_for(length)] == min(options.values())


def test_most_windows_are_filled_by_the_rule():
    rng = np.random.default_rng(3)
    packer = packing.Packer()
    items = [bytes(4 * int(x)) for x in rng.lognormal(6, 1, 3000).clip(1, 2047)]
    windows = [w for k, ids in enumerate(items) for w in packer.add(k, ids)]
    kept = packer.by_rule
    windows += packer.finish()
    lengths = [sum(len(p[2]) for p in w) // 4 for w in windows]
    assert sum(lengths) == sum(map(len, items)) // 4 and all(n == 2048 or n & (n - 1) == 0 for n in lengths)
    share = packer.moved / sum(lengths)
    print(f"{kept / sum(lengths):.2f} of the ids are in windows that the rule filled, {share:.2f} were moved at the end")
    assert share < 0.15


def test_packing_odd_rows(spark):
    docs = odd_rows(spark)
    got = packing.digest(packing.pack(docs, WORDS))
    assert got.where("doc_id in (1, 2, 3)").selectExpr("sum(length)").first()[0] == 3
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav>
    <div class="ad">Buy now.</div><script>var t="</p>";</script><article><h1>A &amp; B&amp;</h1><p><b>First, para.<br><p>Second
    para; more&nbsp;text.</p><form><input>Join</form><aside>Side.</aside><ul><li>One.<li>Two.</ul></article>
    <section class="comments"><p>Nice post, really nice, I liked it.</p></section><footer>&copy; x</footer>"""
    assert html_extract.main_text(page) == "A & B&\n\nFirst, para.\n\nSecond para; more text.\n\nOne.\n\nTwo."


def test_html_without_named_main():
    body = "".join(f"<p>Sentence {i}, with several words and marks; it goes on for a while, as text does.</p>" for i in range(6))
    page = f"<html><body><div id=top><a href=a>Home</a> <a href=b>News</a></div><div class=content>{body}</div><div><span>ok</span></div></body></html>"
    text = html_extract.main_text(page)
    assert text.count("Sentence") == 6 and "Home" not in text


LONG = "".join(f"<p>Sentence {i}, with several words and marks; it goes on for a while, as text does.</p>" for i in range(8))
#: Parts of an article in short blocks, with how often each holds its word.
SHORT_PARTS = {
    "list": ("<h2>Ingredients</h2><ul>" + "".join(f"<li>{k} unit eggs</li>" for k in range(12)) + "</ul>", 12),
    "table": ("<table>" + "".join(f"<tr><td>unit {k}</td><td>unit {k * k}</td></tr>" for k in range(12)) + "</table>", 24),
    "references": ("<h2>References</h2><ul>" + "".join(f'<li><a href="x{k}">unit {k}</a></li>' for k in range(5)) + "</ul>", 5),
    "verse": ("".join(f"<div class=line>a unit of verse {k}</div>" for k in range(12)), 12),
    "code": ("".join(f"<pre>unit({k})</pre>" for k in range(6)), 6),
    "headings": ("".join(f"<h3>Unit part {k}, unit</h3><p>Yes.</p>" for k in range(3)), 3),
}


@pytest.mark.parametrize("part", SHORT_PARTS)
def test_html_short_parts_of_an_article_stay(part):
    markup, n = SHORT_PARTS[part]
    for page in (f"<article><h1>Title of it</h1>{LONG}{markup}</article>", f"<article><h1>Title of it</h1>{markup}{LONG}</article>", f"<main>{LONG[: len(LONG) // 16 * 8]}{markup}{LONG}</main>"):
        text = html_extract.main_text(f"<html><body>{page}</body></html>")
        assert text.count("unit") + text.count("Unit part") - (n if part == "headings" else 0) == n, part
    for k in (0, 1):
        if part not in ("verse",):  # without a main element lines in boxes of their own are no parts of the text
            text = html_extract.main_text(f"<html><body><div class=text>{LONG if k else ''}{markup}{'' if k else LONG}</div></body></html>")
            assert text.count("unit") == n, part


def chrome(kind, k):
    """What surrounds an article and is named by nothing that tells it."""
    boxes = {
        "tools": "".join(f"<div class=t{k}>Tool {i}</div>" for i in range(12)), "links": "<ul class=x>" + "".join(f"<li><a href=a{i}>Place {i}</a></li>" for i in range(9)) + "</ul>",
        "labels": "".join(f"<div class=box><span class=z>Label {i}</span> of {i}</div>" for i in range(6)), "dates": "".join(f"<div class=d{k}><b>{i} May</b></div>" for i in range(5)),
    }
    return boxes[kind]


def test_html_ratios_decide_outside_the_text():
    """Hand-written pages whose chrome has no telling names: the ratios alone leave it out, and keep the text whole."""
    for k, kind in enumerate(("tools", "links", "labels", "dates")):
        box = chrome(kind, k)
        for page in (f"{box}<div class=body>{LONG}</div>", f"<div class=body>{LONG}</div>{box}", f"<div class=a><section class=s>{LONG}</section></div><div class=b>{box}</div>", f"<article>{LONG}</article><div class=c>{box}</div>"):
            text = html_extract.main_text(f"<html><body>{page}</body></html>")
            assert text.count("Sentence") == 8 and text == "\n\n".join(x for x in text.split("\n\n") if x.startswith("Sentence")), (kind, page[:40])


def test_html_wrappers_of_the_main_part_stay():
    body = "".join(f"<p>Sentence {i}, with several words and marks; it goes on for a while, as text does.</p>" for i in range(6))
    aside = '<div class="sidebar"><article><p>A teaser, short.</p></article></div>'
    for wrapper in ('<div class="content no-sidebar">', '<div id="page-with-comments">', '<div class="overlay">', "<form>"):
        end = f"</{wrapper[1:].split()[0].rstrip('>')}>"
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", body):
            text = html_extract.main_text(f"<html><body>{wrapper}{inner}{end}{aside}</body></html>")
            assert text.count("Sentence") == 6 and "teaser" not in text, (wrapper, inner[:6])
    hidden = html_extract.main_text(f"<html><body><div hidden>{body}</div><p>Shown, in part.</p></body></html>")
    assert hidden == "Shown, in part."


def test_html_broken_markup():
    text = html_extract.main_text(
        "<article><svg class=i /><p>First sentence, is here.</p><title-card>Card text, too.</title-card><p title=it's>Quote, fine, a < b.</p>"
        "<p>An <span class='ad'>AD</span>end <span hidden>no <span>more</span></span>here, now.</p><div class='related-work'>Work, it is related, it stays.</div>"
        "<article class=reply><p>Reader, one of them, says so.</p></article><div class='comment-item'>Another, the last.</div></article>"
    )
    assert text == "First sentence, is here.\n\nCard text, too.\n\nQuote, fine, a < b.\n\nAn end here, now.\n\nWork, it is related, it stays."


@pytest.mark.parametrize("part", ['<a "', '<p x="', "<div>", "<!--", "<li>", "<span hidden>", "<script>", "<"])
def test_html_time_grows_with_length_alone(part):
    import time

    def took(n):
        page = part * n + "<p>end"
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    took(1000)
    assert took(80_000) < 0.2 + 8 * took(20_000)


def test_html_ratios_of_every_page(spark, sf_dir):
    """A plain version of ratios, smoothing, fusion and threshold decides the blocks of every driver page alike."""
    pages = [r.html or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    decided = 0
    for page in pages:
        blocks = html_extract.Blocks(page).found
        by = defaultdict(list)
        for n, b in enumerate(blocks):
            by[b[0]].append(n)
        size = lambda ns, f: sum(f(blocks[n]) for n in ns)
        text = {p: max(0, size(ns, lambda b: len(b[1])) - size(ns, lambda b: b[2])) / len(ns) for p, ns in by.items()}
        marks = {p: size(ns, lambda b: sum(c in ".,;:!?…。，、；：！？¿¡" for c in b[1])) / len(ns) for p, ns in by.items()}

        def smooth(ratio, n):
            near = {m: math.exp(-((m - n) ** 2) / 2) for m in range(n - 2, n + 3) if 0 <= m < len(blocks)}
            return sum(w * ratio[blocks[m][0]] for m, w in near.items()) / sum(near.values())

        named = any(b[3] for b in blocks)
        fused = [smooth(text, n) * (1 + smooth(marks, n)) * (html_extract.OUTSIDE if named and not b[3] else 1) for n, b in enumerate(blocks)]
        ratios = {p: sum(fused[n] for n in ns) / len(ns) for p, ns in by.items()}
        values = list(ratios.values())
        least = 0.5 * min(np.std(values), np.mean(values)) if len(values) > 1 else 0
        passes = {p for p in by if ratios[p] >= least and size(by[p], lambda b: b[2]) <= 0.6 * size(by[p], lambda b: len(b[1]))}
        parent = {path: (up, step.split(".")[0]) for (up, step), path in html_extract.Blocks(page).paths.items()}
        regions = {parent[p][0] for p in passes if p in parent and ratios[p] >= np.mean(values)}

        def region(path, inside):
            while path not in regions:
                if path not in parent or not (inside or parent[path][1] in html_extract._TEXT_PARTS):
                    return False
                path = parent[path][0]
            return True

        kept = [b[1] for b in blocks if b[0] in passes or region(b[0], b[3])]
        assert html_extract.main_text(page) == "\n\n".join(kept)
        decided += len(kept) < len(blocks)
    print(f"on {decided} of {len(pages)} pages the ratios leave blocks out")


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "z"), (None, None, "<p>x", "z"), (2, "v", "", "z"), (2, "v", "<", "z")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_quality_separates_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_is_the_plain_discriminant(spark, sf_dir):
    """Scores by densities with inverses and determinants, from numpy's covariances."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    x = {r.doc_id: quality.statistics((r.text or "").encode()) for r in docs.collect()}
    rows = [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id in x and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5]
    of = [np.array([x[i] for i, q in rows if q == k]) for k in (0, 1)]
    d, n = len(quality.STATISTICS), [len(v) for v in of]
    covs = [np.cov(v.T, bias=True) for v in of]
    both = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    log = []
    for k in (0, 1):
        own = 0.1 + 0.9 * d / (d + n[k])
        c = (1 - own) * covs[k] + own * both
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-4 * np.eye(d)
        inverse, mean = np.linalg.inv(c), of[k].mean(0)
        log.append({i: math.log(n[k] / sum(n)) - np.linalg.slogdet(c)[1] / 2 - (v - mean) @ inverse @ (v - mean) / 2 for i, v in x.items()})
    got = {r.id: r.score for r in quality.classify(docs, labels).collect()}
    want = {i: 1 / (1 + math.exp(min(60, max(-60, (log[0][i] - log[1][i]) / math.sqrt(d))))) for i in x}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_quality_odd_rows(spark):
    docs = odd_rows(spark)
    labels = spark.createDataFrame([(1, None, 0), (4, 1, 0), (4, 1, 0), (None, 0, 0), (5, 7, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) == 1  # one class only
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_lm_counts_and_probabilities(spark):
    rows = corpus(60)
    taught = [t.encode().lower().split() + [None] for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in taught for w in t)
    n, v = sum(counts.values()), len(counts)
    shape = class_lm.Shape(frequent=20, pools=8, classes=6, iterations=2)
    got = {r.id: r for r in class_lm.score_texts(frame(spark, rows), shape=shape).collect()}
    for i, t in rows:
        w = t.encode().lower().split() + [None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score <= 0


def test_lm_probabilities_sum_to_one(spark):
    """Over all known words, the end and the unknown type, after each of two contexts."""
    train = [(i, t) for i, t in ((k, "a b a c") for k in range(40)) if zlib.crc32(str(i).encode()) % 5 != 1]
    probes = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:8]
    texts = ["", "a", "b", "c", "zz", "a a", "a b", "a zz"]
    shape = class_lm.Shape(frequent=2, pools=2, classes=4, iterations=2)
    got = {r.id: r for r in class_lm.score_texts(frame(spark, train + list(zip(probes, texts))), shape=shape).collect()}
    p = {t: 10 ** got[i].score for i, t in zip(probes, texts)}
    first = {w: None for w in ("a", "b", "c", "zz")}
    assert 0 < sum(p.values()) < 1 + 1e-9  # texts are disjoint events
    assert p[""] < 1 and all(p[w] > 0 for w in first)


def test_lm_scores_are_the_plain_ones(spark, monkeypatch):
    """Class and word probabilities summed token by token, with given classes, from counts in dictionaries."""
    rows = corpus(60) + [(900, ""), (901, "never seen before"), (902, "A a\ta")]
    shape = class_lm.Shape(frequent=20, pools=8, classes=6, iterations=2)
    given_classes = np.arange(shape.units) * 7 % (shape.classes - 1) + 1
    given_classes[0] = 0
    monkeypatch.setattr(class_lm, "cluster", lambda found, s: (given_classes, class_lm._matrices(found, given_classes, s)))
    got = {r.id: r.score for r in class_lm.score_texts(frame(spark, rows, 4), shape=shape).collect()}

    texts = {i: [*t.encode().lower().split(), None] for i, t in rows}
    taught = [w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(x for w in taught for x in w)
    n, v, ends = sum(counts.values()), len(counts), counts[None]
    often = sorted((x for x in counts if x is not None), key=lambda x: (-counts[x], x))[: shape.frequent]

    def of(x):
        unit = 0 if x is None else 1 + often.index(x) if x in often else 1 + shape.frequent + zlib.crc32(x[-3:]) % shape.pools
        return int(given_classes[unit])

    moves, into, after, once = Counter(), Counter(), Counter(), Counter()
    for w in taught:
        for previous, x in zip([None, *w], w):
            moves[of(previous), of(x)] += 1
            into[of(x)] += 1
            after[of(previous)] += 1
            once[of(previous)] += x is not None and counts[x] == 1
    unseen = (sum(once.values()) + 1) / (n + 2)
    assert ends > 1
    for i, w in texts.items():
        plain = 0.0
        for previous, x in zip([None, *w], w):
            p, c = of(previous), of(x)
            unknown = (once[p] + 20 * unseen) / (after[p] + 20)
            follow = (moves[p, c] + 50 * into[c] / n) / (after[p] + 50)
            own = follow * (1 - unknown) * counts[x] / into[c] if counts[x] else unknown
            plain += math.log10((1 - shape.unigram) * own + shape.unigram * (counts[x] + 0.5) / (n + 0.5 * (v + 1)))
        assert abs(got[i] - plain) < 1e-9 * max(1, abs(plain))


def test_lm_exchange_gains_likelihood(spark):
    """The classes kept are at least as likely as those it begins with, counted from the texts alone."""
    rows = corpus(60)
    shape = class_lm.Shape(frequent=30, pools=8, classes=6, iterations=4)
    held = {}
    cluster = class_lm.cluster

    def kept(found, s):
        held["classes"], matrices = cluster(found, s)
        return held["classes"], matrices

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(class_lm, "cluster", kept)
        class_lm.score_texts(frame(spark, rows, 4), shape=shape).count()
    taught = [t.encode().lower().split() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(x for w in taught for x in w)
    often = {x: j + 1 for j, x in enumerate(sorted(counts, key=lambda x: (-counts[x], x))[: shape.frequent])}

    def likelihood(classes):
        pairs, sizes = Counter(), Counter()
        for w in taught:
            cs = [classes[often.get(x) or 1 + shape.frequent + zlib.crc32(x[-3:]) % shape.pools] for x in w] + [0]
            pairs.update(zip([0, *cs], cs))
            sizes.update(cs)
        return sum(m * math.log(m) for m in pairs.values()) - 2 * sum(m * math.log(m) for m in sizes.values())

    start = np.arange(shape.units) % (shape.classes - 1) + 1
    start[0] = 0
    assert likelihood([int(c) for c in held["classes"]]) > likelihood([int(c) for c in start])


def test_lm_odd_rows(spark):
    docs = odd_rows(spark)
    shape = class_lm.Shape(frequent=16, pools=4, classes=4, iterations=1)
    got = class_lm.score_texts(docs, shape=shape).collect()
    assert len(got) == docs.count() and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert class_lm.score_texts(docs.limit(0), shape=shape).count() == 0
    none = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [r.score for r in class_lm.score_texts(none, shape=shape).collect()] == [0.0]


def _tiktoken():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_folds_like_the_library(text):
    import regex

    text = text.encode("utf-8", "replace").decode()
    words = byte_bpe.WordIds(RANKS)
    ids, decoded = words.of(regex.findall(public_tokenizers.PATTERN, text))
    assert ([int(x) for x in ids.split(",")] if ids else []) == _tiktoken().encode_ordinary(text)
    assert decoded == text.encode()
    assert [x for w in regex.findall(public_tokenizers.PATTERN, text) for x in byte_bpe.merge_long(w.encode(), RANKS)] == _tiktoken().encode_ordinary(text)


def test_bpe_higher_order_functions(spark):
    words = ["hello", " world", "éé", "thblewhe", "日本", " xqzjk", ""]
    got = {r.word: r.ids for r in byte_bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), RANKS).collect()}
    fold = byte_bpe.WordIds(RANKS).fold
    assert got == {w: fold(w.encode()) if w else [] for w in words}


def test_bpe_rows(spark):
    docs = odd_rows(spark)
    for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert _tiktoken().decode(r.ids).encode() == bytes(r.decoded)
    got = byte_bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN)
    assert got.where("id in (1, 2)").selectExpr("sum(n_tokens)").first()[0] == 0
    assert got.where("id = 1").first().ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_media_round_trip(spark):
    docs = odd_rows(spark)
    got = media.digest(media.read_media(media.store_texts(docs))).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append((r.text or "").encode())
    assert len(got) == docs.count()
    for r in got:
        payloads = [t + b" " * ((-len(t)) % 192 if t else 192) for t in texts[r.doc_id]]
        own = next(p for p, t in zip(payloads, texts[r.doc_id]) if hashlib.sha256(p).hexdigest() == r.payload_sha256 and len(t) == r.n_bytes)
        assert (r.payload_bytes, r.tail_crc32) == (len(own), zlib.crc32(own[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.wave(own)).hexdigest() and r.feature.startswith("type=audio/wav")


def test_media_features_are_the_plain_ones(spark):
    docs = spark.createDataFrame([(1, "abba cab"), (2, None), (3, "BM %PDF-1.4 RIFF " * 40)], "doc_id long, text string")
    for r in media.digest(media.read_media(media.store_texts(docs))).collect():
        text = {1: b"abba cab", 2: b"", 3: b"BM %PDF-1.4 RIFF " * 40}[r.doc_id]
        payload = text + b" " * (-len(text) % 192 or (0 if text else 192))
        common = sorted(Counter(payload).items(), key=lambda x: (-x[1], x[0]))[:4]
        top = ",".join(f"{v}:{c}" for v, c in common)
        assert r.feature == f"type=audio/wav;length={44 + len(payload)};samples={len(payload)};mean={sum(payload) / len(payload):.4f};top={top};embedded="
    assert media.digest(media.read_media(media.store_texts(docs.limit(0)))).count() == 0


def test_media_inside_media_is_carved_once(spark):
    import time

    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big") for k, d in ((b"IHDR", b"\0" * 13), (b"IEND", b"")))
    pdf = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF"
    wav = media.wave(b"12" + png + b"34")
    look = media.Sniffer()
    assert [(t, a) for a, t, _ in look(b"junk" + wav + pdf)] == [("audio/wav", 4), ("application/pdf", 4 + len(wav))]
    assert [(t, a) for a, t, _ in look(wav)] == [("audio/wav", 0), ("image/png", 46)]
    began = time.process_time()
    for part in (b"%PDF-1.4 ", b"\xff\xd8\xff\xda\x00\x02"):
        assert look(part * 200_000) == []
    assert time.process_time() - began < 20


def test_sniffing_corrects_and_carves(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big") for k, d in ((b"IHDR", b"\0" * 13), (b"IEND", b"")))
    wav = media.wave(b"ab" * 96)
    import gzip

    zipped = gzip.compress(b"some text")
    rows = [(1, png, "image/png"), (2, wav, "image/gif"), (3, b"junk" + png + b"RIFF no" + wav + zipped, None), (4, png[:-1], "image/png"), (5, None, None), (6, b"BM not a bitmap", "image/bmp")]
    got = {r.id: r for r in media.sniff(spark.createDataFrame(rows, "id long, value binary, declared string"), declared_col="declared").collect()}
    assert (got[1].media_type, got[1].corrected) == ("image/png", False)
    assert (got[2].media_type, got[2].corrected, got[2].media_length) == ("audio/wav", True, len(wav))
    assert [(e.type, bytes(e.bytes)) for e in got[3].embedded] == [("image/png", png), ("audio/wav", wav), ("application/gzip", zipped)]
    assert got[4].media_type == got[5].media_type == got[6].media_type == media.UNKNOWN
