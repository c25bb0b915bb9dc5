"""HTML extraction by tag-path ratios.

A page is read as a sequence of text blocks, each with its root-to-leaf path of block
elements (inline ones such as ``b`` or ``a`` don't split a block). For each path the text
length, the punctuation, the linked length and the number of leaves are summed; a path's ratio
is its unlinked text and its punctuation for each leaf. Ratios are smoothed over the page with
a Gaussian over neighbouring blocks, the text and the punctuation ratio are fused, and paths
over a threshold (a share of the page's spread) hold the content. That a page names its main
element is a prior: blocks outside it count ``OUTSIDE`` of their fused ratio, and all must pass the threshold.

Paths are judged with the path that encloses them: where running text (paths whose ratio is the page's mean or more) lies
directly in a container, the container is a region, and its short blocks (lists, tables, verse, code, headings) are content as the text
around them is. In the page's main element a region holds all below it, elsewhere what its lists, tables and the like hold. Lists of
links outside regions are left out.
Elements that are not content by name, role or a whole class name are left out, unless they wrap
the main element or, on a page that names none, most of the unlinked text.

Pages are independent, so this is one map over the rows.

Defined cases: null or empty html gives an empty text; markup that ends early is read as far as
it goes; a page without any block over the threshold gives an empty text; very long pages are
read whole; rows with null or repeated ids give one row each.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, to_batches

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SKIPPED = re.compile(r"[\s/]*")
_ATTRIBUTE_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

# Element names of HTML by their part in a page's layout.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source audio video map area".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = frozenset("ul ol dl table article section main div".split())
#: Elements that part a text without being parts of a page.
_TEXT_PARTS = frozenset("p ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption h1 h2 h3 h4 h5 h6 hr address details summary".split())
_DROPPED = frozenset("nav footer aside form head button menu dialog".split())
_HIDDEN = frozenset("head svg math template select object canvas datalist".split())
#: Elements whose content is text up to their own end tag, and never the page's.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style textarea title iframe noembed noframes noscript xmp".split()}
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist form".split())
_DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar"
    " footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies"
    " respond share sharing social related recommended widget toolbar pagination pager copyright disclaimer skip".split()
)
#: Beginnings of class names that are parts of the same kinds, and words of inline elements that aren't the text's.
_DROPPED_PREFIXES = ("ad-", "ads-", "advert", "comment-", "comments-", "comment_", "sidebar-", "share-", "sharing-", "social-", "cookie-", "newsletter-", "breadcrumb", "nav-", "footer-", "menu-", "promo-", "sponsor", "related-posts", "related-articles", "related-links", "popup-", "modal-")
_MUTED_WORDS = frozenset("ad ads advert adverts advertisement sponsored".split())
#: What a block outside the page's named main element counts of its fused ratio.
OUTSIDE = 0.2
_MAIN_WORDS = frozenset("article-body articlebody post-content entry-content main-content article-content story-body".split())


#: Whether an element can hold content: yes; only as the wrapper of the page's main part; never.
_CONTENT, _WRAPPER, _NEVER = 0, 1, 2


def _is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))


def _part(tag: str, attributes: dict[str, str], in_main: bool, in_article: bool) -> int:
    if tag in _HIDDEN or attributes and _is_hidden(attributes):
        return _NEVER
    if tag in _DROPPED or tag == "header" and not in_main or tag == "article" and in_article or attributes.get("role", "").lower() in _DROPPED_ROLES:
        return _WRAPPER
    named = {*attributes.get("class", "").lower().split(), attributes.get("id", "").lower()}
    if tag in ("body", "html", "article", "main") or _DROPPED_WORDS.isdisjoint(named) and not any(x.startswith(_DROPPED_PREFIXES) for x in named):
        return _CONTENT
    return _WRAPPER


@dataclass
class Element:
    """An element of a page: its parent's number, its path's, what it can hold, how it names itself the main one, its unlinked text."""

    parent: int
    path: int
    part: int
    main: int  # 2: main element or role, 1: article or class, 0: not named
    inside: bool = False  # it or one around it is named
    article: bool = False
    length: int = 0


class Blocks:
    """The text blocks of one page: ``(path, text, linked characters, inside the main element)``.

    Markup is read once from left to right, each tag by its attributes as browsers do, so that broken pages take no longer than others.
    """

    def __init__(self, page: str):
        self.read: list[tuple[int, str, int, int]] = []  # path, text, linked characters, element
        self.elements = [Element(0, 0, _CONTENT, 0)]
        self.paths: dict[tuple[int, str], int] = {}
        self.open: list[tuple[str, int]] = []  # tag, element
        self.count: dict[str, int] = defaultdict(int)
        self.text: list[str] = []
        self.linked = self.link_depth = 0
        self.muted: list[str] = []  # an inline element that isn't text, and those of its name in it
        self.muted_at = 0
        self._parse(page)
        self._flush()
        self.found = self._kept()

    def _parse(self, page: str) -> None:
        at, n, last = 0, len(page), page.rfind(">")
        while at < n:
            begin = page.find("<", at)
            if begin < 0:
                self._words(page[at:])
                return
            if begin > at:
                self._words(page[at:begin])
            after = page[begin + 1 : begin + 2]
            closing = after == "/"
            name = _NAME.match(page, begin + 1 + closing)
            if name:
                if begin > last:
                    return  # a tag that the page's end cuts
                tag = name[0].lower()
                if closing:
                    self._end(tag)
                    at = page.find(">", name.end()) + 1
                    continue
                at, attributes, closed = self._attributes(page, name.end())
                if at > n:
                    return
                self._begin(tag, attributes, closed)
                if tag in _RAW and not closed:
                    end = _RAW[tag].search(page, at)
                    at = end.start() if end else n
            elif page.startswith("<!--", begin):
                end = page.find("-->", begin + 2 if page.startswith("<!-->", begin) else begin + 4)
                at = end + 3 if end >= 0 else n
            elif after in ("!", "?", "/"):
                end = page.find(">", begin + 2)
                at = end + 1 if end >= 0 else n
            else:
                self._words("<")
                at = begin + 1

    @staticmethod
    def _attributes(page: str, at: int) -> tuple[int, dict[str, str], bool]:
        """Where the tag ends (beyond the page's end if it doesn't), its attributes, and whether it closes itself."""
        n, found = len(page), {}
        while True:
            skipped = _SKIPPED.match(page, at)
            at = skipped.end()
            if at >= n:
                return n + 1, found, False
            if page[at] == ">":
                return at + 1, found, skipped[0].endswith("/")
            name = _ATTRIBUTE_NAME.match(page, at)
            at, value = name.end(), ""
            if equals := _EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                if quote in ('"', "'"):
                    end = page.find(quote, at + 1)
                    if not quote or end < 0:
                        return n + 1, found, False
                    value, at = page[at + 1 : end], end + 1
                else:
                    value = _UNQUOTED.match(page, at)[0]
                    at += len(value)
            found.setdefault(name[0].lower(), entities.unescape(value) if "&" in value else value)

    def _words(self, raw: str) -> None:
        if self.muted:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        self.text.append(text)
        if self.link_depth:
            self.linked += len(text.strip())

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                element = self.open[-1][1] if self.open else 0
                linked = min(self.linked, len(text))
                self.read.append((self.elements[element].path, text, linked, element))
                self.elements[element].length += len(text) - linked
            self.text = []
        self.linked = 0

    def _pop(self, upto: int) -> None:
        for tag, _ in self.open[upto:]:
            self.count[tag] -= 1
        del self.open[upto:]
        if self.muted and upto < self.muted_at:
            self.muted = []

    def _begin(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if tag == "br":
            self.text.append(" ")
        elif tag in _INLINE:
            if tag in _VOID:
                return
            if self.muted:
                if tag == self.muted[0]:
                    self.muted.append(tag)
            elif attributes and (_is_hidden(attributes) or not _MUTED_WORDS.isdisjoint(attributes.get("class", "").lower().split())):
                self.muted, self.muted_at = [tag], len(self.open)
            if tag == "a":
                self.link_depth += 1
        elif tag not in _RAW:
            self._start(tag, attributes, closed)

    def _start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        self._flush()
        if tag in _CLOSES_P and self.open and self.open[-1][0] == "p":
            self._pop(len(self.open) - 1)
        for own in _CLOSES_OWN.get(tag, ()):
            if self.count[own]:
                for k in range(len(self.open) - 1, -1, -1):
                    if self.open[k][0] == own:
                        self._pop(k)
                        break
                    if self.open[k][0] in _STOPS:
                        break
        if tag in _VOID or closed and tag not in _CLOSES_P:
            return
        parent = self.open[-1][1] if self.open else 0
        around = self.elements[parent]
        names = attributes.get("class", "").split()
        main = 2 if tag == "main" or attributes.get("role") == "main" else int(tag == "article" or not _MAIN_WORDS.isdisjoint(attributes.get("class", "").lower().split()))
        step = f"{tag}.{names[0]}" if names else tag
        path = self.paths.setdefault((around.path, step), len(self.paths) + 1)
        part = _part(tag, attributes, around.inside, around.article)
        self.elements.append(Element(parent, path, part, 0 if tag == "article" and around.article else main, bool(main) or around.inside, tag == "article" or around.article))
        self.open.append((tag, len(self.elements) - 1))
        self.count[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in _INLINE:
            if self.muted and tag == self.muted[0]:
                self.muted.pop()
            if tag == "a":
                self.link_depth = max(0, self.link_depth - 1)
            return
        self._flush()
        if self.count[tag]:
            k = len(self.open) - 1
            while self.open[k][0] != tag:
                k -= 1
            self._pop(k)
        self.link_depth = 0

    def _worst(self) -> list[int]:
        """For each element the worst part of itself and all around it; parents come before their children."""
        worst: list[int] = []
        for k, e in enumerate(self.elements):
            worst.append(max(e.part, worst[e.parent]) if k else e.part)
        return worst

    def _kept(self) -> list[tuple[int, str, int, bool]]:
        """The blocks that no element leaves out, once wrappers of the page's main part are known not to."""
        elements, worst = self.elements, self._worst()
        own = [e.length if w < _NEVER else 0 for e, w in zip(elements, worst)]
        whole = list(own)
        for k in range(len(elements) - 1, 0, -1):
            whole[elements[k].parent] += whole[k]
        named = [k for k, e in enumerate(elements) if e.main and worst[k] < _NEVER]
        main = max(named, key=lambda k: (worst[k] == _CONTENT, elements[k].main, whole[k]), default=None)
        if main is not None and worst[main] == _WRAPPER and elements[main].main == 1 and 2 * whole[main] < whole[0]:
            main = None  # a teaser among the elements left out
        if main is not None:
            at = main
            while at:
                elements[at].part = _CONTENT
                at = elements[at].parent
        else:
            for e, n in zip(elements, whole):
                if e.part == _WRAPPER and 2 * n > whole[0]:
                    e.part = _CONTENT
        worst = self._worst()
        return [(path, text, linked, elements[k].inside) for path, text, linked, k in self.read if worst[k] == _CONTENT]


def _smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """A Gaussian over neighbours, two to each side, normalised at the ends."""
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(3)]
    out = []
    for i in range(len(values)):
        near = [(weights[abs(j - i)], values[j]) for j in range(max(0, i - 2), min(len(values), i + 3))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def main_text(page: str, share: float = 0.5, link_share: float = 0.6) -> str:
    """The content blocks of one page in their order, joined by an empty line."""
    parsed = Blocks(page)
    blocks = parsed.found
    named = any(b[3] for b in blocks)
    paths: dict[int, list[float]] = {}
    for path, text, linked, _ in blocks:
        sums = paths.setdefault(path, [0.0, 0.0, 0.0, 0.0])
        for k, v in enumerate((len(text), len(_PUNCTUATION.findall(text)), linked, 1)):
            sums[k] += v
    linked_lists = {p for p, (n, _, linked, _) in paths.items() if linked > link_share * n}
    text_ratio = _smooth([max(0.0, paths[b[0]][0] - paths[b[0]][2]) / paths[b[0]][3] for b in blocks])
    mark_ratio = _smooth([paths[b[0]][1] / paths[b[0]][3] for b in blocks])
    fused: dict[int, list[float]] = {}
    for (path, _, _, inside), t, p in zip(blocks, text_ratio, mark_ratio):
        fused.setdefault(path, []).append(t * (1 + p) * (OUTSIDE if named and not inside else 1.0))
    ratios = {p: sum(v) / len(v) for p, v in fused.items()}
    mean = sum(ratios.values()) / max(1, len(ratios))
    spread = math.sqrt(sum((v - mean) ** 2 for v in ratios.values()) / max(1, len(ratios)))
    least = share * min(spread, mean) if len(ratios) > 1 else 0.0
    chosen = {p for p, v in ratios.items() if v >= least} - linked_lists
    around = {path: (parent, step.partition(".")[0]) for (parent, step), path in parsed.paths.items()}
    regions = {around[p][0] for p in chosen if p in around and ratios[p] >= mean}
    held: dict[tuple[int, bool], bool] = {}

    def in_region(path: int, inside: bool) -> bool:
        """Whether the path or one around it is a region, reached through any element in the main one, else through parts of text alone."""
        if (path, inside) not in held:
            parent, tag = around.get(path, (0, ""))
            held[path, inside] = path in regions or path != 0 and (inside or tag in _TEXT_PARTS) and in_region(parent, inside)
        return held[path, inside]

    # outer paths have smaller numbers, so that none is asked for before the one around it
    for path, (_, _) in sorted(around.items()):
        in_region(path, True), in_region(path, False)
    return "\n\n".join(b[1] for b in blocks if b[0] in chosen or in_region(b[0], b[3]))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` for every page; ``url`` is null where the input has none."""
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(F.col(id_col).alias("id"), url.cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches):
        for batch in batches:
            ids = column(batch, "id")
            schema = pa.schema([("id", ids.type), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

            def out():
                for key, link, page in zip(ids.to_pylist(), column(batch, "url").to_pylist(), column(batch, "html").to_pylist()):
                    text = main_text(page)
                    yield key, link, text, len(text)

            yield from to_batches(out(), schema)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")
