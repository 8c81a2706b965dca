"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser streams a page's events once. Each block (a line here) gets the ratio of its text
to its tags; blocks in containers that say that they are menus, headers, adverts and the like have ratio zero.
The smoothed ratios that reach the threshold are content lines, their runs the clusters. The clusters choose the region:
the heaviest article or main element, with those that stand beside it as its equals, if these hold most of the clusters' text, else the
deepest element with nearly all of it. A chosen article is output whole, but for what such containers hold; of any other
region the lines that run with the clusters are, short ones too, from its heading on, but for menus.
"""

from __future__ import annotations

import math
import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Elements whose content is never text of the page; they part no block.
UNSEEN = frozenset("script style noscript template head title textarea select option svg iframe object audio video canvas datalist map".split())
#: Elements that are not the article, wherever they are.
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Elements that hold blocks; everything else that isn't INLINE only starts and ends a block.
HOLDERS = frozenset("html body article main section div aside nav header footer form menu dialog fieldset ul ol dl table tbody thead tfoot tr td th blockquote figure details center".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msubsup msup mtext q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OF_HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: in an article their classes name what they are about, so only STRONG words count.
TEXTS = HEADINGS | frozenset("p blockquote pre li dd dt td th figure figcaption".split())
#: Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay sidebar widget nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer colophon contentinfo complementary cookie cookies consent gdpr notice notices notification alert disclaimer newsletter subscribe subscription signup login "
    "search searchbox share sharing social related recommended recommendations comment comments reply replies respond discussion disqus pagination pager skip toolbar tags".split()
)
#: The same inside longer words.
MARKED = re.compile(r"(comment|reply|replies)(s|list|box|form|area|section|thread|block)$|^(advert|adsby|cookie|sidebar|newsletter|breadcrumb|disqus|sponsor|promo)|(nav|menu|banner|sidebar|footer|toolbar)$")
#: Blocks that a later one ends, if their own end tag is missing.
OPEN_ENDED = frozenset("p li dt dd".split()) | HEADINGS
OWN = frozenset(("article", "main"))
#: An article's classes often name its topics; only these take it out.
REPLIES = frozenset("comment comments reply replies respond discussion disqus".split())
#: Inside an article these words take out running text too, and the weak ones nothing: its own header and its boxes are its text.
STRONG = REPLIES | frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies newsletter".split())
WEAK = frozenset("header masthead alert notification disclaimer".split())
#: How lines at the edges of a region without an article element ask for something; one that ends as a sentence does stays whatever it says.
ASKING = re.compile(r"(subscribe|sign up|sign in|log in|follow us|share (this|on)|read more|click here|all rights reserved|copyright|\u00a9|related (posts|articles)|you may also|leave a (comment|reply)|accept (all )?cookies)\b", re.I)
SENTENCE = re.compile(r"[.!?:;\u2026\u3002\uff01\uff1f][\"'\u00bb\u201d\u2019)\]]*$")
#: Holders that a text runs through: what stands in them runs with what is around them.
RUNNING = frozenset("ul ol dl blockquote figure details".split()) | TEXTS
SIGMA, REACH = 1.0, 2
#: Shares of the clusters' text: that a region must hold, and that article elements must hold to be the region.
WHOLE, MOST = 0.85, 0.5
SLICE = 64
_KERNEL = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_TAG = re.compile(r"[A-Za-z][^\s/>]*")
#: The next end of a tag, or attribute with its value; a quote that is never closed is part of a name.
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|(=?[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?|=)""")
_COMMENT_END = re.compile(r"--!?>")
_LONG_NUMBER = re.compile(r"&#([0-9]{8,})")


def _marked(tag: str, attrs: list[tuple[str, str | None]], inside: bool = False) -> bool:
    """inside: whether an article element is open around the tag."""
    if not attrs or tag in ("html", "body"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role") and value:
            words = [w.lower() for w in _WORD.findall(value)]
            if tag in OWN:
                found = any(w in REPLIES for w in words)
            elif tag in HEADINGS or inside and tag in TEXTS:
                found = any(w in STRONG for w in words)
            else:
                found = any(not (inside and w in WEAK) and (w in MARKS or MARKED.search(w)) for w in words)
            if found:
                return True
    return False


class _Events(HTMLParser):
    """The parser's events of any text, in time in proportion to its length, for texts that are fed whole.

    Markup that never ends (a comment, tag or declaration without its >) takes the rest of the page with it, as in browsers, so nothing
    is looked at again; declarations of any kind are skipped; a comment also ends at --!>.
    """

    def parse_starttag(self, i):
        raw = self.rawdata
        at = (name := _TAG.match(raw, i + 1)).end()
        attrs = []
        while m := _ATTRIBUTE.match(raw, at):
            at = m.end()
            if m[1]:
                break
            if m[2]:
                value = next((v for v in m.group(3, 4, 5) if v is not None), None)
                attrs.append((m[2].lower(), unescape(value) if value else value))
        else:
            return len(raw)
        tag = name[0].lower()
        if m[0].endswith("/>"):
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return at

    def parse_endtag(self, i):
        end = self.rawdata.find(">", i + 2)
        if end < 0:
            return len(self.rawdata)
        if self.cdata_elem is not None:
            self.handle_endtag(self.cdata_elem)
            self.clear_cdata_mode()
        elif name := _TAG.match(self.rawdata, i + 2):
            self.handle_endtag(name[0].lower())
        return end + 1

    def parse_comment(self, i, report=True):
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.rawdata.index(">", i) + 1
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def _skip(self, i):
        end = self.rawdata.find(">", i + 2)
        return len(self.rawdata) if end < 0 else end + 1

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        if self.rawdata.startswith("<![CDATA[", i):
            end = self.rawdata.find("]]>", i)
            return len(self.rawdata) if end < 0 else end + 3
        return self._skip(i)

    parse_pi = _skip


class _Blocks(_Events):
    """Blocks as (text, tags, linked characters, number of the holder, outside, heading); work is constant for each event."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.holders: list[tuple[str, int, bool, bool]] = []  # tag, its number, unseen, outside
        self.open: dict[str, int] = {}  # holders by tag
        self.tag: list[str] = []  # by number
        self.own: list[bool] = []  # by number: article or main
        self.inside: list[bool] = []  # by number: in such an element, or one itself
        self.parent: list[int] = []
        self.blocks: list[tuple[str, int, int, int, bool, bool]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.pressed = self.buttons = 0
        self.heading = False

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text and len(text) > self.pressed:  # a button alone is no text
                at = self.holders[-1] if self.holders else ("", -1, False, False)
                self.blocks.append((text, self.tags, self.linked, at[1], at[3], self.heading))
                self.tags = 0
            self.linked = self.pressed = 0

    def _pop(self) -> str:
        tag = self.holders.pop()[0]
        self.open[tag] -= 1
        return tag

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.holders and self.holders[-1][0] == "head" and tag not in OF_HEAD:  # its end tag may be missing
            self._pop()
        if tag in UNSEEN:
            self._open(tag, attrs)
            return
        if tag in INLINE:
            if tag == "a":
                self.links += 1
            elif tag == "button":
                self.buttons += 1
            elif tag == "br" and self.parts:
                self.parts.append(" ")
            if tag not in VOID and tag not in ("a", "button") and _marked(tag, attrs, self._within()):
                self._end_block()
                self._open(tag, attrs)
            return
        self._end_block()
        while self.holders and (top := self.holders[-1][0]) in OPEN_ENDED and (top == "p" or top == tag):
            self._pop()
        if tag in VOID:
            return
        self.heading = tag in HEADINGS
        if tag in HOLDERS or _marked(tag, attrs, self._within()):
            self._open(tag, attrs)

    def _within(self) -> bool:
        return bool(self.holders) and (at := self.holders[-1][1]) >= 0 and self.inside[at]

    def _open(self, tag, attrs):
        _, up, unseen, outside = self.holders[-1] if self.holders else ("", -1, False, False)
        within = up >= 0 and self.inside[up]
        own_header = tag == "header" and within
        outside = outside or tag in OUTSIDE or tag == "header" and not own_header or not own_header and _marked(tag, attrs, within)
        own = (tag in OWN or any(n == "role" and v in OWN for n, v in attrs)) and not outside
        self.tag.append(tag)
        self.own.append(own)
        self.inside.append(own or within)
        self.parent.append(up)
        self.holders.append((tag, len(self.own) - 1, unseen or tag in UNSEEN, outside))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
            if tag == "a":
                self.links -= 1
            elif tag == "button":
                self.buttons -= 1
        else:
            self.tags += 1
            if tag not in UNSEEN:
                self._end_block()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag == "button":
            self.buttons = max(0, self.buttons - 1)
        if tag not in INLINE and tag not in UNSEEN:
            self._end_block()
            self.heading = False
        if self.open.get(tag):
            if tag not in UNSEEN:
                self._end_block()
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        if self.holders and self.holders[-1][2]:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())
        if self.buttons:
            self.pressed += len(data.strip())


def _content_lines(ratios: list[float]) -> list[bool]:
    """Which smoothed ratios reach the threshold, their standard deviation (or their mean, if that is less)."""
    n = len(ratios)
    smooth = []
    for i in range(n):
        total = weight = 0.0
        for k, w in enumerate(_KERNEL, i - REACH):
            if 0 <= k < n:
                total += w * ratios[k]
                weight += w
        smooth.append(total / weight)
    mean = sum(smooth) / n
    threshold = min(mean, math.sqrt(sum((x - mean) ** 2 for x in smooth) / n))
    return [s >= threshold and r > 0 for s, r in zip(smooth, ratios, strict=True)]


def _mass(page: _Blocks, content: list[bool]) -> list[int]:
    """By number, the clusters' characters inside each element; the last is the page's."""
    mass = [0] * (len(page.own) + 1)
    for block, is_content in zip(page.blocks, content, strict=True):
        mass[block[3]] += len(block[0]) * is_content
    whole = sum(mass)
    for k in range(len(page.own) - 1, -1, -1):  # holders stand after those around them
        mass[page.parent[k]] += mass[k]
    mass[-1] = whole
    return mass


def _region(page: _Blocks, content: list[bool]) -> tuple[set[int], bool]:
    """The holders (numbers, -1 for the page) that the clusters choose, and whether these are article elements."""
    mass = _mass(page, content)
    outermost = [k for k, is_own in enumerate(page.own) if is_own and mass[k] and (page.parent[k] < 0 or not page.inside[page.parent[k]])]
    if outermost and sum(mass[k] for k in outermost) >= MOST * mass[-1]:
        first = max(outermost, key=lambda k: mass[k])
        named = _named(page, content)
        return {k for k in outermost if k == first or not _is_teaser(page, mass, named, k, first, mass[first], page.parent[first])}, True
    return {max((k for k in range(len(page.own)) if mass[k] >= WHOLE * mass[-1]), default=-1)}, False


def _is_teaser(page: _Blocks, mass: list[int], named: list[bool], k: int, first: int, heavy: int, beside: int) -> bool:
    """Whether a light article's title is a link, or it follows the heavy one (element `first`) in another holder than `beside`."""
    return 2 * mass[k] < heavy and (not named[k] and named[first] or k > first and page.parent[k] != beside)


def _teasers(page: _Blocks, content: list[bool]) -> set[int]:
    """Articles in a chosen one that are other stories' teasers, held against the heaviest there or the text around them."""
    mass, named = _mass(page, content), _named(page, content)
    around, nested = [-1] * len(page.own), {}
    for k, up in enumerate(page.parent):
        around[k] = up if up >= 0 and page.own[up] else around[up] if up >= 0 else -1
        if page.own[k] and around[k] >= 0:
            nested.setdefault(around[k], []).append(k)
    found = set()
    for outer, inner in nested.items():
        first = max(inner, key=lambda k: mass[k])
        lone = mass[outer] - sum(mass[k] for k in inner)
        told = (outer, lone, outer) if lone >= mass[first] else (first, mass[first], page.parent[first])
        found |= {k for k in inner if k != told[0] and _is_teaser(page, mass, named, k, *told)}
    return found


def _named(page: _Blocks, content: list[bool]) -> list[bool]:
    """By number, whether the first heading in the element is no link but a content line (or there is none)."""
    found: list[bool | None] = [None] * len(page.own)
    for (text, _, linked, at, _, heading), is_content in zip(page.blocks, content, strict=True):
        while heading and at >= 0 and found[at] is None:
            found[at] = is_content or 2 * linked <= len(text)
            at = page.parent[at]
    return [f is not False for f in found]


def _running(page: _Blocks, lines: list[int], content: list[bool], chosen: set[int]) -> list[int]:
    """The lines of a region without an article element that are its text.

    A line runs with the clusters if it stands in the same holder as one of their lines, lists and the like
    not counted as holders of their own, or between two of their lines. The text begins with the region's first heading, or else the first line that runs.
    Links alone are text between the clusters, if something else stands in their holder, and as headings; at the edges they are
    a menu's, as are lines that ask without being a sentence.
    """
    blocks, runs_with, holder = page.blocks, {}, []
    for k, up in enumerate(page.parent):  # holders stand after those around them
        runs_with[k] = runs_with.get(up, up) if page.tag[k] in RUNNING and k not in chosen else k
    for i in lines:
        holder.append(runs_with.get(blocks[i][3], -1))
    main = {h for h, i in zip(holder, lines, strict=True) if content[i]}
    first, last = next(k for k, i in enumerate(lines) if content[i]), next(k for k in range(len(lines) - 1, -1, -1) if content[lines[k]])
    links = [2 * blocks[i][2] > len(blocks[i][0]) for i in lines]
    told = {blocks[i][3] for k, i in enumerate(lines) if not links[k]}
    begin = next((k for k in range(first) if blocks[lines[k]][5] and not links[k]), None)
    kept = []
    for k, i in enumerate(lines):
        text, heading = blocks[i][0], blocks[i][5]
        if links[k]:
            stays = heading and k == first - 1 or first < k < last and blocks[i][3] in told
        else:
            stays = first <= k <= last or holder[k] in main or begin is not None and begin <= k < first
        if stays or content[i]:
            kept.append(k)
    while len(kept) > 1 and kept[-1] > first and _asks(blocks[lines[kept[-1]]][0]):
        kept.pop()
    while len(kept) > 1 and kept[0] < last and not blocks[lines[kept[0]]][5] and _asks(blocks[lines[kept[0]]][0]):
        kept.pop(0)
    return [lines[k] for k in kept]


def main_text(html: str | None) -> str:
    """Blocks of the main region, white space folded, joined by newlines; empty for null or no text.

    Malformed markup is read as the parser reads it; a page whose every block lies outside gives nothing. Pages of
    any length and depth are read whole, in time in proportion to their length.
    """
    if not html:
        return ""
    page = _Blocks()
    page.feed(_LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), html))  # none is that long, but they must be read as numbers
    page.close()
    page._end_block()
    blocks = page.blocks
    if not blocks or all(b[4] for b in blocks):
        return ""
    ratios = [0.0 if outside else max(0, len(text) - linked) / (1 + tags) for text, tags, linked, _, outside, _ in blocks]
    if not any(ratios):
        ratios = [0.0 if b[4] else float(len(b[0])) for b in blocks]
    content = _content_lines(ratios)
    chosen, whole = _region(page, content)
    teasers = _teasers(page, content) if whole else ()
    within = [False] * len(page.own) + [-1 in chosen]
    for k, up in enumerate(page.parent):
        within[k] = (k in chosen or within[up]) and k not in teasers
    lines = [i for i, b in enumerate(blocks) if within[b[3]] and not b[4]]
    if not whole:
        lines = _running(page, lines, content, chosen)
    return "\n".join(blocks[i][0] for i in lines)


def _asks(text: str) -> bool:
    return ASKING.match(text) is not None and SENTENCE.search(text) is None


def extract_text(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages without its html, with text and its code points; a column of either name is replaced.

    Each row is read for itself, in a stream of small slices: null and empty pages give an empty text,
    repeated rows come out as often, an empty table gives an empty result.
    """
    names = [c for c in pages.columns if c not in (html, text, n_chars)]
    schema = pages.select(*[f"`{c}`" for c in names]).schema.add(text, "string").add(n_chars, "long")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                found = [main_text(h) for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*names, text, n_chars])

    return pages.select(*[f"`{c}`" for c in names], f"`{html}`").mapInArrow(run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages; null and empty ones give an empty text."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
