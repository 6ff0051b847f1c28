"""Main text of HTML pages by composite text density.

A page is read into a flat tree: nodes numbered in page order, so a subtree is
a range of numbers.  Missing end tags are supplied as browsers do for
paragraphs, list items and table cells.  Elements that are boilerplate by their
tag, role, class or id (menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts, styles) are left out before densities are computed.
A class or id says so by a whole name or its first or last part, unless that
part is qualified (``has-sidebar``).  Two kinds of elements that only look like
boilerplate stay, and density decides in them: those named so (or forms) that
hold all of the page's article and main elements, and forms and elements with a
content name besides (``widget content``) that hold most of the text.

With C characters, T tags, LC characters and LT tags of links in a node's
subtree (b: of the body), its density is

    C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e)),

characters per tag, adjusted for links (Sun, Song and Liao, "DOM based content
extraction via text density", 2011).  The node with the largest sum of its
children's densities is selected, with all blocks in it.  Its path to the body
gives the thresholds for what stands beside it.  The least density on the whole
path is the floor: nothing below it is kept, which takes out menus and lists of
links.  At each step up, a sibling of the path's node must reach ``SHARE`` of
the least density between that node and the selected one, which takes out short
remarks in layout elements.  Headings, paragraphs and other text elements, and
elements of the same tag and class as the path's node (further sections of the
article), need the floor only, and inside an article element only what is mostly
links needs it.  Outside of article and main elements, lists of links in the
selected node itself go by the floor as well.

Inside an article a compound name must say nothing else (``comment-list``, but not
``promo-code``): there, names of what the text is about are no boilerplate.
Readers' comments that no name tells are known by their form: outside of articles, a list
of like entries that each have a short line with a date, beside other text.

The names of classes and ids are a first guess (``names=False`` switches it
off); where they say nothing, densities alone decide.

Partitions are mapped, one page at a time, without recursion: no shuffle, and
memory bounded by a batch and one page.

Defined results: null and empty html, and pages without text, have text '';
repeated rows are extracted alike; plain text without tags is one block; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[A-Za-z/][^>]*+>|<[!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
CLASS = re.compile(r"(?<![a-zA-Z-])class\s*+=\s*+[\"']?([^\"'>]*+)")
#: Elements by what they mean for the tree and the text.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")}
BOILERPLATE = set("script style noscript template head title nav footer aside form button select textarea iframe svg canvas object dialog menu input label xmp".split())
WHOLE = {"html", "body", "main", "article"}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices "
    "banner popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus respond replies pagination pager toolbar widget widgets copyright disclaimer skip".split()
)
#: An open element that a start tag closes, and the elements that keep it open.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


#: Names that say that an element with a boilerplate name may be the content, and first parts that qualify a name.
CONTENT = set("content entry post article main body page story text primary hentry".split())
QUALIFIERS = set("has no with without not is hide show".split())
#: What else a compound name may hold inside an article to count: words for the element itself. ``promo-code`` and ``notice-period`` are what a text is about.
FRAME = set("box boxes list lists wrapper wrap container bar section block blocks area unit slot row column col inner outer top bottom left right center form link links item items panel group header body head thread title heading button buttons icon icons inline native reader readers user users post article entry page site main primary secondary js".split())
#: A short text that says when something was written, its most code points, and the least of a list's text that its dated entries must hold.
WHEN = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,4}|\d+ (?:second|minute|hour|day|week|month|year)s? ago|\b(?:yesterday|today)\b", re.I)
SHORT, MOSTLY = 60, 0.6
#: Elements that lay a page out rather than hold text of their own, and those that say what the article is.
LAYOUT, ARTICLES = set("div section td th tr table tbody ul ol dl center main header footer aside nav span a form".split()), {"article", "main"}
#: The share of the path's density that a sibling must reach.
SHARE = 0.5
#: What an element is: always left out; left out unless it holds the articles; or unless it holds most of the text.
STAYS, SURE, NAMED, WRAPS = range(4)


def boilerplate(tag: str, attributes: str, in_article: bool, names: bool = True) -> int:
    if tag in WHOLE:
        return STAYS
    if tag in BOILERPLATE and tag != "form" or tag == "header" and not in_article:
        return SURE
    kind, content = WRAPS if tag == "form" else STAYS, False
    if not attributes.strip(" /"):
        return kind
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return SURE
        if name == "role" and value in ROLES:
            kind = kind or (WRAPS if value == "form" else NAMED)
        if names and name in ("class", "id"):
            for token in value.split():
                parts = [p for p in re.split(r"[^a-z0-9]+", token) if p]
                content |= token in CONTENT
                if parts and (len(parts) == 1 or parts[0] not in QUALIFIERS):
                    ends = {parts[0], parts[-1]}
                    said = bool(ends & NAMES) and not (in_article and {*parts} - NAMES - FRAME)
                    if said or "header" in ends and not in_article:
                        kind = kind or NAMED
    return WRAPS if kind == NAMED and content else kind


class Page:
    """The flat tree: per node its tag, parent, last descendant and own characters, and the text in page order."""

    def __init__(self, html: str, names: bool = True):
        self.names, self.marks = names, [""]  # marks: the class of each node
        self.tag, self.parent, self.last = ["body"], [-1], [0]
        self.chars, self.link_chars = [0], [0]
        self.dropped, self.kind = [False], [STAYS]
        self.texts: list[tuple[int, str]] = []  # (node, text), and (node, "") where a block begins or ends
        self.body = 0
        self.read(html)
        if any(k > SURE for k in self.kind):
            self.decide()
        self.leave_remarks()

    def leave_remarks(self) -> None:
        """Leaves out readers' comments that no name tells: outside of articles, two or more like entries in a row of elements, each with a short line that says when, and a text.

        They are remarks only beside something else: an article or main element, or more text in paragraphs outside of them.
        """
        n, tag, parent = len(self.tag), self.tag, self.parent
        dated, text = [t == "time" for t in tag], [0] * n
        for k, said in self.texts:
            if said and not self.dropped[k]:
                bare = " ".join(said.split())
                if len(bare) <= SHORT and WHEN.search(bare):
                    dated[k] = True
                elif len(bare) > 1:
                    text[k] += len(bare)
        if not any(dated):
            return
        inside = [t in ARTICLES for t in tag]
        for k in range(1, n):
            inside[k] = inside[k] or inside[parent[k]]
        for k in range(n - 1, 0, -1):
            if not self.dropped[k]:
                dated[parent[k]] = dated[parent[k]] or dated[k]
                text[parent[k]] += text[k]
        alike: dict[tuple, list[int]] = {}
        for k in range(1, n):
            if not (self.dropped[k] or inside[k]) and tag[k] in LAYOUT and dated[k] and text[k]:
                alike.setdefault((parent[k], tag[k], self.marks[k]), []).append(k)
        lists = [p for (p, *_), some in alike.items() if p and len(some) > 1 and sum(text[k] for k in some) >= MOSTLY * text[p]]
        lists = [p for p in lists if not any(q < p <= self.last[q] for q in lists)]
        rest = sum(text[k] for k in range(1, n) if tag[k] == "p" and not self.dropped[k] and not any(p < k <= self.last[p] for p in lists))
        if lists and (any(inside[k] and not self.dropped[k] for k in range(n)) or rest >= 2 * SHORT):
            for p in lists:
                self.kind[p] = SURE
                self.dropped[p : self.last[p] + 1] = [True] * (self.last[p] + 1 - p)

    def inherit(self) -> None:
        for k in range(1, len(self.tag)):
            self.dropped[k] = self.dropped[self.parent[k]] or self.kind[k] == SURE

    def decide(self) -> None:
        """Settles which elements with a boilerplate name are left out."""
        n, kind = len(self.tag), self.kind
        articles = [k for k in range(n) if self.tag[k] in ("article", "main") and not self.dropped[k]]
        for k in range(1, n):
            if kind[k] > SURE and articles and k < articles[0] and articles[-1] <= self.last[k]:
                kind[k] = STAYS
            elif kind[k] == NAMED:
                kind[k] = SURE
        self.inherit()
        c = list(self.chars)
        for k in range(n - 1, 0, -1):
            if not self.dropped[k]:
                c[self.parent[k]] += c[k]
        for k in range(1, n):
            if kind[k] == WRAPS:
                kind[k] = STAYS if 2 * c[k] > c[0] else SURE
        self.inherit()

    def read(self, html: str) -> None:
        tag, parent, dropped, texts = self.tag, self.parent, self.dropped, self.texts
        stack, at, end = [0], 0, len(html)
        links = articles = 0

        def close(depth: int) -> None:
            nonlocal links, articles
            while len(stack) > depth:
                k = stack.pop()
                self.last[k] = len(tag) - 1
                links -= tag[k] == "a"
                articles -= tag[k] in ("article", "main")
                if tag[k] in BLOCKS:
                    texts.append((k, ""))

        def say(text: str) -> None:
            k = stack[-1]
            if text and not dropped[k]:
                if "&" in text:
                    text = references.unescape(text)
                texts.append((k, text))
                n = len(text.strip())
                self.chars[k] += n
                if links:
                    self.link_chars[k] += n

        last = html.rfind(">")  # no tag ends after it, however many begin
        while at < end:
            m = TOKEN.search(html, at) if at <= last or html.startswith("<!--", at) else None
            if m is None:
                rest = html[at:]
                say(rest[: rest.find("<!--")] if "<!--" in rest else rest)
                break
            say(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "br":
                    say(" ")
                for depth in range(len(stack) - 1, 0, -1):
                    if tag[stack[depth]] == name:
                        if name not in ("body", "html"):
                            close(depth)
                        break
                    if tag[stack[depth]] in BLOCKS and name not in BLOCKS:
                        break
                continue
            if name == "br":
                say(" ")
                continue
            if name == "html" or name == "body":
                if name == "body":
                    close(1)
                continue
            if name in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    t = tag[stack[depth]]
                    if t == "p":
                        close(depth)
                        break
                    if t in BLOCKS:
                        break
                if name in CLOSES:
                    own, keep = CLOSES[name]
                    for depth in range(len(stack) - 1, 0, -1):
                        t = tag[stack[depth]]
                        if t in own:
                            close(depth)
                            break
                        if t in keep:
                            break
            elif tag[stack[-1]] == "head" and name not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
                close(1)
            if tag[stack[-1]] == "head" and name in BLOCKS:
                close(1)
            k = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            self.last.append(k)
            self.chars.append(0)
            self.link_chars.append(0)
            self.kind.append(boilerplate(name, m[3], articles > 0, self.names))
            held = CLASS.search(m[3]) if "class" in m[3] else None
            self.marks.append(held[1] if held else "")
            dropped.append(dropped[stack[-1]] or self.kind[k] == SURE)
            if name in BLOCKS:
                texts.append((k, ""))
            if name in VOID or m[3].endswith("/") and name not in BLOCKS and name not in RAW and name != "a":
                continue
            if name in RAW:
                over = RAW[name].search(html, at)
                stop = over.start() if over else end
                at = end if over is None else (html.find(">", stop) + 1 or end)
                continue
            stack.append(k)
            links += name == "a"
            articles += name in ("article", "main")
        close(0)

    def densities(self) -> tuple[list[float], list[float]]:
        """Per node its density and the sum of its children's; ``c`` and ``lc`` become those of subtrees."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        c, lc, t, lt = list(self.chars), list(self.link_chars), [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            if self.dropped[k]:
                continue
            p = parent[k]
            c[p] += c[k]
            lc[p] += lc[k]
            t[p] += t[k] + 1
            lt[p] += lt[k] + (tag[k] == "a")
        ratio = lc[0] / c[0] if c[0] else 0.0
        density, total = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            if c[k] and not self.dropped[k]:
                links, tags, link_tags = max(1, lc[k]), max(1, t[k]), max(1, lt[k])
                base = math.log(c[k] / max(1, c[k] - lc[k]) * lc[k] + ratio * c[k] + math.e)
                density[k] = c[k] / tags * math.log(max(c[k] / links * tags / link_tags, 1.0)) / base
            if k and not self.dropped[k]:
                total[parent[k]] += density[k]
        self.all_chars, self.all_links = c, lc
        return density, total

    def select(self) -> list[bool]:
        """Which nodes' own texts are the main text."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        density, total = self.densities()
        best = max(range(n), key=lambda k: (total[k], -k))
        path = [best]
        while path[-1] > 0:
            path.append(parent[path[-1]])
        floor = min(density[k] for k in path)
        keep = [False] * n

        def take(k: int) -> None:
            keep[k : self.last[k] + 1] = [True] * (self.last[k] + 1 - k)

        take(best)
        if not any(tag[k] in ARTICLES for k in path):
            for k in range(best + 1, self.last[best] + 1):
                if keep[k] and tag[k] in LAYOUT and density[k] < floor and 2 * self.all_links[k] > self.all_chars[k]:
                    keep[k : self.last[k] + 1] = [False] * (self.last[k] + 1 - k)
        in_article, inside = {}, False
        for k in reversed(path):
            inside = in_article[k] = inside or tag[k] == "article"
        children: dict[int, list[int]] = {k: [] for k in path[1:]}
        for k in range(1, n):
            if parent[k] in children:
                children[parent[k]].append(k)
        least = density[best]
        for own, above in zip(path, path[1:]):
            least = min(least, density[own])
            keep[above] = True  # text that stands in it directly
            for k in children[above]:
                if in_article[above] and 2 * self.all_links[k] <= self.all_chars[k]:
                    take(k)
                    continue
                alike = tag[k] not in LAYOUT or self.marks[k] == self.marks[own] and tag[k] == tag[own] and (self.marks[k] or tag[k] != "div")
                if k != own and density[k] >= (floor if alike else max(floor, SHARE * least)):
                    take(k)
        return keep

    def text(self) -> str:
        keep = self.select()
        blocks, now = [], []
        for k, text in self.texts:
            if not keep[k] or self.dropped[k]:
                if text or self.dropped[k] and self.tag[k] not in BLOCKS:
                    continue
                text = ""
            if text:
                now.append(text)
            elif now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        blocks.append(" ".join("".join(now).split()))
        return "\n\n".join(b for b in blocks if b)


def main_text(html: str | None, names: bool = True) -> str:
    return Page(html, names).text() if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
