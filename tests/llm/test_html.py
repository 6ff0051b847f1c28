import html
import html.parser
import math
import random
import re
import time

import pytest

from gridloom.llm import html_text, queries


def brute(page):
    """The test tables' pages have one article; its text by plain regular expressions."""
    body = re.search(r"<article[^>]*>(.*?)(?:</article>|<footer|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div|li|ul)\b[^>]*>", body)
    plain = lambda b: re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)
    texts = [" ".join(html.unescape(plain(b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_table(spark, sf):
    pages = {r["page_id"]: (r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in queries.op7_html_text(spark, sf).collect()}
    assert set(got) == set(pages)
    for i, (url, page) in pages.items():
        assert got[i]["text"] == brute(page), i
        assert got[i]["url"] == url and got[i]["n_chars"] == len(got[i]["text"])


LONG = "This sentence is one of many that make up the body of the article and it goes on for a while. " * 3


def page(inner):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{inner}</body></html>"


def test_boilerplate_is_left_out():
    got = html_text.main_text(
        page(
            f"<header><h1>Site</h1><a href=/>home</a></header><nav><a href=/a>A</a></nav><div class='cookie-notice'>We use cookies {LONG}</div><div id=sidebar><p>{LONG}</p></div>"
            f"<div id=content><header class=entry><h1>Title &amp; more</h1></header><div class=body><p>{LONG}</p>\n<p>second <i>it</i>em{LONG}</p><ul><li>x<li>y</ul><aside>aside</aside><form>f<input></form>"
            f"<script>var a='<p>no</p>'</script><div class='ad'>buy</div><p>last</div></div><section class='comments'><p>{LONG}</p></section><footer>&copy;</footer>"
        )
    )
    blocks = got.split("\n\n")
    one = " ".join(LONG.split())
    assert blocks[-5:] == [one, f"second item{one}", "x", "y", "last"]
    assert not re.search("Site|cookies|aside|buy|home|©|var a", got)


def test_article_in_sections_stays_whole():
    got = html_text.main_text(page(f"<nav><a href=/a>A</a></nav><div><article><h2>One</h2><section><p>{LONG}</p><p>{LONG}</p></section><section><h2>Two</h2><p>{LONG}</p></section><p>end</p></article></div>"))
    assert [b[:5] for b in got.split("\n\n")] == ["One", "This ", "This ", "Two", "This ", "end"]


CASES = {
    "": "",
    "plain text\n only": "plain text only",
    "<p>a<p>b": "a\n\nb",
    "<p>a<br>b<br/>c": "a b c",
    "<b>x</b>y": "xy",
    "<p>&lt;p&gt; &#233;&nbsp;z</p>": "<p> é z",
    "<!-- <p>no</p> --><p>a <!-- x -->b</p>": "a b",
    "<p title='a>b'>q</p>": "q",
    "<p>1 < 2</p>": "1 < 2",
    "<script>x": "",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\n\nb\n\nc",
    "<nav>menu</nav>": "",
    "<p>unclosed <b>bold<p>next</b> more": "unclosed bold\n\nnext more",
    "<": "<",
    "<p": "<p",
    "<div/>x": "x",
}


def test_cases():
    for source, want in CASES.items():
        assert html_text.main_text(source) == want, source
    assert html_text.main_text(None) == ""


def test_long_and_deep_pages_take_linear_time():
    for source in ("<div>" * 50000 + "x", "<p>a " * 100000, "<a href='" * 20000, "<!--" * 50000, "<b " * 50000, "&amp;" * 200000):
        began = time.time()
        html_text.main_text(source)
        assert time.time() - began < 20, source[:20]


def test_frame_cases(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (None, "u", "", 0)], key=str)
    assert html_text.extract(df.limit(0)).collect() == []


def test_wrappers_with_boilerplate_names_keep_their_article():
    one, menu = " ".join(LONG.split()), f"<nav><a href=/a>A</a></nav><div class=sidebar><p>{LONG}</p></div>"
    for name in ("has-sidebar", "content-sidebar-wrap", "no-sidebar", "widget content", "entry social", "sidebar layout"):
        for tag in ("div", "section"):
            got = html_text.main_text(page(f"<{tag} class='{name}'>{menu}<article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article></{tag}><footer>&copy;</footer>"))
            assert got.split("\n\n") == ["Title", one, one], name
    for name in ("has-sidebar", "content-sidebar-wrap", "no-sidebar", "widget content", "entry social"):
        got = html_text.main_text(page(f"<div class='{name}'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{menu}</div>"))
        assert got.split("\n\n") == ["Title", one, one], name


def test_page_wide_form_keeps_its_text():
    one = " ".join(LONG.split())
    for text in (f"<article><p>{LONG}</p><p>{LONG}</p></article>", f"<div><p>{LONG}</p><p>{LONG}</p></div>"):
        got = html_text.main_text(page(f"<form action=/ role=form><nav><a href=/>home</a></nav>{text}<form class=search>find<input></form><footer>f</footer></form>"))
        assert got.split("\n\n")[:2] == [one, one] and "home" not in got
    assert html_text.main_text(page(f"<form>{LONG}</form><article><p>{LONG}</p></article>")) == one


def test_names_of_boilerplate_alone_stay_left_out():
    one = " ".join(LONG.split())
    comments = f"<div id=comments><article class=comment-body><p>{LONG}</p><p>{LONG}</p></article></div>"
    assert html_text.main_text(page(f"<article><p>{LONG}</p></article>{comments}")) == one
    assert html_text.main_text(page(f"<div><p>{LONG}</p></div><div class='comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>")) == one
    assert html_text.main_text(page(f"<div class='cookie-notice'><p>{LONG}</p></div>")) == ""


class Node:
    """A plain recursive tree for well-formed pages of div, section, p, h2, ul, li and a."""

    def __init__(self, tag, mark="", parent=None):
        self.tag, self.mark, self.parent, self.parts = tag, mark, parent, []

    def kids(self):
        return [p for p in self.parts if isinstance(p, Node)]

    def count(self, links=False, inside=False):
        inside = inside or self.tag == "a"
        return sum(p.count(links, inside) if isinstance(p, Node) else len(p.strip()) * (inside or not links) for p in self.parts)

    def tags(self, links=False):
        return sum((k.tag == "a" or not links) + k.tags(links) for k in self.kids())

    def density(self, body):
        c, lc = self.count(), self.count(True)
        if not c:
            return 0.0
        some = lambda x: max(1, x)
        base = math.log(c / some(c - lc) * lc + body.count(True) / body.count() * c + math.e)
        return c / some(self.tags()) * math.log(max(1, c / some(lc) * some(self.tags()) / some(self.tags(True)))) / base

    def all(self):
        return [self, *[n for k in self.kids() for n in k.all()]]


class Reader(html.parser.HTMLParser):
    def __init__(self, source):
        super().__init__()
        self.body = self.now = Node("body")
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        self.now.parts.append(Node(tag, dict(attrs).get("class", ""), self.now))
        self.now = self.now.parts[-1]

    def handle_endtag(self, tag):
        self.now = self.now.parent

    def handle_data(self, text):
        self.now.parts.append(text)


def brute_density(source):
    """The method written down directly: what is kept, as a set of nodes' texts in page order."""
    body = Reader(source).body
    nodes = body.all()
    density = {id(n): n.density(body) for n in nodes}
    sums = [sum(density[id(k)] for k in n.kids()) for n in nodes]
    best = nodes[max(range(len(nodes)), key=lambda k: (sums[k], -k))]
    path = [best]
    while path[-1].parent:
        path.append(path[-1].parent)
    floor = min(density[id(n)] for n in path)
    kept = set(map(id, best.all()))
    for n in best.all()[1:]:
        if n.tag in ("div", "section", "ul", "a") and density[id(n)] < floor and 2 * n.count(True, n is not best and any(n in a.all() for a in nodes if a.tag == "a")) > n.count():
            kept -= set(map(id, n.all()))
    for step, (own, above) in enumerate(zip(path, path[1:])):
        kept.add(id(above))
        for k in above.kids():
            alike = k.tag in ("p", "h2", "li") or k.tag == own.tag and k.mark == own.mark and (k.mark or k.tag != "div")
            need = floor if alike else max(floor, 0.5 * min(density[id(p)] for p in path[: step + 1]))
            if k is not own and density[id(k)] >= need:
                kept |= set(map(id, k.all()))
    blocks = [""]

    def walk(n):
        block = n.tag != "a"
        if block:
            blocks.append("")
        for p in n.parts:
            if isinstance(p, Node):
                walk(p)
            elif id(n) in kept:
                blocks[-1] += p
        if block:
            blocks.append("")

    walk(body)
    return "\n\n".join(" ".join(b.split()) for b in blocks if b.strip())


def random_page(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.35:
        return f"<p>{'word ' * rng.randint(1, 60)}</p>"
    if kind < 0.5:
        return f"<ul>{''.join(f'<li><a>{rng.randint(1, 999)} link</a></li>' for _ in range(rng.randint(1, 8)))}</ul>"
    if kind < 0.6:
        return f"<h2>{'head ' * rng.randint(1, 5)}</h2>"
    tag = rng.choice(["div", "div", "div class=x", "section"])
    return f"<{tag}>{''.join(random_page(rng, depth + 1) for _ in range(rng.randint(1, 5)))}</{tag.split()[0]}>"


def test_densities_decide_as_the_method_says():
    rng, narrowed = random.Random(5), 0
    for _ in range(400):
        source = "".join(random_page(rng) for _ in range(rng.randint(1, 4)))
        want = brute_density(source)
        assert html_text.main_text(source, names=False) == want, source
        narrowed += len(want) < len(" ".join(re.sub("<[^>]*>", " ", source).split()))
    assert narrowed > 100  # in most pages the densities take something out


def test_unnamed_menus_sidebars_and_bottoms_fall_below_the_density():
    one, words = " ".join(LONG.split()), LONG.split()
    menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in words[:8])
    related = "".join(f"<div><a href=/r{k}>{' '.join(words[k : k + 5])}</a></div>" for k in range(15))
    for article in (f"<h1>Title</h1><p>{LONG}</p><p>short one</p><p>{LONG}</p>", f"<section><h1>Title</h1><p>{LONG}</p><p>short one</p></section><section><p>{LONG}</p></section>"):
        for body in (f"<div>{article}</div>", f"<div><div>{article}</div></div>", article):
            for frame in ("<div id=wrapper>{}</div>", "{}", "<table><tr><td>{}</td></tr></table>"):
                source = page(frame.format(f"<div id=top><ul>{menu}</ul></div>{body}<div id=col2>{related}</div><div id=bottom>All rights reserved</div>"))
                got = html_text.main_text(source, names=False).split("\n\n")
                want = ["Title", one, "short one", one]
                assert got == want or body == article and [g for g in got if g != "All rights reserved"] == want, source


def test_table_pages_come_out_by_density_alone(spark, sf):
    """Without class names, the advert beside the article is left out by its density on nearly all pages."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    good = sum(html_text.main_text(p, names=False) == brute(p) for p in pages)
    assert good >= 0.9 * len(pages), (good, len(pages))


SENTENCE = "The committee met again in the spring and agreed on a plan that most of its members could support, which surprised those who had followed it. "


def test_names_that_the_article_is_about():
    """Inside an article, compound names that say what a text is about don't drop it; those of boilerplate do."""
    parts = [f'<p class="promo-code">{SENTENCE}One.</p>', f'<p id="ads-history">{SENTENCE}Two.</p>', f'<div class="notice-period"><p>{SENTENCE}Three.</p></div>', f'<p class="cookie-recipe">{SENTENCE}Four.</p>']
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{SENTENCE}</p>{''.join(parts)}<div class='comment-list'><p>I say so too.</p></div><div class=ad>Buy it now</div></article></body>"
    found = html_text.main_text(page)
    assert all(w in found for w in ("One.", "Two.", "Three.", "Four."))
    assert "I say so" not in found and "Buy it" not in found


def remarks(n, wrap="div", date="{} May 2024"):
    return "".join(f"<{wrap}><b>Reader {k}</b> <span>{date.format(k + 1)}</span><p>I have read all of this with interest, and I don't agree with what is said in the second part of it. {k}</p></{wrap}>" for k in range(n))


@pytest.mark.parametrize("list_, date", [("<div id=c1>{}</div>", "{} May 2024"), ("<div><h3>What you say</h3>{}</div>", "{} hours ago"), ("<section>{}</section>", "2024-05-0{}")])
def test_unnamed_comments(list_, date):
    """Dated entries beside a short article, with and without an article element, go; the article stays."""
    for around in ("<article><h1>Title</h1><p>{}</p></article>", "<div><h1>Title</h1><p>{}</p><p>{}</p></div>"):
        page = f"<body>{around.format(SENTENCE, SENTENCE)}{list_.format(remarks(8, date=date))}</body>"
        found = html_text.main_text(page)
        assert "committee" in found and "Reader" not in found and "interest" not in found


def test_dated_texts_that_stay():
    """A page that is nothing but dated entries, dated sections of an article, and paragraphs with dates in sentences."""
    only = html_text.main_text(f"<body><div>{remarks(4)}</div></body>")
    assert "interest" in only
    story = "".join(f"<div><h2>{k + 1} May 2024</h2><p>{SENTENCE}{k}</p></div>" for k in range(4))
    assert html_text.main_text(f"<body><article><h1>Diary</h1>{story}</article></body>").count("committee") == 4
    plain = "".join(f"<p>On {k + 1} May 2024 it was said once more that {SENTENCE}</p>" for k in range(4))
    assert html_text.main_text(f"<body><div><h1>News</h1>{plain}</div></body>").count("committee") == 4
