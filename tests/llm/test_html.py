from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from helpers import SMALL

from tellurix.llm import html


def page(article, extra="", head=""):
    return f"<!DOCTYPE html><html><head><title>T &amp; t</title>{head}<script>var t='</p><article>no</article>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></ul></nav><div class=\"ad box\">Buy</div>{extra}<article>{article}</article><footer>&copy; x</footer></body></html>"


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, 1, "k", [1]) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, n int, key string, gone array<int>")
    out = html.extract(df, spark).collect()
    assert all(r.n_chars == len(r.text) and r.url == rows[r.page_id][0] for r in out)
    return [r.text for r in sorted(out)]


def test_blocks_references_and_white_space(spark):
    rows = [
        ("http://a.com/1", page("<h1>One &lt;b&gt;</h1><p><b>A\n  b.<br><p>C&nbsp;d &eacute;&#128512;<ul><li>x<li>y <i>z</i></ul><table><tr><td>1<td>2</table><pre>k\n l</pre>")),
        ("http://b.com/1", page("<p>text <!-- <p>no --> on <a href='?a=1>2'>link</a> 1 < 2 &amp &copy</p>", "<form><input>Name <button>Send</button></form><aside>Side</aside>")),
        ("http://c.com/1", page("<header><h1>Title</h1></header><p>Body</p><section id='comments'><p>First!</p></section><div class='share-buttons'>Share</div><style>p{}</style><noscript>no</noscript>")),
        ("http://d.com/1", "<div class='site-header'>Site</div><div>plain <span>page</span></div><div role=navigation>skip</div><p>more"), ("x:[", None), (None, ""), ("http://e.com", "<p"), ("http://f.com", "no markup &#x41;\x00 <3"),
    ]
    out = texts(spark, rows)
    assert out[0] == "One <b>\nA b.\nC d é😀\nx\ny z\n1\n2\nk l" and out[1] == "text on link 1 < 2 & ©" and out[2] == "Title\nBody"
    assert out[3] == "plain page\nmore" and out[4] == out[5] == "" and out[6] == "<p" and out[7] == "no markup A\x00 <3"


def test_templates_of_a_host_go_and_recurring_sentences_stay(spark):
    box = "<div><p>Welcome to our site</p><p>Read the rules</p></div>"
    rows = [("http://h.com/%d" % i, f"<body>{box}<div><p>own {i}</p></div></body>") for i in range(40)]
    rows += [("http://i.com/%d" % i, page(f"<p>Said by all.</p><p>own {i}</p><div><span>Follow us everywhere</span></div>")) for i in range(40)]
    rows += [("http://j.com/1", f"<body>{box}<p>rare here</p></body>")]
    out = texts(spark, rows)
    assert out[:40] == [f"own {i}" for i in range(40)] and out[40:80] == [f"Said by all.\nown {i}" for i in range(40)]
    assert out[80] == "Welcome to our site\nRead the rules\nrare here"


def test_deep_and_long_pages(spark):
    out = texts(spark, [("http://a.com", "<div>" * 3000 + "deep" + "</div>" * 3000), ("http://b.com", page("<p>" + "w " * 200000 + "</p>")), ("http://c.com", "<a " + "x='" * 50000)])
    assert out[0] == "deep" and len(out[1]) == 399999


def test_no_pages(spark):
    assert texts(spark, []) == []


def test_articles_stay(spark):
    """Copies of a page, stock class names around and on articles, and prose inside them with the names of furniture."""
    own = "<h1>Title</h1><div><p>Some text of an article.</p><p>More of it.</p></div>"
    text = "Title\nSome text of an article.\nMore of it."
    rows = [(f"http://a.com/{i}", f"<body><script>track({i})</script><main><div>{own}</div></main></body>") for i in range(6)] + [(f"http://b.com/{i}", page(own)) for i in range(6)]
    rows += [(f"http://c.com/{i}", f"<body><div class='page no-sidebar'><article class='post comments-open'>{own}</article></div></body>") for i in range(3)]
    rows += [("http://d.com", f"<form id=aspnet><div class='sidebar'><article>{own}</article></div></form>"), ("http://e.com", f"<div class='page no-sidebar'>{own}</div><div class='site-footer'>x</div>")]
    rows += [("http://f.com", f"<article>{own}<p class='notice'>Mind this.</p><p id='share-prices'>Prices rose.</p></article>")]
    out = texts(spark, rows)
    assert out[:17] == [text] * 17 and out[17] == text + "\nMind this.\nPrices rose."


def test_furniture_goes(spark):
    rows = [
        ("http://a.com", "<article><p>One <ins class=adsbygoogle>Buy</ins> two<span class='share'>Tweet</span>.</p><x-banner class='ad'>Ad</x-banner></article><ol class='comment-list'><article class='comment' id='comment-7'><p>First!</p></article></ol>"),
        ("http://b.com", "<div class='cookie-banner'>Cookies</div><p>Intro</p><article><p>A</p></article><article><p>B</p></article><div class='related-posts'>See</div>"),
        ("http://c.com", "<div><article><p>A</p></article><p>Between</p><article><p>B</p></article></div><p>After</p>"),
        ("http://d.com", "<nav><article>Menu</article></nav><p>Text <b>bold <i>both</b> on</i>.</p>"),
    ]
    assert texts(spark, rows) == ["One two.", "Intro\nA\nB", "A\nBetween\nB", "Text bold both on."]


def brute(rows):
    """Every subtree of every page counted in a dict, and the pages' texts without the recurring ones."""
    seen, pages_of, parsed = defaultdict(set), defaultdict(set), []
    for url, h in rows:
        nodes, host = html.parsed(h or "")[0], html.host_of(url)
        parsed.append((host, h or "", [n for n in nodes if html.removable(n)]))
        pages_of[host].add(nodes[0].hash)
        for n in parsed[-1][2]:
            seen[host, n.hash].add(nodes[0].hash)
    often = {k for k, v in seen.items() if len(v) >= html.MANY and (len(v) >= html.SHARE * len(pages_of[k[0]]) or len(v) >= html.ENOUGH)}
    return [html.main_text(h, {n.number for n in own if (host, n.hash) in often}) for host, h, own in parsed]


def test_against_brute_force(spark):
    rows = [(r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("url", "html").collect()]
    r = random.Random(3)
    blocks = [f"<{t}{c}>" + "".join(f"<{u}>{r.choice('abcdef')} {r.randint(0, 9)}</{u}>" for u in r.choices(["p", "span", "li", "x-y"], k=3)) + f"</{t}>" for t in ("div", "section", "ul", "p", "table") for c in ("", " class=box", " class='site-menu'") for _ in range(4)]
    for i in range(400):
        body = "".join(r.choices(blocks, k=r.randint(1, 4)))
        rows.append((f"http://{r.choice('xyz')}.org/{i}", r.choice(["<article>{}</article>", "<main><div>{}</div></main>", "{}", "<div>{}"]).format(body) + r.choice(blocks) + f"<script>{i}</script>"))
    rows += rows[-50:]
    want = brute(rows)
    assert texts(spark, rows) == want and sum(Counter(want).values()) == len(rows)
    assert any(html.main_text(h or "", set()) != w for (_, h), w in zip(rows, want, strict=True))


def test_comments_teasers_and_adverts_go(spark):
    own, text = "<h1>Title</h1><p>Some text of an article.</p>", "Title\nSome text of an article."
    comments = '<div id=comments class=comments-area><ol class=comment-list><li class=comment><article id="div-comment-17" class="comment-body"><p>First!</p></article></li></ol></div>'
    about = [comments, '<div class="related-posts"><article><p>Read this, too</p></article></div>', '<div id="sidebar"><article class="teaser"><p>Teaser</p></article></div>', '<article class="comment-body"><p>Me, too</p></article>']
    rows = [(f"http://a{i}.com", f"<body><article>{own}</article>{x}</body>") for i, x in enumerate(about)]
    rows += [(f"http://b{i}.com", f"<body><main><article>{own}</article>{x}</main></body>") for i, x in enumerate(about)]
    rows += [(f"http://c{i}.com", f"<body>{x}<article>{own}{y}</article></body>") for i, (x, y) in enumerate(zip(about, ['<p class="advertisement">Buy now!</p>', "<ul><li class='share'>Tweet</ul>", "<p id=ad-box>Buy</p>", "<ul><li class=comment>So it is</ul>"], strict=True))]
    rows += [(f"http://d{i}.com", f"<div class={x}><p>Extra</p></div>{own}") for i, x in enumerate(["cookie-law-info-bar", "author-bio", "footer-widgets", "site-info"])]
    rows += [("http://e.com", f"<div class=sidebar><article><p>Short</p></article><article>{own}</article></div>"), ("http://f.com", f"{own}<svg><svg><text>a</text></svg><text>b</text></svg>")]
    assert texts(spark, rows) == [text] * len(rows)


def test_quotes_count_where_browsers_count_them(spark):
    rows = [
        ("http://a.com", "<p title=it's>Hello world</p><p>Second isn't lost</p><p>Third</p>"),
        ("http://b.com", '<p title="a>Hello world</p><p>Second</p>'),
        ("http://c.com", "<p title = \"a > b\" data-id='nav' x=class=ad>One</p><div title='class=ad'>Two</div><div data-class=ad>Three</div>"),
        ("http://d.com", "<p =x a'b=c \"q\">One</p><div CLASS = 'ad'>no</div><br/><p/>Two"),
    ]
    assert texts(spark, rows) == ["Hello world\nSecond isn't lost\nThird", "Hello world\nSecond", "One\nTwo\nThree", "One\nTwo"]


class Article(HTMLParser):
    """The words of a page's article, by the standard library's parser: all but what stands in furniture by tag or name."""

    SKIP, NAMES = {"nav", "aside", "footer", "form", "script", "style", "noscript", "button", "template", "iframe", "svg"}, re.compile(r"(ads?|advert\w*|share|social|sponsored|promo|newsletter|related|comments?|subscribe)(-\w+)?")
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, page):
        super().__init__()
        self.open, self.words = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).split()
        if tag not in self.VOID:
            self.open.append((tag, tag in self.SKIP or any(map(self.NAMES.fullmatch, names))))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(skip for _, skip in self.open):
            self.words.append(data)


@pytest.mark.parametrize("folder", [SMALL, SMALL.replace("0.001", "0.01")])
def test_the_article_of_each_page(spark, folder):
    """Every page's article has its words in their order, no more and no fewer."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    page_of = {r.page_id: r.html for r in pages.collect()}
    wrong = {r.page_id: (r.text, "".join(Article(page_of[r.page_id]).words)) for r in html.extract(pages, spark).collect()}
    wrong = {k: (a, b) for k, (a, b) in wrong.items() if "".join(a.split()) != "".join(b.split())}
    assert not wrong, list(wrong.items())[:2]
