"""HTML extraction with site template removal: element subtrees are hashed and counted over the pages of their host,
and those that recur on many are deleted."""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurix.llm.common import Scratch, per_batch, record_batch, row_key

#: A subtree is of the site's template when it stands on MANY different pages of the host or more, and these are SHARE of its
#: pages or more, or ENOUGH, so that the size of a host doesn't spare a block that very many of its pages repeat.
MANY, SHARE, ENOUGH = 5, 0.05, 100

# Kinds of elements, by tag, role, and words of class and id.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
NESTS = {"svg", "object", "canvas", "audio", "video", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CHROME = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "map"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent notice popup modal newsletter subscribe share sharing social related recommended comment comments "
    "commentlist respond disqus reply replies pagination pager widget widgets toolbar topbar login signup adsbygoogle adbox adslot notices alert announcement".split()
)
# Words that may stand beside those above in the name of page furniture, as in site-footer or share-buttons.
BESIDE = set("site main page top bottom left right box list area bar button buttons block container wrapper wrap section inner outer link links post posts form item items title unit slot zone law info".split())
# Whole names of page furniture whose words are not.
CHROME_NAMES = {"author-bio", "author-box", "site-info"}
# Names by which an article element itself is no article: a comment, a teaser, an advert.
NO_ARTICLE = set("comment comments reply replies related recommended promo promotion sponsored ad ads advert advertisement".split())
# Words that may stand beside a comment's in an article's name, as in div-comment-17 or comment-body.
OF_COMMENTS = BESIDE | {"div", "body", "content", "text", "entry", "thread", "author", "meta"}
# Words of the names by which even prose within an article is none of it: adverts, sharing, readers' comments.
NO_PROSE = set("ad ads advert adverts advertisement advertising adsbygoogle adbox adslot sponsor sponsored promo share sharing social comment comments reply replies".split())
MAIN = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "dd", "dt", "blockquote", "pre", "figcaption", "caption"}
#: An opening tag ends an open element of these kinds, within the nearest element of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: An attribute, as browsers read one: quotes count only after the equals sign, and one that is never closed is part of the value.
VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
NAME = r"""(?:=[^\s/>=]*+|[^\s/>=]++)"""
TAG = re.compile(rf"""<!--.*?(?:-->|$)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{NAME}(?:{VALUE})?)*+)>""", re.S)
ATTRIBUTE = re.compile(rf"({NAME})({VALUE})?")
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element. `chrome` is what its own tag and names say, and `article` that it may be the page's main element; `main` is
    the main element that it is or stands in, and `holds` whether it is one or one stands in it (see `settled`); `size`
    counts the characters of all text within."""

    __slots__ = ("tag", "parent", "chrome", "by_tag", "article", "main", "prose", "holds", "pieces", "hash", "size", "number", "names")

    def __init__(self, tag: str, parent: Node | None, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        self.chrome = self.by_tag = self.article = self.holds = False
        self.main, self.prose, self.names = None, parent.prose if parent else False, ()
        self.pieces, self.hash, self.size = [], None, 0


def names_of(attributes: str) -> tuple[set[str], set[str]]:
    """An opening tag's class and id names, and its roles."""
    found = {"class": set(), "id": set(), "role": set()}
    for name, value in ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        if name.lower() in found:
            found[name.lower()].update(value.lstrip().removeprefix("=").strip().strip("\"'").split())
    return found["class"] | found["id"], {r.lower() for r in found["role"]}


def of_furniture(name: str, words: set[str] = CHROME_WORDS, beside: set[str] = BESIDE) -> bool:
    """A whole class or id name made of such words and, beside at least one, of those that go with them: site-footer is one,
    no-sidebar and comments-open are not. A number may follow, as in comment-17."""
    parts = [p.lower() for p in PARTS.split(name) if p and not p.isdigit()]
    return any(p in words for p in parts) and all(p in words or p in beside for p in parts)


def described(node: Node, attributes: str) -> None:
    """Fills in what an element is by its tag and names."""
    names, roles = names_of(attributes)
    node.names, node.by_tag = names, node.tag in CHROME
    node.prose = node.prose or node.tag in PROSE
    if node.tag in MAIN:
        node.article = not any(of_furniture(x, NO_ARTICLE, OF_COMMENTS) for x in names)
        node.chrome = not node.article
    elif node.tag not in ("html", "body"):
        node.chrome = node.by_tag or bool(roles & CHROME_ROLES) or any(of_furniture(x) or x.lower() in CHROME_NAMES for x in names)


def settled(nodes: list[Node]) -> None:
    """Finds the page's main elements: the outermost articles that no chrome holds; where there is none, the one with the most text
    of those in chrome, other than navigation and the like by their tags. What holds a main element is no chrome by its
    names, what stands in one may be a header, and its prose is chrome only by the names of adverts and comments."""
    within, deep = {0: (False, False)}, []  # by number: whether chrome holds an element, and chrome by its tag
    for n in nodes[1:]:  # parents come before their children
        up = n.parent
        chrome, by_tag = within[up.number]
        if n.article and up.main is None and not chrome:
            n.main = n
        else:
            n.main = up.main
            if n.article and not by_tag and n.main is None:
                deep.append(n)
        within[n.number] = (chrome or n.chrome and n.tag != "form", by_tag or n.by_tag and n.tag != "form")
    tops = [n for n in nodes if n.main is n]
    if not tops and deep:
        tops = [max(deep, key=lambda n: (n.size, -n.number))]
        tops[0].main = tops[0]
        for n in nodes[1:]:
            n.main = n.main or n.parent.main
    for n in tops:
        while n is not None and not n.holds:
            n.holds, n = True, n.parent
    for n in nodes[1:]:
        if n.main is None and n.tag not in ("html", "body"):
            n.chrome = n.chrome or n.tag == "header" or any(of_furniture(x, {"header", "heading"}) and "header" in x.lower() for x in n.names)
        elif n.main is not None and n.tag in PROSE and not n.by_tag:
            n.chrome = any(of_furniture(x, NO_PROSE) for x in n.names)


def parsed(html: str) -> tuple[list[Node], list[list[tuple[str, Node]]]]:
    """A page's elements, parents before children, and its blocks of text: pieces with the element that each stands in.
    Unclosed and stray tags are taken as browsers take the common cases: a block ends an open p, an item an open
    item, and an end tag all that stands open within its element. An inline element's end tag counts within its block."""
    root = Node("", None, 0)
    nodes, blocks, now, text, at, open_ = [root], [], root, [], 0, {}

    def say(piece: str) -> None:
        piece = unescape(piece)
        text.append((piece, now))
        own = " ".join(piece.split())
        if own:
            now.pieces.append(own)
            now.size += len(own)

    def flush() -> None:
        if text:
            blocks.append(text[:])
            text.clear()

    def close(node: Node) -> None:
        node.hash = xxhash.xxh3_64_intdigest(f"{node.tag}\0" + "\0".join(node.pieces)) >> 1
        if node.parent is not None:
            open_[node.tag] -= 1
            if node.pieces:
                node.parent.pieces.append(str(node.hash))
            node.parent.size += node.size

    def up_to(node: Node) -> Node:
        """Close all open elements as far as `node` and it; what is open then."""
        n = now
        while True:
            close(n)
            if n is node:
                return n.parent
            n = n.parent

    def nearest(tags: set[str], within: set[str] = frozenset()) -> Node | None:
        if not any(open_.get(t) for t in tags):
            return None
        n = now
        while n.parent is not None and n.tag not in within:
            if n.tag in tags:
                return n
            n = n.parent
        return None

    for m in TAG.finditer(html, 0, html.rfind(">") + 1):  # no tag ends later, and none is sought there
        if m.start() < at:
            continue
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end() if not m[0].startswith("<!--") or m[0].endswith("-->") else len(html)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        block = tag in BLOCK
        if m[1]:
            n = nearest({tag}, frozenset() if block or tag in CHROME else BLOCK)
            if block or tag in CHROME:
                flush()
            elif tag == "br":
                text.append((" ", now))
            if n is not None:
                now = up_to(n)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(html, at)
            at = end.end() if end else len(html)
            text.append((" ", now))
            continue
        if tag == "br":
            text.append((" ", now))
        if block:
            flush()
            p = nearest({"p"}, {"table", "td", "th", "button"})
            if p is not None:
                now = up_to(p)
            if tag in ENDS and (n := nearest(*ENDS[tag])) is not None:
                now = up_to(n)
        if tag in VOID or m[3].endswith("/") and not block:
            continue
        if tag in CHROME and not block:
            flush()
            if (end := past(tag, html, at)) is not None:
                at = end  # nothing within is text
                continue
        now = Node(tag, now, len(nodes))
        nodes.append(now)
        open_[tag] = open_.get(tag, 0) + 1
        described(now, m[3])
    if at < len(html):
        say(html[at:])
    flush()
    while now is not None:
        close(now)
        now = now.parent
    settled(nodes)
    return nodes, blocks


def past(tag: str, html: str, at: int) -> int | None:
    """Where the element that begins before `at` ends, elements of its kind within it having ends of their own; if they have
    not, its first end; None if there is none."""
    depth, first = 1, None
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*+>", re.I).finditer(html, at):
        depth += -1 if m[1] else not m[0].endswith("/>")
        first = m.end() if m[1] and first is None else first
        if not depth:
            return m.end()
        if first is not None and tag not in NESTS:
            return first
    return first


def removable(node: Node) -> bool:
    """Templates are made of elements about the article. What is or holds an article, or is more than three quarters of one, is none; nor are
    sentences of an article, or inline elements of any sentence, that others have, too."""
    if node.parent is None or node.holds or not node.pieces or node.tag in ("html", "body"):
        return False
    if node.tag in PROSE:
        return node.main is None and not node.parent.prose
    return not node.prose and (node.main is None or 4 * node.size <= 3 * node.main.size)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def subtrees(batch: pa.RecordBatch) -> pa.RecordBatch:
    hosts, contents, numbers, hashes = [], [], [], []
    for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
        nodes, _ = parsed(html or "")
        own = [n for n in nodes if removable(n)]
        host = host_of(url)
        hosts.append(host)
        contents.append(nodes[0].hash)
        numbers.append([n.number for n in own])
        hashes.append([xxhash.xxh3_64_intdigest(f"{host}\0{n.hash}") >> 1 for n in own])
    lists = {"number": (numbers, pa.list_(pa.int32())), "hash": (hashes, pa.list_(pa.int64()))}
    return record_batch({"key": (batch.column("key"), pa.binary()), "host": (hosts, pa.string()), "content": (contents, pa.int64())} | lists)


def main_text(html: str, templates: set[int]) -> str:
    """A page's main text, its elements with these numbers being of the site's template.

    Chrome goes by its tag, role or names, but not where it holds the article (a form around the page, a body with a
    sidebar's name), and navigation by its tag goes in any case. Of what is left, the main text is that in the one
    outermost main or article element; of several, that in the smallest element that holds them all; of none, all.
    """
    nodes, blocks = parsed(html)
    gone, tops = set(), []
    for n in nodes:  # parents come before their children
        chrome = n.chrome and not (n.holds and not (n.by_tag and n.tag != "form"))
        if chrome or n.number in templates or (n.parent is not None and n.parent.number in gone):
            gone.add(n.number)
    texts = [[(t, n) for t, n in b if n.number not in gone] for b in blocks]
    for b in texts:
        for t, n in b:
            if n.main is not None and t.strip() and not any(n.main is x for x in tops[-1:]):
                tops.append(n.main)
    chosen = path(tops[0]) if tops else []
    for top in tops[1:]:
        up = set(map(id, path(top)))
        chosen = [n for n in chosen if id(n) in up]
    if chosen:
        inside = {id(chosen[0])}
        for n in nodes:
            if n.parent is not None and id(n.parent) in inside:
                inside.add(id(n))
        texts = [[(t, n) for t, n in b if id(n) in inside] for b in texts]
    return "\n".join(filter(None, (" ".join("".join(t for t, _ in b).split()) for b in texts)))


def path(node: Node) -> list[Node]:
    out = [node]
    while out[-1].parent is not None:
        out.append(out[-1].parent)
    return out


def extracted(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [main_text(html or "", set(gone or ())) for html, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
    return record_batch({"page_id": (batch.column("page_id"), pa.int64()), "url": (batch.column("url"), pa.string()), "text": (texts, pa.string()), "n_chars": ([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Per row of `pages` (page_id, url, html; other columns are dropped): page_id, url, text, n_chars.

    Subtrees (tag and content) are counted over the pages of their host, once for each different content of a page, and
    deleted where they recur (MANY, SHARE, ENOUGH); so are elements that are menus, adverts and the like (see
    `main_text`). Blocks are in page order, references decoded, white space single. A null or empty html has the
    empty text; a null or broken url has the empty host; pages that are alike but for scripts and markup count once,
    and repeated rows have equal results; very long pages are parsed whole; an empty table gives an empty one.

    Hashes take in the host, so one number names a subtree of a host. A subtree on a third of all pages is a sum before it is shuffled; its removal is a join that Spark can split.
    Pages meet their templates by shuffle at every size: the numbers grow with the pages, and are not for sending to all tasks.
    """
    scratch = Scratch(spark, "html")
    keyed = pages.select(F.unhex(row_key("page_id", "url", "html")).alias("key"), "page_id", "url", "html")
    trees = scratch.table(per_batch(keyed.select("key", "url", "html"), subtrees, "key binary, host string, content long, number array<int>, hash array<long>"), "trees")
    different = trees.groupBy("host", "content").agg(F.lit(1).alias("x")).groupBy("host").agg(F.count("*").alias("pages"))
    often = trees.select(F.explode(F.array_distinct("hash")).alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= MANY).drop("n")
    found = scratch.table(trees.select("key", "host", "content", F.inline(F.arrays_zip("number", "hash"))).join(often, "hash"), "found")
    counted = found.groupBy("hash", "content").agg(F.first("host").alias("host")).groupBy("hash").agg(F.count("*").alias("n"), F.first("host").alias("host")).where(F.col("n") >= MANY)
    template = counted.join(different, "host").where((F.col("n") >= SHARE * F.col("pages")) | (F.col("n") >= ENOUGH)).select("hash")
    gone = found.join(scratch.table(template, "template"), "hash").groupBy("key").agg(F.collect_set("number").alias("gone"))
    gone = scratch.table(gone, "gone")
    scratch.drop_all_but(gone)
    return per_batch(keyed.hint("merge").join(gone, "key", "left").select("page_id", "url", "html", "gone"), extracted, "page_id long, url string, text string, n_chars long")
