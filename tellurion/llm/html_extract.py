"""Main text of web pages by removal of site templates.

Every element subtree is hashed (tag, class, id, role, text and children); the subtrees of
all pages are counted for each host in Spark, and those that recur on MIN_PAGES different pages
of their host or more, whatever the host's size, are deleted from the whole page: menus, notices,
adverts and footers repeat, articles do not. Pages that carry the same prose (their text, where
they have no paragraph or heading) count once, so that copies of an article never make it a
template, and paragraphs and headings inside an article are never deleted by this count, nor are
links and emphasis in the midst of a text.

Some content has no words of the page to count or never recurs: scripts, styles, forms and reader
comments go by their tag or class on every page. What else an element says of itself (nav, footer,
aside, role and class names, an <article> or main element that bounds the text) is asked only where
the count leaves text outside the articles of a page: on hosts with too few pages, and for
furniture that is too rare. Inside an article class names count only as whole names, and never
on paragraphs and headings. All outermost articles that are no boilerplate are kept.

The text is that of the blocks in page order, character references decoded, white space in
a block made one space, blocks joined by one space. Null and empty pages give an empty
text. Malformed markup never fails: unclosed elements end with their parent, and what is
no tag is text. Pages without a host (null or broken URLs) are not counted together. Parsing
takes time in proportion to a page's length, however it is nested or broken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.session import saved

MIN_PAGES = 4

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag; quotes hide a closing bracket. It never steps back.
REST = re.compile(r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>""")
#: After so many tags of a page that never close, quotes hide nothing any more.
UNCLOSED = 20
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - {"br", "body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "title"}
#: A start tag ends an open element of these, up to one of the bounds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BOUNDS = frozenset("ul ol dl table select article section div nav aside main body html menu".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption td th tr b i em strong span a code br".split())
#: Of these, one that has a text beside it is a part of that text.
INLINE = frozenset("b i em strong span a code".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never text of an article, whatever the count says.
NO_TEXT = frozenset("head title script style noscript template iframe form button select textarea input svg dialog object canvas".split())
DROPPED = NO_TEXT | frozenset("nav footer aside menu".split())
COMMENTS = frozenset("comment comments reply replies disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox adv advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation topnav subnav breadcrumb breadcrumbs sidebar "
    "side footer foot cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social "
    "related recommended comment comments reply replies disqus login search pagination pager toolbar widget skip masthead copyright".split()
)
#: Those that, as a whole class name or id, mark furniture inside an article.
INNER_NAMES = frozenset("ad ads adbox adv advert adverts advertisement sponsor sponsored promo cookie cookies newsletter subscribe signup share sharing social popup modal".split())
#: Names of headers, which may also stand in an article and hold its title.
HEADER_NAMES = frozenset("header topbar banner".split())
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    names: str = ""
    role: str = ""
    parts: list = field(default_factory=list)  # texts and nodes in order
    hash: int = 0
    size: int = 0  # characters of text below
    heading: bool = False  # is or holds a heading


class Open:
    """The open elements of a page, and where in the stack those of each tag are."""

    def __init__(self):
        self.root = Node("#root")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: tuple[str, ...], bounds: frozenset) -> None:
        """End the innermost open element of these tags, if no bound stands inside it."""
        at = self.last(tags)
        if at and at > self.last(bounds):
            self.cut(at)


def tag_end(text: str, at: int, unclosed: list[int]) -> int:
    """Where the tag that began before `at` ends, its bracket included; -1 if it never does."""
    if len(unclosed) < UNCLOSED:
        m = REST.match(text, at)
        if m:
            return m.end()
        unclosed.append(at)
    return text.find(">", at) + 1 or -1


def parse(source: str | None) -> Node:
    """The element tree of a page; text is decoded."""
    text, at, shown, unclosed = source or "", 0, 0, []
    opened = Open()
    raw_end: dict[str, re.Pattern] = {}

    def say(end: int) -> None:
        if end > shown:
            opened.stack[-1].parts.append(html.unescape(text[shown:end]))

    last_end = text.rfind(">")
    while True:
        start = text.find("<", at)
        if start < 0 or start > last_end:
            if start >= 0 and (comment := text.find("<!--", start)) >= 0:  # a comment that never ends
                say(comment)
            else:
                say(len(text))
            return opened.root
        if text.startswith("<!--", start):
            say(start)
            end = text.find("-->", start + 4)
            shown = at = end + 3 if end >= 0 else len(text)
            continue
        if text[start + 1 : start + 2] in ("!", "?") and start + 1 < len(text):
            say(start)
            shown = at = text.find(">", start) + 1
            continue
        ends = text.startswith("/", start + 1)
        name = NAME.match(text, start + 1 + ends)
        if name is None:
            at = start + 1
            continue
        end = tag_end(text, name.end(), unclosed)
        say(start)
        shown = at = end
        tag, rest = name[0].lower(), text[name.end() : end - 1]
        if ends:
            if opened.places.get(tag):
                opened.cut(opened.places[tag][-1])
            elif tag == "p":
                opened.stack[-1].parts.append(Node("p"))
            continue
        if tag in ENDS_P:
            opened.close(("p",), BOUNDS)
        if tag in CLOSES:
            opened.close(CLOSES[tag], BOUNDS)
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(rest)} if rest else {}
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip() if attributes else ""
        node = Node(tag, names, (attributes.get("role", "") or attributes.get("itemprop", "")).lower() if attributes else "")
        opened.stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            if tag not in raw_end:
                raw_end[tag] = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE)
            m = raw_end[tag].search(text, at)
            shown = at = m.end() if m else len(text)
            continue
        if rest.endswith("/") and tag not in BLOCK and tag not in INLINE:
            continue
        opened.push(node)


def in_order(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def hash_subtrees(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        h = xxhash.xxh64(f"{node.tag}\0{node.names}\0{node.role}\0".encode())
        size, node.heading = 0, node.tag in HEADINGS
        for part in node.parts:
            if isinstance(part, Node):
                h.update(part.hash.to_bytes(8, "little"))
                size += part.size
                node.heading |= part.heading
            elif flat := " ".join(part.split()):
                h.update(b"\1" + flat.encode("utf-8", "surrogatepass"))
                size += len(flat)
        node.hash, node.size = h.intdigest(), size


def words_in(names: str) -> list[str]:
    return re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower())


def never_text(node: Node) -> bool:
    """What is no text of an article on any page: forms, scripts and the like, and reader comments."""
    return node.tag in NO_TEXT or bool(node.names) and node.tag not in PROSE and node.tag not in ("html", "body", "main") and not COMMENTS.isdisjoint(words_in(node.names))


def said_boilerplate(node: Node, within: bool = False) -> bool:
    """What an element says of itself; within: inside an article."""
    if node.tag in DROPPED or node.role in ROLES:
        return True
    if not node.names or node.tag in ("html", "body", "main"):
        return False
    if within:
        return node.tag not in PROSE and not INNER_NAMES.isdisjoint(node.names.lower().split())
    return not NAMES.isdisjoint(words_in(node.names))


def is_header(node: Node) -> bool:
    return node.tag == "header" or bool(node.names) and node.tag not in HEADINGS and not HEADER_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", node.names.lower()))


def main_elements(root: Node) -> list[Node]:
    """The outermost articles outside boilerplate in page order, else the first main element, else none."""
    articles, mains, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if node is not root and (never_text(node) or said_boilerplate(node)):
            continue
        if node.tag == "article" or node.role in ("article", "articlebody"):
            articles.append(node)
            continue
        if node.tag == "main" or node.role == "main":
            mains.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return [a for a in articles if a.size] or mains[:1]


def in_midst(nodes: list[Node]) -> set[int]:
    """Ids of the inline elements whose parent has words of its own."""
    return {id(p) for n in nodes if any(isinstance(p, str) and re.search(r"\w", p) for p in n.parts) for p in n.parts if isinstance(p, Node) and p.tag in INLINE}


def below(tops: list[Node]) -> set[int]:
    """Ids of these nodes and all that are in them."""
    return {id(n) for top in tops for n in in_order(top)}


def candidates(source: str | None) -> tuple[int, list[int]]:
    """A hash of the page's prose, and the hashes of subtrees that may belong to a template."""
    root = parse(source)
    nodes = in_order(root)
    hash_subtrees(nodes)
    mains = main_elements(root)
    inside, tops, midst = below(mains), set(map(id, mains)), in_midst(nodes)
    found = {n.hash for n in nodes[1:] if n.size and n.tag not in ("html", "body", "head") and not (id(n) in inside and (id(n) in tops or n.tag in PROSE)) and id(n) not in midst}
    prose = xxhash.xxh64()
    said = [n for n in nodes if n.tag in ("p", *HEADINGS) and n.size and (not mains or id(n) in inside)]
    for n in said:
        prose.update(n.hash.to_bytes(8, "little"))
    if not said:
        prose.update(extract_text(source).encode("utf-8", "surrogatepass"))
    return prose.intdigest(), sorted(found)


def emit(top: Node, gone: Callable[[Node, bool], bool], inside: set[int]) -> list[str]:
    """The texts of the blocks of a tree, without the elements that are gone."""
    blocks: list[list[str]] = [[]]
    stack: list = [top]
    while stack:
        item = stack.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif item is top or not gone(item, id(item) in inside):
            if item.tag in BLOCK:
                blocks.append([])
                stack.append(None)
            stack += reversed(item.parts)
    return [line for line in (" ".join("".join(b).split()) for b in blocks) if line]


def extract_text(source: str | None, template: frozenset[int] = frozenset()) -> str:
    """The text of a page without the subtrees of its host's template.

    Where the count leaves no words outside the articles, it alone has decided. Else what
    elements say of themselves decides about the rest.
    """
    root = parse(source)
    nodes = in_order(root)
    hash_subtrees(nodes)
    mains = main_elements(root)
    inside, tops, midst = below(mains), set(map(id, mains)), in_midst(nodes) if template else set()

    def counted(n: Node, within: bool) -> bool:
        return never_text(n) or n.hash in template and n.size > 0 and id(n) not in tops and not (within and n.tag in PROSE) and id(n) not in midst

    def outside(n: Node, within: bool) -> bool:
        return id(n) in tops or counted(n, within)

    def said(n: Node, within: bool) -> bool:
        return counted(n, within) or id(n) not in tops and (said_boilerplate(n, within) or is_header(n) and not (within and n.heading))

    if template and mains and not emit(root, outside, inside):
        return " ".join(emit(root, lambda n, within: counted(n, within) or within and said(n, within), inside))
    return " ".join(line for top in mains or [root] for line in emit(top, said, inside))


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages(host, mark, html) -> (host, mark, template): for each page the hashes it has that recur in its host's pages.

    A hash needs min_pages different pages. What recurs on a host grows with the host, so no
    list of it is made: it is joined to the pages' own subtrees, and a list is as long as its page.
    mark tells the pages of a host apart; should two share one, each gets the list of both, and
    all of it are templates of their host.
    """

    def found(batches):
        for batch in batches:
            hosts, marks, hashes, proses = [], [], [], []
            for host, mark, source in zip(batch.host, batch.mark, batch.html, strict=True):
                prose, own = candidates(source)
                hosts += [host] * len(own)
                marks += [mark] * len(own)
                hashes += own
                proses += [prose] * len(own)
            yield pd.DataFrame({"host": hosts, "mark": np.array(marks, np.int64), "hash": _signed(hashes), "prose": _signed(proses)})

    rows = saved(pages.filter("host is not null and host != ''").mapInPandas(found, "host string, mark long, hash long, prose long"), "subtrees")
    counts = rows.select("host", "hash", "prose").distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    often = saved(counts.filter(F.col("n") >= min_pages).select("host", "hash"), "often")
    # Both sides are stored, so that Spark can split a subtree that a large part of all pages has.
    own = rows.select("host", "mark", "hash").join(often, ["host", "hash"])
    return saved(own.groupBy("host", "mark").agg(F.collect_set("hash").alias("template")), "templates")


def extract(pages: DataFrame, source: Column, host: Column, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with a column `main_text`, which replaces one of that name."""
    keyed = pages.select(F.struct("*").alias("row"), source.alias("html"), host.alias("host")).withColumn("mark", F.xxhash64("html"))
    found = templates(keyed.select("host", "mark", "html"), min_pages)

    @F.pandas_udf("string")
    def text(sources: pd.Series, lists: pd.Series) -> pd.Series:
        sets = (frozenset() if t is None else frozenset(np.asarray(t, np.int64).view(np.uint64).tolist()) for t in lists)
        return pd.Series([extract_text(s, t) for s, t in zip(sources, sets, strict=True)], dtype=object)

    joined = keyed.join(found.hint("shuffle_hash"), ["host", "mark"], "left")
    return joined.select(*(F.col("row")[c].alias(c) for c in pages.columns if c != "main_text"), text("html", "template").alias("main_text"))
