"""Main text of web pages by tree scoring.

A page becomes a tree of its elements; formatting tags leave no trace, so that
unclosed ones do no harm, and missing end tags of paragraphs, items and cells
are implied. Parts that are no reading text go first: by tag, by role, when
hidden, and by the words of their class and id. Then every paragraph, which is
any element with text of its own, gives points for its presence, its commas and
its length to its ancestors, the full number to the nearest and half as many to
each next one; an ancestor's points are discounted by the share of its text that
lies in links. The best container is widened to the article around it where the
page marks one, or else to what holds nothing but it; of its siblings, headings
stay, and without such a mark also paragraphs of running text and containers
with the page's title or a fifth of its points. Lists made
of links alone are menus and go. All other text of the kept part stays, whatever
its length, one line for each block.

Each page is worked out on its own, so nothing is shuffled and a task holds one
small batch; time is in proportion to the page, however deep it is nested.

Odd rows: null and empty html give an empty text, html without tags is all text,
a comment, tag or script that the page does not end is left out.
Equal pages give equal results, each its own row. Other columns keep their
names; operators name only what they add.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyward.llm.common import sliced

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that only style their text.
FORMATTING = frozenset(
    "abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small strike strong sub sup time tt u var".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset(("td", "th"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that end when one of the named ones starts, and the element beyond which that does not reach.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
ENDS |= {c: ({"td", "th"}, {"table", "tr"}) for c in CELL} | {"tr": ({"tr", "td", "th"}, {"table"})}

CUT_TAGS = frozenset(
    "aside audio button canvas datalist dialog embed footer form frameset head iframe map menu nav noscript object script search select style svg template textarea video".split()
)
CUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CUT_WORDS = frozenset(
    "ad ads adslot adsense advert adverts advertisement advertisements advertising banner billboard breadcrumb breadcrumbs comment comments commentlist"
    " consent cookie cookies copyright crumbs discussion disqus feedback footer gdpr login masthead menu menus modal nav navbar navigation newsletter"
    " notice notices notification notifications overlay pager pagination paging paywall popup promo promos promoted promotion recommendations recommended"
    " related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar"
    " trending widget widgets".split()
)
#: Beginnings and ends that say the same in words run together.
CUT_STARTS = ("adsense", "advert", "breadcrumb", "cookie", "newsletter", "sidebar", "sponsor", "subscri")
CUT_ENDS = ("breadcrumbs", "comments", "footer", "navbar", "newsletter", "sidebar")
#: Said of an element that has, or lacks, such a part.
ABOUT = frozenset(("has", "with", "no", "without", "hide"))
LEVELS = 5
SIBLING_SHARE = 0.2
RUNNING = 80


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "article", "marked", "headed", "points", "length", "linked", "links", "own", "cut", "block")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list[Node | str] = []
        self.block = tag in BLOCK
        self.marked = tag in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articlebody"
        self.article = self.headed = False
        self.points = 0.0
        self.length = self.linked = self.links = self.own = 0
        self.cut = False


class _Tree(HTMLParser):
    """Elements of a page with their texts, formatting left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.open: Counter[str] = Counter()
        self.order = [self.root]

    def close_to(self, node: Node) -> None:
        while True:
            done = self.at
            self.open[done.tag] -= 1
            self.at = done.parent
            if done is node:
                return

    def nearest(self, tags: set[str], beyond: set[str] | frozenset[str]) -> Node | None:
        if not any(self.open[t] for t in tags):
            return None
        node = self.at
        while node.parent is not None and node.tag not in beyond:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in FORMATTING or tag in ("html", "body"):
            return
        if tag == "br":
            self.at.items.append(" ")
            return
        if tag in VOID and tag != "hr":
            return
        if tag in ENDS:
            ended, beyond = ENDS[tag]
            if node := self.nearest(ended, beyond):
                self.close_to(node)
                if tag == "tr" and (node := self.nearest({"tr"}, {"table"})):
                    self.close_to(node)
        elif tag in BLOCK and (node := self.nearest({"p"}, BLOCK - {"p"})):
            self.close_to(node)
        elif tag == "a" and (node := self.nearest({"a"}, BLOCK)):
            self.close_to(node)
        # words run together with capitals are told apart before these go
        new = Node(tag, {k: re.sub("(?<=[a-z])(?=[A-Z])", "-", v or "").lower() for k, v in attrs}, self.at)
        self.at.items.append(new)
        self.order.append(new)
        if tag != "hr":
            self.open[tag] += 1
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        # an inline element does not end those around it
        beyond = frozenset() if tag in BLOCK or tag in CELL else BLOCK
        if node := self.nearest({tag}, beyond):
            self.close_to(node)

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", name)


def _cut_word(word: str) -> bool:
    return word in CUT_WORDS or word.startswith(CUT_STARTS) or word.endswith(CUT_ENDS)


def _named_off(node: Node) -> bool:
    """Whether class or id says that this is no reading text."""
    for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split():
        words = _words(name)
        hits = [w for i, w in enumerate(words) if (_cut_word(w) or (w == "header" and not node.parent.article)) and not ABOUT & set(words[:i])]
        # a whole article is only left out by a name that says nothing else
        if hits and (not node.marked or len(words) == 1):
            return True
    return False


def _hidden(node: Node) -> bool:
    style = node.attrs.get("style", "").replace(" ", "")
    return "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _mark_cut(order: list[Node], by_name: bool) -> None:
    """Cut what is no reading text, and all inside it; also tell which elements lie in an article."""
    around: set[Node] = set()
    for node in reversed(order):
        if node.parent is not None and (node.tag in ("article", "main") or node in around):
            around.add(node.parent)
        node.headed = node.headed or node.tag == "h1"
        if node.headed and node.parent is not None:
            node.parent.headed = True
    for node in order[1:]:
        up = node.parent
        node.article = node.marked or up.article
        off = node.tag in CUT_TAGS or node.attrs.get("role") in CUT_ROLES or (node.tag == "header" and not up.article) or _hidden(node)
        # a form around the whole page is none
        off = off and not (node.tag == "form" and (node in around or node.headed))
        node.cut = up.cut or off or (by_name and node not in around and _named_off(node))


def _measure(order: list[Node]) -> None:
    """Lengths, and points handed up; children stand after their parents in ``order``."""
    for node in order:
        node.points, node.length, node.linked, node.links = 0.0, 0, 0, 0
    for node in reversed(order):
        if node.cut:
            continue
        own = " ".join("".join(x for x in node.items if isinstance(x, str)).split())
        node.own = len(own)
        node.length += node.own
        if node.tag == "a":
            node.linked, node.links = node.length, 1
        up = node.parent
        if up is not None:
            up.length, up.linked, up.links = up.length + node.length, up.linked + node.linked, up.links + node.links
        if not own or node.tag == "a":
            continue
        # text in a paragraph belongs to what holds it, bare text of a container to the container
        points = 1 + own.count(",") + own.count("，") + own.count("、") + min(node.own / 100, 3)
        holder = node.parent if node.tag in ("p", "pre", "blockquote", "li", "span") or node.tag in HEADING else node
        for level in range(LEVELS):
            if holder is None:
                break
            holder.points += points / 2**level
            holder = holder.parent


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _score(node: Node) -> float:
    return node.points * (1 - _density(node))


def _kept(order: list[Node]) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    holders = [n for n in order if not n.cut and n.points and n.tag not in ("p", "a", "span") and n.tag not in HEADING]
    if not holders:
        return [order[0]] if order[0].length else []
    best = max(holders, key=_score)
    node, marked = best, None
    while node.parent is not None:
        if node.tag == "article" or (node.tag == "main" and (marked is None or marked.tag != "article")):
            marked = node
        node = node.parent
    top = marked or best
    while not marked and top.parent is not None and top.parent.length == top.length:
        top = top.parent
    if top.parent is None:
        return [top]
    out = []
    for other in top.parent.items:
        if other is top:
            out.append(top)
        elif isinstance(other, Node) and not other.cut and other.length:
            text = other.tag in HEADING or (other.headed and not marked)
            if not marked:
                running = other.tag in ("p", "pre", "blockquote") and _density(other) < 0.25
                ended = not other.linked and re.search(r"[.!?…]\W*$", _text([other])) is not None
                text = text or (running and (other.length >= RUNNING or ended)) or (other.tag not in ("p", "a", "span") and _score(other) >= SIBLING_SHARE * _score(best))
            if text and _density(other) < 0.5:
                out.append(other)
    return out


def _menu(node: Node) -> bool:
    return node.tag in ("ul", "ol", "dl", "div", "section", "table", "p") and node.links >= 3 and _density(node) >= 0.9


def _text(kept: list[Node]) -> str:
    """One line for each block, white space turned into single spaces."""
    lines: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(piece).split()):
            lines.append(line)
        piece.clear()

    for top in kept:
        walk: list[tuple[Node, Iterator[Node | str]]] = [(top, iter(top.items))]
        flush()
        while walk:
            node, rest = walk[-1]
            item = next(rest, None)
            if item is None:
                walk.pop()
                if node.block:
                    flush()
                elif node.tag in CELL:
                    piece.append(" ")
            elif isinstance(item, str):
                piece.append(item)
            elif item.block:
                flush()
                if not (item.cut or _menu(item)):
                    walk.append((item, iter(item.items)))
            elif not item.cut:
                if item.tag in CELL:
                    piece.append(" ")
                walk.append((item, iter(item.items)))
    flush()
    return "\n".join(lines)


def main_text(html: str | None) -> str:
    """The reading text of one page."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html.replace("<![", "<!"))
    if not re.match(r"<(!--|/?[a-zA-Z])", tree.rawdata) or tree.cdata_elem:
        tree.close()
    text = ""
    for by_name in (True, False):
        _mark_cut(tree.order, by_name)
        _measure(tree.order)
        text = _text(_kept(tree.order))
        if text:
            break
    return text


def _extract(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            texts = pa.array([main_text(h) for h in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*batch.schema.names[1:], name])

    return run


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without ``html`` and with the main text as ``text``; a column of that name is replaced."""
    kept = [c for c in pages.columns if c not in (html, text)]
    shape = T.StructType([pages.schema[c] for c in kept] + [T.StructField(text, T.StringType())])
    return pages.select(html, *kept).mapInArrow(_extract(text), shape)
