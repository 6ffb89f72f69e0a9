"""Main text of web pages by tree scoring.

A small tree is built from the tags. Paragraphs give points for their
length and commas to their ancestors, half as many with each level; points
count less the more of an element's text is inside links. The element with
the most points is the container; siblings with enough points, or that read
like prose, are kept beside it. Menus, headers, footers, scripts, styles and
other parts that their tag, role or state names are left out as they are
read, as are reader comments and consent notices. Class names and ids are
evidence only: they often tell of a layout ("content-with-sidebar"), so an
element named like a sidebar, notice or advert, and a form, stays if it holds
the page's ``main`` element or most of its prose, and goes otherwise.

Cases: a null or empty page has an empty text, as has a page without any
text outside the parts named above; markup that is not closed, or closed
twice, is read as far as it goes; pages of any length and depth are read
whole; rows repeated with one id give one row each.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "script style noscript template head title nav footer aside button select textarea option iframe object svg "
    "canvas audio video map dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
PROSE = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "caption"}
HOLDERS = frozenset("#root html body main article section div center details".split())
# An opening tag closes an open one of these, up to the fence.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist "
    "disqus respond cookie cookies consent gdpr footer header masthead menu menus nav navbar navigation newsletter notice "
    "notices notification alert popup modal overlay promo promos promoted promotion related recommended recommendations "
    "share sharing sidebar sidebars social sponsor sponsored sponsors subscribe subscription paywall signup login toolbar "
    "widget widgets pagination pager skip topbar toc replies".split()
)
# Of these, names of what readers write and of consent; and words that make a name tell of a page's state.
ALWAYS = frozenset("comment comments commentlist disqus respond replies cookie cookies consent gdpr".split())
STATES = frozenset("open opened closed on off enabled disabled allowed free".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
# A header of one of these belongs to the text; a name that begins with one of those speaks of another element.
TITLED = frozenset("article post entry story page".split())
ABOUT_OTHERS = frozenset("has with no without hide show".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Share of the page's unlinked text, and characters of it, with which an element named like furniture is a wrapper.
MOST = 0.75
LEAST = 200
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "points", "chars", "linked", "main", "doubtful")

    def __init__(self, tag, parent, main=False, doubtful=False):
        self.tag, self.parent, self.main, self.doubtful = tag, parent, main, doubtful
        self.children: list = []
        self.points = 0.0
        self.chars = self.linked = 0


def furniture(tag: str, attrs: list, in_article: bool) -> float:
    """1 for an element that is no part of the main text, 0.5 for one that looks like it, 0 for others."""
    if tag in SILENT:
        return 1
    if tag == "header":
        return 0 if in_article else 1
    if tag in ("html", "body", "article", "main"):
        return 0
    doubt = 0.5 if tag == "form" else 0
    for key, value in attrs:
        if key == "hidden":
            return 1
        if not value:
            continue
        if key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and HIDDEN.search(value):
            return 1
        if key == "role":
            role = value.strip().lower()
            if role in ROLES:
                return 1
            doubt = max(doubt, 0.5 if role == "form" else 0)
        if key in ("class", "id"):
            doubt = max([doubt, *map(doubt_of, value.split())])
            if doubt == 1:
                return 1
    return doubt


def doubt_of(name: str) -> float:
    """How far one class name or id speaks of furniture."""
    parts = [p.lower() for p in NAME.findall(name)]
    if not parts or parts[0] in ABOUT_OTHERS:
        return 0
    found = NAMES.intersection(parts)
    if not found or found == {"header"} and TITLED.intersection(parts):
        return 0
    told = not ABOUT_OTHERS.intersection(parts) and parts[-1] not in STATES
    return 1 if told and ALWAYS.intersection((parts[0], parts[-1])) else 0.5


class Tree(HTMLParser):
    """Elements that hold text, with text pieces between them; furniture is passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.skip: list[str] = []  # open elements within furniture
        self.articles = self.doubts = 0
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag not in VOID:
                self.skip_ends(tag)
                if self.skip:
                    self.skip.append(tag)
                    return
                # the furniture's own element was closed by this tag
            else:
                return
        if tag == "br":
            self.at.children.append(" ")
            return
        if tag == "hr":
            self.at.children.append(Node("hr", self.at))
            return
        if tag in VOID:
            return
        if tag in ("html", "body") and self.is_open(tag):
            return
        if tag in ENDS:
            self.close_any(*ENDS[tag])
        if tag in CLOSES_P:
            self.close_any({"p"}, {"table", "td", "th", "button", "object"})
        doubt = furniture(tag, attrs, self.articles > 0)
        if doubt == 1:
            self.skip = [tag]
            self.at.children.append(gap(tag, self.at))
            return
        main = tag in ("article", "main") or any(k == "role" and v in ("main", "article") for k, v in attrs)
        node = Node(tag, self.at, main, doubt > 0)
        self.doubts += doubt > 0
        self.at.children.append(node)
        self.at = node
        self.open[tag] += 1
        self.articles += node.main

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def skip_ends(self, tag):
        """Furniture such as <li class=ad> ends where the next <li> opens."""
        closes = ENDS.get(tag)
        if closes and len(self.skip) == 1 and self.skip[0] in closes[0]:
            self.skip = []
        elif tag in CLOSES_P and self.skip == ["p"]:
            self.skip = []

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if self.skip:
            for n in range(len(self.skip) - 1, -1, -1):
                if self.skip[n] == tag:
                    del self.skip[n:]
                    return
            # a closing tag of an element around the furniture ends the furniture too
            if tag not in ("article", "main", "body", "html") or not self.is_open(tag):
                return
            self.skip = []
        if self.is_open(tag):
            while self.at.tag != tag:
                self.up()
            self.up()

    def handle_data(self, data):
        if not self.skip:
            self.at.children.append(data)

    def up(self):
        self.articles -= self.at.main
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def is_open(self, tag) -> bool:
        return self.open[tag] > 0

    def close_any(self, tags, fence):
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in fence:
            if node.tag in tags:
                while self.at is not node:
                    self.up()
                self.up()
                return
            node = node.parent


def gap(tag: str, parent: Node) -> Node:
    """What is left in the place of furniture."""
    return Node("hr" if tag in BLOCKS else "#gap", parent)


def without_doubtful(root: Node) -> None:
    """Takes out elements that look like furniture and are no wrappers of the main text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if type(c) is Node)
    prose: dict[int, int] = {}
    mains: set[int] = set()
    for node in reversed(order):
        own = 0
        for child in node.children:
            if type(child) is str:
                own += len(" ".join(child.split()))
            else:
                own += prose[id(child)]
                if child.tag == "main" or id(child) in mains:
                    mains.add(id(node))
        prose[id(node)] = 0 if node.tag == "a" else own
    wanted = max(LEAST, MOST * prose[id(root)])
    todo = [root]
    while todo:
        node = todo.pop()
        for n, child in enumerate(node.children):
            if type(child) is not Node:
                continue
            if child.doubtful and id(child) not in mains and prose[id(child)] < wanted:
                node.children[n] = gap(child.tag, node)
            else:
                todo.append(child)


def measured(root: Node) -> list[Node]:
    """All elements, each before its children; text lengths and points are filled in."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if type(c) is Node)
    commas: dict[int, int] = {}
    for node in reversed(order):
        own = [c for c in node.children if type(c) is str]
        size = sum(len(" ".join(c.split())) for c in own)
        node.chars += size
        if node.tag == "a":
            node.linked = node.chars
        marks = commas.pop(id(node), 0) + sum(c.count(",") + c.count("，") + c.count("、") for c in own)
        direct = node.tag in PROSE or node.tag in BLOCKS and size >= 25
        if direct and node.chars and node.parent is not None:
            points = (1 + marks + min(node.chars / 100, 3)) * (1 - node.linked / node.chars)
            above, share = node.parent, 1.0
            while above is not None and share > 0.1:
                above.points += points * share
                above, share = above.parent, share / 2
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            if not direct:
                commas[id(node.parent)] = commas.get(id(node.parent), 0) + marks
    return order


def chosen(order: list[Node]) -> list[Node]:
    """The container with the most points, and the siblings to keep, in page order."""
    weight = lambda n: n.points * (1 - n.linked / n.chars) * (2 if n.main else 1) if n.chars else 0.0
    best = max((n for n in order if n.tag in HOLDERS), key=weight)
    if not weight(best):
        mains = [n for n in order if n.main and n.chars]
        return mains[:1] or [order[0]]
    # Sections of one article belong together.
    above = best
    while above is not None:
        if above.main:
            best = above
        above = above.parent
    if best.parent is None or best.main and best.tag == "main":
        return [best]
    least = max(3.0, weight(best) * 0.2)
    kept = []
    for sibling in best.parent.children:
        if type(sibling) is not Node:
            continue
        if sibling is best:
            kept.append(sibling)
        elif not sibling.chars:
            continue
        elif best.tag == "article":
            if sibling.tag == "article" and weight(sibling) >= least or sibling.tag == "h1" and not has_title(best):
                kept.append(sibling)
        elif weight(sibling) >= least:
            kept.append(sibling)
        elif sibling.tag in PROSE and sibling.linked < 0.25 * sibling.chars:
            kept.append(sibling)
    return kept


def has_title(node: Node) -> bool:
    todo = [node]
    while todo:
        item = todo.pop()
        if item.tag == "h1":
            return True
        todo.extend(c for c in item.children if type(c) is Node)
    return False


def blocks_of(nodes: list[Node]) -> list[str]:
    """Text blocks in page order, white space inside a block as one space."""
    out, held = [], []

    def flush():
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    for top in nodes:
        todo: list = [top]
        while todo:
            item = todo.pop()
            if type(item) is str:
                held.append(item)
            elif item is None:
                flush()
            else:
                block = item.tag in BLOCKS or item.tag == "#root"
                if block:
                    flush()
                    todo.append(None)
                todo.extend(reversed(item.children))
        flush()
    return out


def main_text(html: str) -> str:
    tree = Tree()
    tree.feed(html)
    tree.close()
    if tree.doubts:
        without_doubtful(tree.root)
    return "\n".join(blocks_of(chosen(measured(tree.root))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from the whole of its html."""

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
