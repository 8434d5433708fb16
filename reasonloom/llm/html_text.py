"""Main text of web pages by composite text density.

For every node of a page's tree the density is its characters per tag, lowered by the share of its
characters that stand in links; a node's density sum adds up its children's densities. The subtree
of the largest density sum is main text, widened while a parent on the path from the body down
holds its density above the least one on that path. So is every other subtree under the body that
reaches this least density, with the headings before it and the plain blocks between; where an
article or main element holds the largest sum, only what is in that main, or in articles beside
that one. Menus, headers, footers, forms, notices and the
like are taken out of the tree first, by tag, role and names of classes and ids. A form or a box of
such a name stays if it holds the page's heading or article and most of its text; names that also
serve for parts of a text, such as `widget` or `related`, count for boxes of links alone; headings
are never judged by a name, nor what is inside an article by an id, unless it is a box of links.

A page is parsed in one pass of a regular expression over its whole html, in time that grows with
its length whatever is nested or left open.

Defined results: null and empty html, and pages without text, give an empty text; unclosed and
stray tags are closed as browsers do; repeated rows are extracted alike; null ids and urls are kept;
an empty table gives no row; other columns are ignored; of subtrees of equal sums that of more
characters, then the first, is chosen. A very long page is held whole by its task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonloom.llm.tokens import arrow_rows, char_batches

# Roles of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(
    "script style noscript template textarea svg annotation annotation-xml iframe object canvas title".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CHROME_TAGS = frozenset("nav header footer aside menu dialog button select fieldset head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split()
)
CHROME_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|"
    r"footer|masthead|comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|notice\w*|"
    r"newsletter|subscribe|signup|login|popup|modal|overlay|share|sharing|pagination|pager|skip\w*|"
    r"site-?header|page-?header)(?:$|[-_ \d])",
    re.IGNORECASE,
)
# Names that also stand on parts of a text.
LINK_BOX_NAMES = re.compile(
    r"(?:^|[-_ ])(?:header|social|related|recommended|toolbar|widget\w*)(?:$|[-_ \d])", re.IGNORECASE
)
TEXT_TAGS = frozenset("article main".split())
# An open element of the key is closed by the start of one of the values, within these borders.
BORDERS = frozenset("div table ul ol article body section".split())
CLOSED_BY = {
    "head": BLOCKS,
    "p": frozenset(
        "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
        "main nav ol p pre section table ul".split()
    ),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
}
CLOSING = frozenset().union(*CLOSED_BY.values())
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = re.compile(r"class|id|role|hidden", re.IGNORECASE)  # parts of the attributes that count
BLANKS = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    chrome: bool = False  # not main text by its kind; nothing below it is looked at
    doubt: str = ""  # why it is chrome, if that may turn out wrong: "name", "form" or "links"
    heading: bool = False  # it is a heading or holds nothing else
    children: list[Node | str] = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    density: float = 0.0
    total: float = 0.0
    peak: float = 0.0  # the largest density of the node and all below it


def _by_attributes(tag: str, attributes: str, in_text: bool) -> tuple[bool, str]:
    """Whether the attributes say that an element is not main text, and the doubt about it."""
    if tag in ("body", "html") or tag in TEXT_TAGS or not TELLING.search(attributes):
        return False, ""
    doubt = ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, ""
        if name == "role" and value.lower() in CHROME_ROLES:
            return True, ""
        if name in ("class", "id") and tag not in HEADINGS:
            if CHROME_NAMES.search(value):
                doubt = "links" if in_text and name == "id" and doubt != "name" else "name"
            elif not doubt and LINK_BOX_NAMES.search(value):
                doubt = "links"
    return bool(doubt), doubt


def _new_node(tag: str, parent: Node, attributes: str, in_text: bool) -> Node:
    if tag in CHROME_TAGS and not (tag == "header" and in_text):
        return Node(tag, parent, chrome=True)
    chrome, doubt = _by_attributes(tag, attributes, in_text)
    if tag == "form" and (doubt or not chrome):
        return Node(tag, parent, True, "form")
    return Node(tag, parent, chrome, doubt)


class _Open:
    """The open elements of a page: their number by tag, and those that others close."""

    def __init__(self, root: Node):
        self.root, self.here = root, root
        self.counts: dict[str, int] = {}
        self.closable: list[Node] = []

    def start(self, node: Node) -> None:
        self.here = node
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1
        if node.tag in CLOSED_BY or node.tag in BORDERS:
            self.closable.append(node)

    def end(self, node: Node) -> None:
        """Close an element and all that is open inside it."""
        here = self.here
        while here is not node.parent:
            self.counts[here.tag] -= 1
            if self.closable and self.closable[-1] is here:
                self.closable.pop()
            here = here.parent
        self.here = here

    def end_tag(self, tag: str) -> None:
        if self.counts.get(tag):
            node = self.here
            while node.tag != tag:
                node = node.parent
            self.end(node)

    def imply_end(self, tag: str) -> None:
        """What the start of an element closes before it."""
        if tag in CLOSING:
            for node in reversed(self.closable):
                if node.tag in BORDERS:
                    return
                if tag in CLOSED_BY[node.tag]:
                    self.end(node)
                    return

    def in_text(self) -> bool:
        return any(self.counts.get(tag) for tag in TEXT_TAGS)


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root", None)
    opened, at, end = _Open(root), 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            opened.here.children.append(html.unescape(page[at:stop]))
        if not found:
            break
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        tag = name.lower()
        if found.group(1):
            opened.end_tag(tag)
            continue
        if tag in RAW and not found.group(3).rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        opened.imply_end(tag)
        node = _new_node(tag, opened.here, found.group(3), opened.in_text())
        opened.here.children.append(node)
        if tag not in VOID:
            opened.start(node)
    _reprieve(root)
    return root


def _reprieve(root: Node) -> None:
    """Take back what the tree shows to be wrong.

    A name like `with-sidebar`, or a form, on what holds the page's heading or article, or most of
    its text, says nothing of that text; names in doubt count for boxes of links alone.
    """
    nodes: list[Node] = []
    waiting = [(root, False)]
    links: dict[int, bool] = {}
    while waiting:
        node, in_link = waiting.pop()
        links[id(node)] = in_link = in_link or node.tag == "a"
        nodes.append(node)
        if not node.chrome or node.doubt:
            waiting.extend((c, in_link) for c in node.children if not isinstance(c, str))
    sizes: dict[int, int] = {}
    linked: dict[int, int] = {}
    heads: set[int] = set()  # nodes with a heading or an article inside
    for node in reversed(nodes):
        if node.parent is not None and (id(node) in heads or node.tag in ("article", "main", "h1")):
            heads.add(id(node.parent))
        own = in_links = 0
        if not node.chrome or node.doubt:
            for c in node.children:
                if isinstance(c, str):
                    size = len(BLANKS.sub("", c))
                    own += size
                    in_links += size if links[id(node)] else 0
                else:
                    own += sizes[id(c)]
                    in_links += linked[id(c)]
        sizes[id(node)], linked[id(node)] = own, in_links
    for node in nodes:
        size = sizes[id(node)]
        if node.doubt == "links":
            node.chrome = size > 0 and 2 * linked[id(node)] >= size
        elif node.doubt:
            most = 2 * size > sizes[id(root)]
            holds = id(node) in heads
            node.chrome = not ((holds or most) if node.doubt == "form" else (holds and most))


def measure(root: Node) -> list[Node]:
    """Densities and density sums of all nodes, children before parents; returns the nodes."""
    nodes, waiting = [], [(root, False)]
    while waiting:
        node, in_link = waiting.pop()
        in_link = in_link or node.tag == "a"
        nodes.append(node)
        if node.chrome:
            continue
        for child in node.children:
            if isinstance(child, str):
                size = len(BLANKS.sub("", child))
                node.chars += size
                node.link_chars += size if in_link else 0
            else:
                waiting.append((child, in_link))
    for node in reversed(nodes):
        text_only = node.chars - node.link_chars
        node.density = node.chars / max(node.tags, 1) * (text_only / node.chars if node.chars else 0.0)
        if node.parent is not None and not node.chrome:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            node.parent.tags += node.tags + 1
            node.parent.total += node.density
        node.peak = max(node.peak, node.density)
        if node.parent is not None and not node.chrome:
            node.parent.peak = max(node.parent.peak, node.peak)
        node.heading = node.tag in HEADINGS or _only_heading(node)
    return nodes


def _only_heading(node: Node) -> bool:
    """Whether all that a node holds is one heading; its children are measured."""
    filled = None
    for c in node.children:
        if c.strip() if isinstance(c, str) else c.chars and not c.chrome:
            if filled is not None:
                return False
            filled = c
    return isinstance(filled, Node) and filled.heading


def main_parts(root: Node) -> list[Node | str | None]:
    """The subtrees of the main text in page order; null where a block ends.

    The node of the largest density sum, widened by the threshold of the path to the body, and what
    reaches that threshold beside it.
    """
    nodes = [n for n in measure(root) if not n.chrome and n.chars]
    if not nodes:
        return []
    body = next((n for n in nodes if n.tag == "body"), root)
    best = max(nodes, key=lambda n: (n.total or n.density, n.chars))
    path = [best]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    while best is not body and best.parent is not None and best.parent.density > least:
        best = best.parent
    path = path[next(k for k, n in enumerate(path) if n is best) :]
    marked = [k for k, n in enumerate(path) if n.tag in ("article", "main")]
    if not marked:
        return _parts(path, least)
    main = next((k for k in marked if path[k].tag == "main"), None)
    if main is not None:
        return _parts(path[: main + 1], least)
    return _parts(path[: marked[-1] + 2], least, articles=marked[-1])


def _parts(path: list[Node], least: float, articles: int | None = None) -> list[Node | str | None]:
    """What reaches `least` under the last node of `path`, and the first node of `path`.

    With `articles`, the place of an article on the path, beside that one articles alone count.
    """
    best, above = path[0], {id(n) for n in path[1:]}
    beside = id(path[articles + 1]) if articles is not None and articles + 1 < len(path) else 0
    parts: list[Node | str | None] = []
    held: list[Node | str | None] = []  # stays if a kept part follows
    solid = 0  # how many of them are not ends of blocks
    waiting: list[Node | str | None] = [path[-1]]
    while waiting:
        item = waiting.pop()
        if item is None:
            held.append(None)
            continue
        if isinstance(item, str):
            plain, heading = True, False
            kept = 0 < least <= len(BLANKS.sub("", item))
        else:
            if item.chrome or not item.chars:
                held.extend([None] if item.tag in BLOCKS else [])
                continue
            if id(item) in above:
                inner = item.children
                if id(item) == beside:
                    inner = [None if _left_out(c, best, above) else c for c in inner]
                waiting.extend((None, *reversed(inner), None))
                continue
            plain, heading = not item.link_chars, _is_heading(item)
            kept = item is best or 0 < least <= item.density
        if kept and not (heading and item is not best):
            parts.extend((*held, item))
            held.clear()
            solid = 0
        elif not isinstance(item, str) and not heading and item.peak >= least > 0:
            waiting.extend((None, *reversed(item.children), None))
        elif heading or (plain and (parts or solid)):
            held.append(item)
            solid += 1
        elif not plain:  # links: they take their own heading along
            while held and (held[-1] is None or _is_heading(held[-1])):
                solid -= held.pop() is not None
            held.append(None)
    return parts


def _left_out(child: Node | str, best: Node, above: set[int]) -> bool:
    """Whether a child of what holds articles is neither an article, nor a heading, nor on the path."""
    if isinstance(child, str):
        return True
    return child.tag != "article" and child is not best and id(child) not in above and not child.heading


def _is_heading(item: Node | str | None) -> bool:
    return isinstance(item, Node) and item.heading


def text_of(parts: list[Node | str | None]) -> str:
    """The blocks of subtrees in page order, blanks folded, joined by one blank."""
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        text = BLANKS.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    waiting: list[Node | str | None] = parts[::-1]
    while waiting:
        item = waiting.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            line.append(item)
        elif not item.chrome:
            if item.tag in BLOCKS:
                end_block()
                waiting.append(None)
            waiting.extend(reversed(item.children))
    end_block()
    return " ".join(blocks)


def extract(page: str | None) -> str:
    return text_of(main_parts(parse(page))) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages`."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in char_batches(arrow_rows(batch)):
                ids, urls, whole = zip(*group, strict=True)
                texts = [extract(page) for page in whole]
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array(urls, pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    return rows.mapInArrow(apply, "page_id long, url string, text string, n_chars long")
