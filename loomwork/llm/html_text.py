"""Main text of HTML pages by composite text density.

Each DOM node has a density: its characters per tag, lowered by the share of its text that is in
links. The node whose block children's densities sum to the most starts the article; the least
density on its path up to body is the threshold. The article grows up that path to the highest node
under which another branch reaches the threshold, is a headline, or has text but no link; branches
of mostly links stay out. It does not grow out of an element that HTML itself marks as an article.

Nodes that never hold article text are left out before densities are computed, and inside the chosen
subtree too: by element (menus, forms, scripts and the like), and by the words of class, id and role.
Such words count as parts of a name on containers, but only as whole names on paragraphs, headings and inline
elements. A container named for its place (header, sidebar, form, ...) that holds an article, main or
h1 element, and all of them if they leave the page without a paragraph, are read like others. On a page
without an article or main element a name that only has such a word as a part, or a place's name, does not count against a container with more than half of the text of all paragraphs outside
of links: what holds the page's text is no sidebar or form of it. A short container beside
the article that speaks of accepting cookies is a notice, whatever it is called.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.common import small_batches

# Fixed values of HTML: elements without content, elements closed by others, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "thead": ("tr", "td", "th"),
}
CLOSE_P = BLOCKS - {"br", "body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "summary", "figcaption"}
SCOPES = frozenset("table ul ol dl div section article main aside nav header footer form body html td th blockquote figure".split())
FORMATS = frozenset("a b big code em font i s small span strike strong sub sup tt u abbr cite label mark q".split())
SKIPPED = frozenset("script style noscript template head title iframe object svg canvas button select textarea input nav footer aside dialog menu audio video map datalist".split())
PLACES = r"nav|navbar|navigation|menu|sidebar|side|aside|footer|foot|header|masthead|topbar|toolbar|banner|widget|overlay|modal|popup|search|share|sharing|social|tags|form"
NEVER = r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|breadcrumbs?|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|signup|login|related|recommended|pagination|pager"
PLACE, PURPOSE = (re.compile(rf"(?:^|[-_\s])(?:{words})(?:$|[-_\s\d])", re.IGNORECASE) for words in (PLACES, NEVER))
WHOLE_PURPOSE = re.compile(rf"(?:{NEVER})\d*", re.IGNORECASE)
WHOLE_NAME = re.compile(rf"(?:{PLACES}|{NEVER})\d*", re.IGNORECASE)
#: Names of an article's own parts, and of pages that have a sidebar or the like.
OWN_PARTS = re.compile(r"\b(?:(?:post|article|entry|story|content)[-_]?(?:header|head|title|body|content|text|footer)|(?:with|has|no)[-_]\w+)\b", re.IGNORECASE)
HEAD_ELEMENTS = frozenset("base link meta title style script noscript template head".split())
HEADLINES = frozenset("h1 h2 h3".split())
#: Elements on which only a whole name counts.
TEXTUAL = FORMATS | frozenset("p h1 h2 h3 h4 h5 h6 a li td th tr dt dd blockquote pre img figcaption".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOTICE = re.compile(r"\bcookies?\b.*\b(?:accept|agree|consent|allow|policy|settings)|\b(?:accept|agree|consent|allow)\b.*\bcookies?\b", re.IGNORECASE | re.DOTALL)
MOST_NOTICE = 300
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
TITLE = re.compile(r"<title\b[^>]*>", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "noise", "placed", "named", "sure", "kids", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, noise: bool):
        self.tag, self.noise = tag, noise
        self.placed = self.named = self.sure = False
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


class Tree(HTMLParser):
    """A forgiving DOM: unclosed elements end where HTML ends them, and stray ends are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", False)
        self.open = [self.root]
        self.count = Counter()  # of open elements by tag, below the root

    def _judge(self, node: Node, attrs: list[tuple[str, str | None]]) -> None:
        """Sets noise, and placed where only a name of a place says so."""
        if node.tag in SKIPPED:
            node.noise = True
            return
        if node.tag in ("html", "body", "article", "main"):
            return
        for name, value in attrs:
            if name in ("class", "id") and value:
                value = CAMEL.sub("-", OWN_PARTS.sub(" ", value))
                if node.tag in TEXTUAL:
                    node.noise |= any(map(WHOLE_NAME.fullmatch, value.split()))
                else:
                    node.placed |= bool(PLACE.search(value))
                    node.named |= bool(PURPOSE.search(value))
                    node.sure |= any(map(WHOLE_PURPOSE.fullmatch, value.split()))
            elif name == "role" and value and value.lower() in NOISE_ROLES:
                node.noise = True
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                node.noise = True
        node.noise |= node.tag == "header" and not self.count["article"] + self.count["main"]
        node.placed = (node.placed or node.tag == "form") and not node.noise and not node.named
        node.named &= not node.noise
        node.noise |= node.placed or node.named

    def _cut(self, i: int) -> None:
        """Closes the open elements from the i-th on."""
        self.count.subtract(x.tag for x in self.open[i:])
        del self.open[i:]

    def _close_to(self, tags: tuple[str, ...], scope: frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._cut(i)
                return
            if self.open[i].tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD_ELEMENTS and tag != "html" and self.count["head"]:  # what cannot be in head ends it
            self._cut(next(i for i, x in enumerate(self.open) if x.tag == "head"))
        if tag in ("html", "body"):
            if tag == "body" and not self.count["body"]:
                self._cut(1)
                self._push(tag, [])
            return
        if tag in CLOSE_P and self.count["p"]:
            self._close_to(("p",), SCOPES)
        if tag in CLOSES:
            self._close_to(CLOSES[tag], SCOPES - {"td", "th"} if tag in ("tr", "td", "th", "tbody", "thead", "tfoot") else SCOPES)
        if tag in BLOCKS and tag not in ("br", "hr"):
            while self.open[-1].tag in FORMATS:  # an unclosed inline element ends with its block
                self._cut(len(self.open) - 1)
            if tag in CLOSE_P and self.count["p"]:
                self._close_to(("p",), SCOPES)
        self._push(tag, attrs)
        if tag in VOID:
            self._cut(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag not in ("p", "div", "span", "b", "script"):
            self._cut(len(self.open) - 1)

    def _push(self, tag: str, attrs: list) -> None:
        node = Node(tag, False)
        self._judge(node, attrs)
        self.open[-1].kids.append(node)
        self.open.append(node)
        self.count[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return
            if tag in FORMATS and self.open[i].tag in SCOPES:
                return

    def handle_data(self, data: str) -> None:
        if data:
            self.open[-1].kids.append(data)


def _below(node: Node, within: bool = True) -> Iterator[Node]:
    """The elements below a node; noise and what is in it only if asked for."""
    todo = [k for k in node.kids if isinstance(k, Node)]
    while todo:
        k = todo.pop()
        if within or not k.noise:
            yield k
            todo += [x for x in k.kids if isinstance(x, Node)]


def _paragraphs(order: list[Node]) -> dict[int, int]:
    """Characters of paragraphs below each node, outside of links and of elements that never hold text."""
    own: dict[int, int] = {}
    inside: dict[int, tuple[bool, bool]] = {id(order[0]): (False, False)}  # in a paragraph, out of the count
    for node in order:
        paragraph, out = inside[id(node)]
        for k in node.kids:
            if isinstance(k, Node):
                inside[id(k)] = (paragraph or k.tag == "p", out or k.tag == "a" or k.noise and not (k.placed or k.named))
        own[id(node)] = sum(len(SPACE.sub("", k)) for k in node.kids if isinstance(k, str)) if paragraph and not out else 0
    for node in reversed(order):
        own[id(node)] += sum(own[id(k)] for k in node.kids if isinstance(k, Node))
    return own


def _keep_wrappers(root: Node) -> None:
    """Containers with a name that counts against them, but which hold the article, are read like others."""
    order = [root, *_below(root)]
    if not any(k.tag in ("article", "main") for k in order):
        held = _paragraphs(order)
        for node in order:
            if (node.placed or node.named and not node.sure) and 2 * held[id(node)] > held[id(root)]:
                node.noise = node.placed = node.named = False
    holds: set[int] = set()
    for node in reversed(order):  # what is below comes later in order
        if any(isinstance(k, Node) and (k.tag in ("article", "main", "h1") and not k.noise or id(k) in holds and (k.placed or not k.noise)) for k in node.kids):
            holds.add(id(node))
    for node in order:
        if node.placed and id(node) in holds:
            node.noise = False
    if not any(k.tag in ("p", "article", "main") and _has_text(k) for k in _below(root, within=False)):
        for node in order:
            if node.placed:
                node.noise = False


def _has_text(node: Node) -> bool:
    return any(isinstance(k, str) and k.strip() for x in (node, *_below(node, within=False)) for k in x.kids)


def _measure(root: Node) -> None:
    """Characters, tags, link characters and link tags of every node, without noise; then densities."""
    order, todo = [], [(root, False)]
    while todo:
        node, link = todo.pop()
        order.append((node, link or node.tag == "a"))
        todo += [(k, link or node.tag == "a") for k in node.kids if isinstance(k, Node) and not k.noise]
    for node, link in reversed(order):
        for k in node.kids:
            if isinstance(k, str):
                n = len(SPACE.sub("", k))
                node.chars += n
                node.link_chars += n * link
            elif not k.noise:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
    body = next((n for n, _ in order if n.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node, _ in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if c:
            base = math.log(c * max(lc, 1) / max(c - lc, 1) + share * c + math.e)
            node.density = c / t * max(math.log(c / max(lc, 1) * t / lt) / math.log(base), 0.0)
    for node, _ in reversed(order):  # inline elements are seen through
        node.sum = sum(k.density if k.tag in BLOCKS else k.sum for k in node.kids if isinstance(k, Node) and not k.noise and k.chars)


def _branches(node: Node) -> list[Node]:
    """The nearest block nodes below a node; inline elements are seen through."""
    out, todo = [], list(node.kids)
    while todo:
        k = todo.pop()
        if isinstance(k, Node) and not k.noise and k.chars:
            if k.tag in BLOCKS:
                out.append(k)
            else:
                todo += k.kids
    return out


def _main(root: Node) -> Node:
    """The subtree that is the article."""
    above: dict[int, Node] = {}
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        for k in _branches(node):
            above[id(k)] = node
            todo.append(k)
    best = max(nodes, key=lambda n: (n.sum, n.density))
    path = [best]
    while path[-1] is not root and path[-1].tag not in ("body", "article", "main"):
        path.append(above[id(path[-1])])
    threshold = min(n.density for n in path)
    chosen = best
    for below, node in zip(path, path[1:], strict=False):
        others = [k for k in _branches(node) if k is not below]
        if any(k.density >= threshold or k.tag in HEADLINES or not k.link_chars for k in others):
            chosen = node
            for k in others:
                k.noise = 2 * k.link_chars > k.chars and k.density < threshold
    for k in _branches(chosen):
        k.noise |= k.tag not in TEXTUAL and k.chars <= MOST_NOTICE and 2 * k.chars < chosen.chars and bool(NOTICE.search(_text(k)))
    return chosen


def _text(top: Node) -> str:
    """Text of a subtree in page order: blocks apart, white space inside them single."""
    out: list[str] = []
    todo: list[Node | str] = [top]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.noise and node is not top:
            out.append(" " if node.tag in BLOCKS or node.tag in SKIPPED else "")
        else:
            edge = " " if node.tag in BLOCKS else ""
            todo += [edge, *reversed(node.kids), edge]
    return SPACE.sub(" ", "".join(out)).strip()


def main_text(html: str | None) -> str:
    """The article of a page; empty for null, for no markup with text, or if all is noise."""
    if not html:
        return ""
    cut = html.rfind("<!--")
    if cut >= 0 and html.find("-->", cut) < 0:  # a comment without end goes on to the end
        html = html[:cut]
    open_title = list(TITLE.finditer(html))
    if open_title and html.lower().find("</title", open_title[-1].end()) < 0:  # a title without end is no title
        html = html[: open_title[-1].start()] + html[open_title[-1].end() :]
    tree = Tree()
    tree.feed(html)
    tree.close()
    _keep_wrappers(tree.root)
    _measure(tree.root)
    return _text(_main(tree.root)) if tree.root.chars else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages, repeated rows and null ids included.

    n_chars counts code points. Extra columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
