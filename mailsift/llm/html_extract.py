"""Main text of web pages by tree scoring.

A page becomes a light tree. Subtrees that are no content by their element or role are cut, and those
that are none by their class unless the page has no other paragraph. Each paragraph earns points for its length and commas and passes them to its ancestors, in full to
the parent, half to the one above and less beyond; a container's points are discounted by the share
of its text that is links. The best container is kept, widened to the article it stands in, with
those siblings that score well too or are headings and paragraphs, and its blocks are written in
page order. Of containers with equal points the first in the page is the best.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements of HTML by their part on a page.
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form button input select option textarea label "
    "fieldset iframe frame object embed applet svg canvas audio video map dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 div section article main body".split())
CLOSED_BY = {  # an open element of the key ends when one of the values begins
    "p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}, "head": {"body"},
}
STOPS = frozenset("table ul ol dl div article section main body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOT_CONTENT = frozenset(
    "ad ads adv advert advertisement adsense advertorial banner breadcrumb breadcrumbs byline-share comment comments "
    "commentlist consent cookie cookies copyright dialog discussion disqus dropdown footer footnav gdpr header hidden "
    "legal login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo "
    "promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe tags toolbar topbar widget widgets".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
# Class names that say what a page has beside the element, not what the element is.
_BESIDE = re.compile(r"(?:has|have|no|not|with|without|is|show|hide|hidden|enable|disable|js)[-_]", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_ENDS = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPARED = 10  # times the text of the rest of a page from which a suspect is its content


class Node:
    __slots__ = ("tag", "parent", "items", "points", "size", "links", "n_links", "inside", "suspect")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.items = tag, parent, []
        self.points, self.size, self.links, self.n_links = 0.0, 0, 0, 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.suspect = False


KEPT, SUSPECT, CUT = range(3)


def _judged(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element is content by its tag, role and style, and by its class or id."""
    if tag in DROPPED and tag != "form" or tag == "header" and not inside:
        return CUT
    found = SUSPECT if tag == "form" else KEPT
    if not attributes or tag in ("html", "body", "article", "main"):
        return found
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLES - {"form"} or name == "hidden":
            return CUT
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return CUT
        if name in ("class", "id"):
            own = " ".join(x for x in value.split() if not _BESIDE.match(x))
            if not NOT_CONTENT.isdisjoint(_PARTS.split(_HUMP.sub(" ", own).lower())):
                found = SUSPECT
    return found


def parse(page: str) -> Node:
    """The content tree of a page; what is certainly no content is left out while reading."""
    root = node = Node("#root", None)
    at, n, depth_out, open_tags = 0, len(page), 0, []
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not depth_out:
            node.items.append(page[at:lt])
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)
        if not m:
            if not depth_out:
                node.items.append("<")
            at = lt + 1
            continue
        at, tag, closing = m.end(), m[2].lower(), bool(m[1])
        if depth_out:
            # Inside a cut subtree only its own element counts.
            if tag == open_tags[-1]:
                depth_out += -1 if closing else 0 if tag in VOID else 1
                if not depth_out:
                    open_tags.pop()
            elif not closing and tag in RAW:
                end = _RAW_ENDS[tag].search(page, at)
                at = end.start() if end else n
            elif closing and tag in ("body", "html"):
                depth_out = 0
                open_tags.pop()
            continue
        if closing:
            up = node
            while up is not root and up.tag != tag:
                if up.tag in STOPS and tag not in STOPS and tag not in BLOCKS:
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in BLOCKS or tag in CLOSED_BY:
            up = node
            while up is not root and up.tag not in STOPS or up.tag in CLOSED_BY:
                if tag in CLOSED_BY.get(up.tag, ()):
                    node = up.parent
                    break
                if up is root:
                    break
                up = up.parent
        if tag == "br":
            node.items.append(" ")
        judged = _judged(tag, m[3], node.inside or node.tag in ("article", "main"))
        if judged == CUT:
            if tag in RAW:
                end = _RAW_ENDS[tag].search(page, at)
                end = page.find(">", end.start()) if end else -1
                at = n if end < 0 else end + 1
            elif tag not in VOID and not m[3].endswith("/"):
                depth_out = 1
                open_tags.append(tag)
            if tag in BLOCKS:
                node.items.append(Node(tag, node))  # what stands around it is not one block
            continue
        if tag in VOID:
            if tag == "hr":
                node.items.append(Node(tag, node))
            continue
        child = Node(tag, node)
        child.suspect = judged == SUSPECT
        node.items.append(child)
        node = child
    return root


def _walk(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.items) if not isinstance(x, str))
    return order


def prune(root: Node) -> None:
    """Empty the suspects, but for the one with most text where next to nothing else on the page is text.

    A suspect around the main element is none, and beside an article or main element with any text
    none is spared.
    """
    order = _walk(root)
    text: dict[Node, int] = {}  # characters that are not in links, in each subtree
    holds_main: set[Node] = set()
    for node in reversed(order):
        inside = [x for x in node.items if not isinstance(x, str)]
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        text[node] = 0 if node.tag == "a" else own + sum(text[x] for x in inside)
        if node.tag == "main" or any(x in holds_main for x in inside):
            holds_main.add(node)
    scope: Node | None = root
    while scope is not None:
        suspects, named, stack = [], False, [x for x in scope.items if not isinstance(x, str)]
        while stack:  # the outermost ones
            node = stack.pop()
            if node.suspect and node not in holds_main:
                suspects.append(node)
            else:
                named = named or node.tag in ("article", "main") and text[node] > 0
                stack.extend(x for x in node.items if not isinstance(x, str))
        rest = text[scope] - sum(text[x] for x in suspects)
        spared = max(suspects, key=lambda x: text[x], default=None)
        scope = spared if spared and not named and text[spared] > SPARED * rest else None
        for node in suspects:
            if node is not scope:
                node.items = []


def score(root: Node) -> list[Node]:
    """Sets sizes and points of all nodes; returns them parents first."""
    order = _walk(root)
    for node in reversed(order):
        own = [x for x in node.items if isinstance(x, str)]
        text = sum(len(x.strip()) for x in own)
        children = [x for x in node.items if not isinstance(x, str)]
        node.size = text + sum(c.size for c in children)
        node.links = node.size if node.tag == "a" else sum(c.links for c in children)
        node.n_links = (node.tag == "a") + sum(c.n_links for c in children)
        if node.tag in PARAGRAPHS:
            inline = text + sum(c.size for c in children if c.tag not in BLOCKS)
            if inline:
                commas = sum(x.count(",") for x in own)
                gain = (1.0 if inline >= 25 else 0.1) + commas + min(inline / 100, 3.0)
                gain *= 1 - node.links / max(node.size, 1)
                if node.tag not in ("p", "li", "dd", "td", "h1", "h2", "h3", "h4", "h5", "h6"):
                    node.points += gain
                up, level = node.parent, 0
                while up is not None and up.parent is not None and level < 5:
                    up.points += gain / (1, 2, 6, 9, 12)[level]
                    up, level = up.parent, level + 1
    for node in order:
        node.points *= 1 - node.links / max(node.size, 1)
    return order


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks of ``nodes`` in page order; white space is one space, empty blocks go."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    for top in nodes:
        end()
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                held.append(x)
            else:
                if x.tag in ("ul", "ol", "dl", "table") and not x.inside and x.n_links >= 3 and x.links >= 0.9 * x.size:
                    end()
                    continue
                if x.tag in BLOCKS:
                    end()
                    stack.append(None)
                stack.extend(reversed(x.items))
        end()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; of null or empty pages and pages without text, the empty text."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    order = score(root)
    containers = [x for x in order if x.parent is not None and x.points > 0 and x.tag not in ("p", "li", "td", "dd")]
    if not containers:
        return "\n".join(blocks([root]))
    best = max(containers, key=lambda x: x.points)
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    least = max(10.0, 0.2 * best.points)
    kept, up = [], best
    while up.parent is not None and up.parent.parent is not None:  # titles that stand further out
        up = up.parent
        before = [x for x in up.parent.items[: up.parent.items.index(up)] if not isinstance(x, str)]
        kept = [x for x in before if x.tag == "h1"] + kept
    for x in best.parent.items:
        if isinstance(x, str):
            continue
        fits = x.points >= least and x.tag not in ("ul", "ol", "table")
        text = (x.tag in HEADINGS or x.tag in ("p", "blockquote", "pre")) and x.links < 0.5 * x.size
        if x is best or fits or text:
            kept.append(x)
    return "\n".join(blocks(kept))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            texts = [main_text(page.as_py()) for page in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id url text n_chars``, a row per row of ``pages`` (``page_id, url, html``); other columns are ignored."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
