"""Main text of web pages by composite text density.

Every node of the page's tree gets the characters of its text and of its link text, its tags and
link tags. Its density is characters per tag, lowered where much of the text is link text. The
density sum of a node adds up its children's densities. The path from the body to the node with
the largest density sum gives the threshold, the lowest density on it; descending from the body
along nodes above the threshold, the subtree with the largest density sum is the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estuarine.llm.common import slices, strings

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S | re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are never part of an article.
DROPPED = frozenset("aside button datalist dialog footer head header input label menu nav object option search select title audio canvas video".split())
#: Words in class, id or role of a container that mark page furniture or readers' comments.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|disclaimer|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notices?|pagination|pager|popup|promo|promoted|promotion|recommended|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsored|sponsor|subscribe|subscription|tags|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Where a loose match would hit text, a whole class name has to consist of such words and of what they are made into.
PARTS = re.compile(r"[\s_-]+")
MADE = frozenset("area bar block body box button buttons container content form icons inner item items links list post posts section title wrap wrapper".split())
COMMENTS = re.compile(r"comments?|commentlist|disqus|replies|respond", re.I)
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
ROLE = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar".split())
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: These end an open paragraph, list item, cell and so on, as browsers do.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "up", "children", "dropped", "chars", "links", "tags", "link_tags", "density", "sum", "doubt")

    def __init__(self, tag: str, up: Node | None, dropped: bool = False):
        self.tag, self.up, self.dropped = tag, up, dropped
        self.doubt = False
        self.children: list = []  # nodes and texts in page order
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0


def whole(name: str) -> bool:
    """Whether a class name says nothing but page furniture."""
    parts = PARTS.split(name.lower())
    return any(map(FURNITURE.fullmatch, parts)) and all(x in MADE or FURNITURE.fullmatch(x) for x in parts)


def furniture(tag: str, attributes: str, within: bool) -> bool | None:
    """Whether a container is page furniture; `within`: it lies inside an article or main.

    None: it is, unless it is dense in text. Inside an article, and for headings, paragraphs and
    sections, only whole class names and roles count; an id alone never drops dense text.
    """
    doubt: bool | None = False
    if tag in DROPPED and not (within and tag == "header"):
        return True
    if tag == "form":  # its controls go all the same; `settle` tells a form from a page in one
        doubt = None
    if tag in ("html", "body", "article", "main") or not attributes or "=" not in attributes:
        return bool(re.search(r"\shidden\b", attributes or "")) or doubt
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        names = [x for x in value.split() if not x.lower().startswith(("no-", "has-", "with-", "without-"))]
        strict = within or tag in TEXTUAL
        if name == "class" and any(map(whole if strict else FURNITURE.search, names)) or name == "role" and value.lower() in ROLE:
            if not strict or name == "class" and any(whole(x) and COMMENTS.search(x) for x in names):
                return True
            doubt = None
        if name == "id" and tag not in TEXTUAL and any(map(FURNITURE.search, names)):
            doubt = None
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return bool(re.search(r"\shidden(?:\s|$)", re.sub(r"""("[^"]*"|'[^']*')""", "", attributes))) or doubt


def settle(root: Node) -> None:
    """Drop the doubtful containers with few characters a tag or many in links, inner ones first.

    A form goes unless it holds over half of the page's text, as where a page stands in one form.
    """
    nodes = order(root)
    if not any(x.doubt for x in nodes):
        return
    sizes: dict[int, tuple[int, int, int]] = {}
    own = {id(node): sum(len("".join(x.split())) for x in node.children if isinstance(x, str)) for node in nodes}
    total = sum(own.values())
    for node in reversed(nodes):
        chars = own[id(node)]
        inner = [sizes[id(x)] for x in node.children if isinstance(x, Node) and not x.dropped]
        chars, links, tags = (n + sum(x[i] for x in inner) for i, n in enumerate((chars, 0, 1)))
        sizes[id(node)] = chars, chars if node.tag == "a" else links, tags
        node.dropped = node.doubt and (2 * chars <= total if node.tag == "form" else chars < 20 * tags or 3 * links > chars)


def parse(page: str) -> Node:
    """The page's tree with its open ends closed; an iterative walk, deep nesting is no problem."""
    root = at = Node("html", None)
    within = 0
    last = 0
    opened: Counter[str] = Counter()  # open elements by tag, so that an end without a start costs nothing

    def close(node: Node) -> None:
        nonlocal within, at
        while at is not node:
            within -= at.tag in ("article", "main")
            opened[at.tag] -= 1
            at = at.up
        within -= node.tag in ("article", "main")
        opened[node.tag] -= 1
        at = node.up or root

    def find(names, stop) -> Node | None:
        node = at if any(opened[x] for x in names) else None
        while node is not None and node is not root:
            if node.tag in names:
                return node
            if node.tag in stop:
                return None
            node = node.up
        return None

    for m in TOKEN.finditer(page):
        if m.start() > last:
            at.children.append(page[last : m.start()])
        last = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag == "html":
            continue
        if m[2]:
            if tag == "br":
                at.children.append(Node("br", at))
            elif tag == "p":
                if node := find({"p"}, {"td", "th", "table"}):
                    close(node)
            elif node := find({tag}, () if tag in ("body", "table", "article", "main", "div", "section") else {"table", "article", "main", "section", "body"}):
                close(node)
            continue
        if tag in BLOCK and tag != "br" and (node := find({"p"}, BLOCK - {"p"})):
            close(node)
        if tag in CLOSES and (node := find(CLOSES[tag], SCOPE[tag])):
            close(node)
        verdict = furniture(tag, m[4] or "", within > 0)
        node = Node(tag, at, verdict is True)
        node.doubt = verdict is None
        at.children.append(node)
        if tag not in VOID and not (m[4] or "").rstrip().endswith("/"):
            at = node
            opened[tag] += 1
            within += tag in ("article", "main")
    if last < len(page):
        at.children.append(page[last:])
    settle(root)
    return root


def order(root: Node) -> list[Node]:
    """All nodes outside page furniture, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            out.append(node)
            stack += [x for x in node.children if isinstance(x, Node)]
    return out


def measure(nodes: list[Node]) -> None:
    """Characters, tags and densities of every node, children before parents."""
    for node in reversed(nodes):
        for x in node.children:
            if isinstance(x, str):
                n = len("".join(x.split()))
                node.chars += n
            elif not x.dropped:
                node.chars += x.chars
                node.links += x.links
                node.tags += x.tags + 1
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.links = node.chars
    body = nodes[0]
    share = (body.links + 1) / (body.chars + 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.links, max(node.link_tags, 1)
        if c:
            base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
            node.density = c / t * math.log(max(c * t / (max(lc, 1) * lt), 1) + 1e-9, max(base, 1.0001)) if lc else c / t * math.log(c * t + 1, max(base, 1.0001))
            node.density = max(node.density, 0.0)
        node.sum = sum(x.density for x in node.children if isinstance(x, Node) and not x.dropped) + sum(len("".join(x.split())) for x in node.children if isinstance(x, str))


def main_node(root: Node) -> Node:
    nodes = order(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    nodes = order(body)
    measure(nodes)
    best = max(nodes, key=lambda n: n.sum)
    threshold, node = math.inf, best
    while node is not None and node is not body.up:
        if node.chars:
            threshold = min(threshold, node.density)
        node = node.up
    at = body
    while True:
        # a subtree that holds nearly all text above the threshold takes its parent's place
        inner = [x for x in at.children if isinstance(x, Node) and x.density >= threshold and x.chars]
        holder = max(inner, key=lambda x: (x.sum, x.chars), default=None)
        if holder is None or holder.sum < at.sum or holder.tag not in BLOCK or holder.tag in ("p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6"):
            break
        at = holder
    # an element that says it is the article and holds the densest node is not left
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            return node
        node = node.up
    return at


def text_of(node: Node) -> str:
    """Blocks in page order, white space inside a block as one space."""
    blocks, line, stack = [], [], [iter([node])]

    def flush():
        words = html.unescape("".join(line)).split()
        if words:
            blocks.append(" ".join(words))
        line.clear()

    closing: list[bool] = []
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if closing and closing.pop():
                flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.dropped:
            block = x.tag in BLOCK
            if block:
                flush()
            stack.append(iter(x.children))
            closing.append(block)
    flush()
    return " ".join(blocks)


def main_text(page: str) -> str:
    return text_of(main_node(parse(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of `pages`.

    A null or empty page, and a page without text, gives the empty text. Null ids and urls stay
    null, repeated rows give repeated results, other columns are ignored, an empty table gives no
    rows. Pages are independent: no shuffle, memory of one page's tree at a time.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__html"):
                texts = [main_text(x) for x in strings(part, "__html")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"))
    kinds = [f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema[:2]]
    return rows.mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars long")
