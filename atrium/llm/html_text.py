"""Main text of web pages by composite text density.

Each DOM node gets a density, its characters per tag, lowered where much of it is link text. A node's density sum
adds up its children's densities; the node with the largest sum holds the article, and the least density on its way
up to below the body is the threshold that other parts of the page must reach to be kept with it. What a page's author says
in class, id or role lowers densities where nodes compete. Within the article it takes away only what also is mostly links,
has fields to fill in or is a bare line; a holder of readers' comments goes by its name, however dense they are.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.llm.tables import table
from atrium.storage import ship

#: Elements without content, elements whose content is not markup, and elements that begin a block (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Never part of an article's text.
SKIP = frozenset(
    "nav footer aside form script style noscript template iframe svg canvas button select textarea dialog menu "
    "embed audio video head title input option".split()
)
#: What readers fill in.
CONTROLS = frozenset("form input button select textarea".split())
#: Names of what holds readers' comments: the first by themselves, ``comment`` with one of the others.
COMMENTS = frozenset("comments commentlist disqus".split())
COMMENT_PARTS = frozenset("list section area thread wrapper box form container".split())
#: Elements that such a name takes away.
HOLDERS = frozenset("div section ol ul aside footer details".split())
#: Words in class, id or role of what is seldom the article, and of those what may be part of its structure as well.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr "
    "popup modal newsletter subscribe signup login breadcrumb breadcrumbs pagination pager comments comment commentlist respond disqus".split()
)
WEAK = frozenset(
    "notice notification alert overlay sidebar side rail widget widgets nav navbar navigation menu header masthead topbar footer copyright replies reply "
    "discussion share sharing social related recommended recommendations search toolbar skip complementary contentinfo toc".split()
)
#: What a marked node's density counts where nodes compete.
MARKED_WEIGHT = 0.1
#: The share of what stands beside the best subtree that must be dense or a heading for its parent to be taken whole.
NEARLY = 0.9
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that scope what an end tag or a new block may close, and what is closed by the start of another (HTML syntax).
WALLS = frozenset("table td th caption body article section div ul ol dl blockquote main header footer aside nav form html".split())
ENDS = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tr": frozenset({"td", "th", "tr"}),
    "tbody": frozenset({"td", "th", "tr", "thead", "tbody"}), "tfoot": frozenset({"td", "th", "tr", "thead", "tbody"}),
}

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_BAD_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>?")
_MARKS = re.compile(r"""\b(class|id|role|aria-hidden|style|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_ENDED = re.compile(r"""(?:^|[\s"'])/$""")  # not the end of a value without quotes
_END = {t: re.compile(rf"</{t}\b", re.IGNORECASE) for t in RAW}


@dataclass
class Node:
    tag: str
    parent: Node | None
    content: list = field(default_factory=list)  # strings and nodes, in order
    skip: bool = False
    in_article: bool = False
    mark: int = 0  # 1: named like a part that may be the article's, 2: like one that is not
    weight: float = 1.0
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    controls: bool = False
    density: float = 0.0
    density_sum: float = 0.0

    @property
    def kids(self) -> list[Node]:
        return [c for c in self.content if isinstance(c, Node) and not c.skip]


def _parts(value: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()))


def _named(parts: set[str]) -> int:
    return 2 if parts & MARKED else int(bool(parts & WEAK))


def _holds_comments(parts: set[str]) -> bool:
    return bool(parts & COMMENTS) or ("comment" in parts and bool(parts & COMMENT_PARTS))


def _marks(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is hidden or holds readers' comments, and how it is marked."""
    hidden, mark = False, 0
    for m in _MARKS.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
        elif tag not in HEADINGS and tag not in ("html", "body", "article", "main"):
            parts = _parts(value)
            mark = max(mark, _named(parts))
            hidden |= tag in HOLDERS and _holds_comments(parts)
    return hidden, mark


class _Open:
    """The open elements, with counts by tag in each scope, so that no tag costs a walk that closes nothing.

    Blocks are looked for up to the next wall, what is inline up to the next block.
    """

    def __init__(self, root: Node):
        self.node = root
        self.total: dict[str, int] = {}
        self.scopes: list[tuple[str, dict[str, int]]] = [("", {})]
        self.inline: list[dict[str, int]] = [{}]

    def push(self, node: Node) -> None:
        self.node, tag = node, node.tag
        self.total[tag] = self.total.get(tag, 0) + 1
        if tag in WALLS:
            self.scopes.append((tag, {}))
        elif tag in BLOCK:
            self.scopes[-1][1][tag] = self.scopes[-1][1].get(tag, 0) + 1
        if tag in BLOCK:
            self.inline.append({})
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.node.tag
        self.total[tag] -= 1
        if tag in WALLS:
            self.scopes.pop()
        elif tag in BLOCK:
            self.scopes[-1][1][tag] -= 1
        if tag in BLOCK:
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1
        self.node = self.node.parent
        return tag

    def close(self, tag: str) -> None:
        """The end tag ``tag``; a stray one is nothing, but that of a paragraph parts what is around it."""
        if (self.total if tag in BLOCK else self.inline[-1]).get(tag, 0) > 0:
            while self.pop() != tag:
                pass
        elif tag == "p":
            self.node.content.append(Node("p", self.node, skip=self.node.skip))

    def begin(self, tag: str) -> None:
        """Close what the start of ``tag`` ends."""
        if tag in BLOCK and self.scopes[-1][1].get("p", 0) > 0:
            while self.pop() != "p":
                pass
        ends = ENDS.get(tag, frozenset())
        while ends:
            wall, counts = self.scopes[-1]
            if wall not in ends and not any(counts.get(t, 0) > 0 for t in ends):
                return
            while self.pop() not in ends:
                pass


def parse(source: str) -> Node:
    """A tree of elements and decoded text from HTML of any quality: unclosed and stray tags are put right simply.

    Time is linear in the page, and no depth is too deep.
    """
    root = Node("html", None)
    open_ = _Open(root)
    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            open_.node.content.append(html.unescape(source[at:lt]))
        if lt >= n:
            break
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(source, lt) or _BAD_TAG.match(source, lt)
        if not m:
            open_.node.content.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag in ("html", "body"):
            continue
        if m[1]:
            open_.close(tag)
            continue
        open_.begin(tag)
        up = open_.node
        hidden, mark = _marks(tag, m[3]) if m[3] else (False, 0)
        inside = up.in_article or tag in ("article", "main")
        child = Node(tag, up, skip=up.skip or hidden or tag in SKIP or (tag == "header" and not inside), in_article=inside, mark=mark)
        up.content.append(child)
        if tag in RAW:
            end = _END[tag].search(source, at)
            close = source.find(">", end.start()) if end else -1
            at = n if close < 0 else close + 1
        elif tag not in VOID and not _ENDED.search(m[3]):
            open_.push(child)
    return root


def measure(root: Node) -> list[Node]:
    """Densities of all kept nodes; returns them children first.

    Sums go over blocks: what is inline, like bold type, hands on the blocks inside it and is no part by itself.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.parent is not None:
            node.weight = MARKED_WEIGHT if node.mark else node.parent.weight
        order.append(node)
        stack += node.kids
    order.reverse()
    for node in order:
        kids = node.kids
        node.chars = sum(len("".join(c.split())) for c in node.content if isinstance(c, str)) + sum(k.chars for k in kids)
        node.tags = sum(k.tags + 1 for k in kids)
        node.link_chars = node.chars if node.tag == "a" else sum(k.link_chars for k in kids)
        node.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
        node.controls = any(k.controls for k in kids) or any(isinstance(c, Node) and c.tag in CONTROLS for c in node.content)
    ratio = root.link_chars / max(1, root.chars)
    for node in order:
        node.density = composite_density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
        node.density_sum = sum(k.density * k.weight if k.tag in BLOCK else k.density_sum for k in node.kids)
    return order


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters per tag times a logarithm that falls with the share of links, its base set by the body's share."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_ratio * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / links * tags / link_tags)) / base


def main_nodes(root: Node) -> list[Node]:
    """The kept nodes with the article's text, in page order.

    The subtree with the largest density sum is taken (of the body, if one child holds most of it, that one), and with it the least ancestor of which nearly all else is as
    dense as the threshold, the least density on the way up to below the body. Of the rest of the page come the parts that
    reach the threshold, and headings before them.
    """
    order = measure(root)
    if not root.chars:
        return []
    best = max((x for x in reversed(order) if x is root or x.tag in BLOCK), key=lambda x: x.density_sum)
    if best is root:  # a part that holds most of a page's text outside links is not just one of the parts
        plain = lambda x: (x.chars - x.link_chars) * x.weight
        half = sum(map(plain, root.kids)) / 2
        best = next((k for k in root.kids if plain(k) > half and k.density_sum > 0), root)
    threshold, node = best.density, best
    while node.parent is not None:
        threshold, node = min(threshold, node.density), node.parent
    dense = lambda x: x.density * x.weight >= threshold and 2 * x.link_chars <= x.chars
    top = best
    while top.parent is not None and top.parent is not root:
        up = top.parent
        beside = up.chars - top.chars
        near = sum(k.chars for k in up.kids if k is not top and (dense(k) or _heading(k)))
        if NEARLY * beside > near:
            break
        top = up
    for x in _below(top):
        links = 2 * x.link_chars > x.chars
        bare = x.mark == 2 and not any(k.tag in BLOCK for k in x.kids)  # a line of its own, without a paragraph
        if x.mark and x.density < best.density and (links or x.controls or bare):
            x.skip = True
        elif top is root and x.density * x.weight < threshold and (x.mark or (links and x.parent is root)):
            x.skip = True
    above, node = set(), top.parent
    while node is not None:
        above.add(id(node))
        node = node.parent
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node is top or id(node) not in above:
            found.append(node)
            continue
        part: list[Node] = []
        waiting: list[Node] = []  # headings that no kept part has followed yet
        for k in node.kids:
            if k is top or id(k) in above or dense(k):
                part += [*waiting, k]
                waiting = []
            elif (h := _heading(k)) and k.weight == 1.0:
                waiting = [*(w for w in waiting if _heading(w).tag < h.tag), k]
        stack += reversed(part)
    return found


def _heading(node: Node) -> Node | None:
    """The heading that a node is, or that is all there is in it; not one that is a link."""
    chars = node.chars
    while node.tag not in HEADINGS and len(kids := [k for k in node.kids if k.chars]) == 1 and kids[0].chars == chars:
        node = kids[0]
    return node if chars and node.tag in HEADINGS and not node.link_chars else None


def _below(node: Node) -> list[Node]:
    out, stack = [], list(node.kids)
    while stack:
        out.append(x := stack.pop())
        stack += x.kids
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order; white space inside one is one space."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(part).split()):
            out.append(text)
        part.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                part.append(x)
            elif x.skip:
                part.append(" ")
            elif x.tag == "br":
                part.append("\n")
            else:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack += reversed(x.content)
        flush()
    return out


def main_text(source: str | None) -> str:
    """The article's text of a page; empty where there is none."""
    if not source:
        return ""
    return "\n".join(blocks(main_nodes(parse(source))))


def extract(pages: DataFrame) -> DataFrame:
    """A row for each row of ``pages``: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text. Null ids and urls stay null, repeated rows stay, other columns are left
    behind. Pages are read whole, without a shuffle; nothing is kept from page to page.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [main_text(h) for h in frame["html"]]
            yield pd.DataFrame(
                {"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": found, "n_chars": [len(t) for t in found]}
            )

    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
