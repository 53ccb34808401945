"""Main text of web pages by scores on the tree of elements.

A page is read into its block elements. Each block of text earns points for its length
and its commas and passes them to the element around it, half of them to the next one,
and so on. An element's points are discounted by the share of its text that lies in
links. The element with most points is the article; siblings that hold text like it are
kept with it. Elements that by name or class are no part of an article never count.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")

RAW = {"script", "style", "title", "textarea", "xmp", "noscript", "template", "iframe"}
BLOCKS = set(
    "html body main article section div p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th "
    "h1 h2 h3 h4 h5 h6 figure figcaption nav header footer aside form fieldset details summary address center hr head "
    "button select dialog menu search svg".split()
)
OUTSIDE = set("nav footer aside form fieldset button select dialog menu search svg head".split())
#: Elements that end where another of them, or any block in the case of p, begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = {"ul", "ol", "table", "dl", "div", "section"}
NOISE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice "
    "notices alert popup modal overlay sidebar comment comments disqus reply replies menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead share sharing social related recommended newsletter subscribe signup login toolbar widget "
    "pagination pager tags skip disclaimer complementary contentinfo search".split()
)
GOOD = set("article content body main post story text entry page blog".split())

POINTS_FOR_NAME = 25.0
LEVELS = 4
SIBLING_SHARE = 0.2
LINK_LIMIT = 0.5
#: A form with paragraphs and this many times the text around it is the page itself.
FREE_SHARE = 20
PROSE = {"p", "article", "main", "section", "pre", "blockquote"}


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    outside: bool = False
    form: Node | None = None
    article: bool = False
    points: float = 0.0
    chars: int = 0
    linked: int = 0

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0

    def score(self) -> float:
        return self.points * (1 - self.density())


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[Node, str]] = field(default_factory=list)
    #: Text of the page that is in no form, and per form; forms with paragraphs.
    free: int = 0
    in_form: dict[int, int] = field(default_factory=dict)
    prose: set[int] = field(default_factory=set)


def _node(tag: str, attributes: str, parent: Node, page_form: bool = False) -> Node:
    names: set[str] = set()
    for _, *values in ATTRIBUTE.findall(attributes):
        names.update(NAME_PART.findall("".join(values).lower()))
    outside = tag in OUTSIDE and tag != "form" or bool(names & NOISE and tag not in ("html", "body", "article", "main"))
    outside = outside and not page_form or tag == "header" and not parent.article
    if tag in ("article", "main") and parent.tag in ("nav", "header", "form"):
        inherited, form = False, None  # an element before it was never closed
    else:
        inherited, form = parent.outside, parent.form
    node = Node(tag, parent, inherited or outside, form, parent.article or tag in ("article", "main"))
    if tag == "form" and not page_form and form is None:
        node.form = node
    if tag in ("article", "main") or names & GOOD:
        node.points += POINTS_FOR_NAME
    return node


def parse(source: str, page_form: int | None = None) -> Page:
    """Block elements and blocks of text, in order; broken markup is read as browsers do, roughly.

    The element with the number ``page_form`` is a form that holds the page and counts as
    any other element."""
    page, root = Page(), Node("", None)
    page.nodes.append(root)
    numbers: dict[int, int] = {}
    opened: Counter[str] = Counter()
    top, at, links, breaks = root, 0, 0, 0
    text: list[str] = []
    chars = linked = 0

    def flush() -> None:
        nonlocal chars, linked
        if text:
            block = " ".join("".join(text).split())
            if block and not top.outside and top.form is not None:
                number = numbers[id(top.form)]
                page.in_form[number] = page.in_form.get(number, 0) + len(block)
                if top.tag in PROSE:
                    page.prose.add(number)
            elif block and not top.outside:
                page.free += len(block)
                page.blocks.append((top, block))
                share = linked / chars if chars else 0
                earned = 1 + block.count(",") + min(len(block) / 100, 3)
                up, level = (top.parent if top.tag in ("p", "pre", "li", "td") and top.parent else top), 0
                while up and level < LEVELS:
                    up.points += earned / (1 if level == 0 else 2 * level)
                    up, level = up.parent, level + 1
                top.chars += len(block)
                top.linked += round(len(block) * share)
        text.clear()
        chars = linked = 0

    def add(piece: str) -> None:
        nonlocal chars, linked, breaks
        if not piece:
            return
        piece = entities.unescape(piece) if "&" in piece else piece
        text.append(piece)
        size = len(piece) - piece.count(" ")
        if size and not piece.isspace():
            breaks = 0
        chars += size
        linked += size if links else 0

    def leave() -> None:
        nonlocal top
        opened[top.tag] -= 1
        top = top.parent

    for m in TOKEN.finditer(source):
        if m.start() < at:
            continue
        add(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                text.append(" ")
        elif tag == "a":
            links = max(0, links + (-1 if m[1] else 1))
        elif tag in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
        elif tag in BLOCKS:
            flush()
            links = 0
            if m[1]:
                if opened[tag]:
                    while top.tag != tag:
                        leave()
                    leave()
                continue
            if top.tag == "p":
                leave()
            while top.tag in ENDS.get(tag, ()):
                leave()
            if tag == "hr":
                continue
            number = len(page.nodes)
            top = _node(tag, m[3], top, number == page_form)
            opened[tag] += 1
            if top.form is top:
                numbers[id(top)] = number
            page.nodes.append(top)
    add(source[at:])
    flush()
    # Parents come before their children, so counts go up in one pass from the end.
    for node in reversed(page.nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return page


def _shown(nodes: list[Node], kept: set[int]) -> set[int]:
    """Elements inside a kept one, but for lists of links and what is in them."""
    shown: set[int] = set()
    for node in nodes:
        links = node.tag in LISTS and node.density() > LINK_LIMIT
        if id(node) in kept or (id(node.parent) in shown and not links):
            shown.add(id(node))
    return shown


def main_text(source: str) -> str:
    """The article of a page, one line for each block; empty if there is none."""
    page = parse(source)
    if page.prose:
        largest = max(sorted(page.prose), key=page.in_form.get)
        if FREE_SHARE * page.free <= page.in_form[largest]:
            page = parse(source, largest)
    holders = [n for n in page.nodes if not n.outside and n.chars]
    if not holders:
        return ""
    best = max(holders, key=Node.score)
    kept = {id(best)}
    if best.parent is not None:
        least = max(10.0, SIBLING_SHARE * best.score())
        for node in holders:
            if node.parent is best.parent and node is not best and node.density() < LINK_LIMIT:
                text_like = node.tag == "p" and node.chars > 80 and node.density() < 0.25
                if node.score() >= least or text_like:
                    kept.add(id(node))
    shown = _shown(page.nodes, kept)
    return "\n".join(t for n, t in page.blocks if id(n) in shown)


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of text).

    The whole html is read, whatever its length; null counts as empty and gives empty text,
    as does a page without text. Null ids and urls are kept, repeated rows give equal rows,
    an empty table gives none. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(s) for s in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text], ["page_id", "url", "text"])

    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"),
    )
    found = rows.mapInArrow(run, "page_id long, url string, text string")
    return found.select("*", F.char_length("text").cast("long").alias("n_chars"))
