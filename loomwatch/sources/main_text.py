"""The main text of a page: the subtree of its blocks that holds most prose for what else it holds.

A page is a tree of elements; what paragraphs, headings, list items, cells and bare text directly in other elements hold are its
blocks. A block of prose (some words, few of them in links) counts by its characters, others count against a subtree by
their links. Headings and short paragraphs count nothing, nor does what is in parts that are there for moving about (menus, comments,
advertisements, by element or by the words in their class and id). The element whose blocks have the greatest sum is the page's main part, the
innermost of equals, and its text are its blocks of prose, its headings and its short paragraphs, a line each. Sums go from the leaves up, so a page takes
time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements by what they do.
SILENT = frozenset(("script", "style", "noscript", "template", "svg", "head", "iframe", "select", "button"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ASIDE = frozenset(("nav", "header", "footer", "aside", "form"))
#: Elements that end where another of their kind begins, and what stops the search for one.
CLOSED_BY = {"p": (frozenset(("p",)), frozenset(("table", "td", "th", "li"))), "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "tr": (frozenset(("tr",)), frozenset(("table",))), "td": (frozenset(("td", "th")), frozenset(("table",)))}
BLOCKS = frozenset(("div", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre", "figure", "dl", "nav", "header", "footer", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6", "p", "hr"))
MOVING = re.compile(r"(?:^|[\s_-])(?:menu|nav|navbar|breadcrumbs?|sidebar|footer|comments?|share|social|related|promo|ads?|advert|cookie|banner|popup)(?:$|[\s_-])", re.IGNORECASE)
#: Words of a block of prose at least, and the share of its characters that links may have.
WORDS, LINKED = 6, 0.4
#: What a block that isn't prose counts against its part, beside its characters.
FIXED = 20


@dataclass
class Node:
    """An element: its parts in order, each an element or a block (text, characters in links)."""

    tag: str
    aside: bool = False
    parts: list[Node | tuple[str, int]] = field(default_factory=list)


class Tree(HTMLParser):
    """Reads a page's elements and blocks; whatever isn't closed ends with what it is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open, self.text, self.linked, self.silent, self.links = [self.root], [], 0, 0, 0

    def _block(self) -> None:
        """What came so far is a block of the innermost element."""
        text = " ".join("".join(self.text).split())
        if text:
            self.open[-1].parts.append((text, min(self.linked, len(text))))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "a":
            self.links += 1
        elif tag == "br":
            self.text.append(" ")
        elif tag not in INLINE and tag not in VOID:
            self._block()
            self.links = 0
            ends, stops = CLOSED_BY.get(tag, CLOSED_BY["p"] if tag in BLOCKS else (frozenset(), frozenset()))
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ends:
                    del self.open[k:]
                    break
                if self.open[k].tag in stops or self.open[k].tag in BLOCKS - {"p"}:
                    break
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            node = Node(tag, self.open[-1].aside or tag in ASIDE or bool(MOVING.search(named)))
            self.open[-1].parts.append(node)
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag not in INLINE and tag not in VOID:
            at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), None)
            if at:
                self._block()
                self.links = 0
                del self.open[at:]

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            self.linked += len(" ".join(data.split())) if self.links else 0

    def close(self) -> None:
        super().close()
        self._block()


def is_prose(text: str, linked: int) -> bool:
    return linked <= LINKED * len(text) and text.count(" ") + 1 >= WORDS


def is_short(node: Node, text: str, linked: int) -> bool:
    """A short paragraph, which stands in main parts and in others."""
    return node.tag == "p" and linked <= LINKED * len(text)


def worth(node: Node, text: str, linked: int) -> int:
    """What a block counts that is directly in the node."""
    if node.aside or node.tag in HEADINGS:
        return 0
    return len(text) if is_prose(text, linked) else 0 if is_short(node, text, linked) else -(linked + FIXED)


def tree_of(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def main_part(root: Node) -> tuple[Node | None, int]:
    """The element of the greatest sum and that sum, of equals the innermost, then the first; None if none is above zero."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    sums: dict[int, int] = {}
    within: dict[int, tuple[int, Node]] = {}  # of each element the best one in it, which may be itself
    for node in reversed(order):
        inner = [within[id(p)] for p in node.parts if isinstance(p, Node)]
        total = sum(sums[id(p)] if isinstance(p, Node) else worth(node, *p) for p in node.parts)
        top = max(inner, key=lambda x: x[0], default=None)  # the first of equals
        sums[id(node)], within[id(node)] = total, (total, node) if top is None or total > top[0] else top
    most, best = within[id(root)]
    return (best, most) if most > 0 else (None, 0)


def lines(node: Node) -> Iterator[str]:
    """What a part's text is made of, in order."""
    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        node, at = stack.pop()
        if at < len(node.parts):
            stack.append((node, at + 1))
            part = node.parts[at]
            if isinstance(part, Node):
                stack.append((part, 0))
            elif not node.aside and (node.tag in HEADINGS or is_prose(*part) or is_short(node, *part)):
                yield part[0]


def main_text(html: str | None) -> str | None:
    """The main text, or None where a page has none."""
    if not html:
        return None
    part, _ = main_part(tree_of(html))
    return "\n".join(lines(part)) if part is not None else None


def with_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "page_text") -> DataFrame:
    """pages with their main text, null where there is none, so that the summary stands in (``feeds.article_rows``)."""
    names = [c for c in pages.columns if c != text_col]
    kept = pages.select(*[F.col(f"`{c}`") for c in names])
    out = T.StructType([*kept.schema, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(html_col)
            texts = [main_text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in out])

    return kept.mapInArrow(run, out)
