"""Visible text of web pages, laid out as lines.

Tags become a tree: end tags that authors leave out are supplied, table cells get the
row they lack, stray end tags are passed over.  Walking the tree, invisible parts are left
out, blocks start on lines of their own, paragraphs and headings stand between blank lines,
list items get their marks and indents, preformatted text stays as it is, and the cells of a
table stand in columns.  Neither building nor walking recurs, so depth is no limit.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sourceloom.llm.common import with_columns_from

# Fixed values of HTML: which elements are what.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_DECODED = frozenset("title textarea".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas datalist param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl pre blockquote figure table hr fieldset listing xmp".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr caption thead tbody tfoot".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag ends these open elements, looking no further out than the barrier.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("td th caption table html template button".split())  # an open paragraph beyond these is not ended
HEAD_ONLY = frozenset("base link meta title script style template noscript head html".split())

WIDEST = 60  # columns wider than this are not padded, as their text is prose and every row would carry its width
MOST_SPAN = 1000  # HTML's own limit for colspan

# A quote opens a string only behind "="; <!--> and <!---> are whole comments.
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text) if text and not text.isspace() else ():
        value = a or b or c
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    stack = [root]
    at = open_p = 0

    def end(tags, barrier) -> None:
        nonlocal open_p
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                open_p -= sum(n.tag == "p" for n in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in barrier:
                return

    def text(content: str) -> None:
        if content:
            if stack[-1].tag == "head" and not content.isspace():
                stack.pop()
            stack[-1].children.append(html.unescape(content) if "&" in content else content)

    while True:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            return root
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not open_p:
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag in HEADINGS:
                end(HEADINGS, SCOPE)
            elif tag not in ("html", "body"):
                end({tag}, {"table"} if tag not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot") else ({"table"} - {tag}))
            continue
        if tag == "html":
            root.attributes = attributes_of(m[3]) | root.attributes
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.pop()
        if tag in CLOSES_P and open_p:
            end({"p"}, SCOPE)
        if tag in ENDS:
            end(*ENDS[tag])
            if tag in ("tr", "thead", "tbody", "tfoot"):
                end({"tr"} if tag != "tr" else set(), {"table"})
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, attributes_of(m[3]))
        stack[-1].children.append(node)
        if tag in RAW or tag in RAW_DECODED:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            content = page[at : close.start() if close else len(page)]
            node.children.append(html.unescape(content) if tag in RAW_DECODED else content)
            at = close.end() if close else len(page)
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path", "use")):
            stack.append(node)
            open_p += tag == "p"


class Writer:
    """Lines of a block of text: collapses white space and keeps the largest gap that is asked for."""

    def __init__(self):
        self.out: list[str] = []
        self.gap = 0  # newlines owed
        self.space = self.begun = False
        self.indent, self.mark = 0, ""

    def block(self, newlines: int) -> None:
        self.gap, self.space = max(self.gap, newlines), False

    def _start(self) -> None:
        if self.gap or not self.begun:
            if self.begun:
                self.out.append("\n" * self.gap)
            lead = " " * self.indent
            if self.mark:
                lead = lead[: max(0, self.indent - len(self.mark))] + self.mark
                self.mark = ""
            self.out.append(lead)
            self.gap, self.space, self.begun = 0, False, True

    def text(self, content: str) -> None:
        words = _SPACE.sub(" ", content)
        if words == " ":
            self.space = self.begun and not self.gap
            return
        if words[0] == " " and self.begun and not self.gap:
            self.space = True
        body = words.strip(" ")
        if self.gap or not self.begun:
            self._start()
        elif self.space:
            self.out.append(" ")
        self.out.append(body)
        self.space = words[-1] == " "

    def line_break(self) -> None:
        if self.begun:
            self.gap, self.space = self.gap + 1 if self.gap else 1, False

    def lines(self, lines: list[str]) -> None:
        """Ready lines, each behind the indent."""
        for line in lines:
            self._start()
            self.out.append(line)
            self.gap = 1

    def result(self) -> str:
        return "\n".join(x.rstrip(" ") for x in "".join(self.out).split("\n"))


class Table:
    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []  # (text, columns, rows) of each cell

    def lines(self, widest: int = WIDEST) -> list[str]:
        grid: list[list[list[str]]] = []
        below: dict[int, int] = {}  # column -> rows that a cell from above still takes
        for row in self.rows:
            cells: list[list[str]] = []

            def skip(cells=cells):
                while below.get(len(cells), 0) > 0:
                    below[len(cells)] -= 1
                    cells.append([""])

            for text, columns, rows in row:
                skip()
                for k in range(columns):
                    if rows > 1:
                        below[len(cells)] = rows - 1
                    cells.append(text.split("\n") if k == 0 else [""])
            skip()
            grid.append(cells)
        widths: dict[int, int] = {}
        for cells in grid:
            for c, lines in enumerate(cells):
                widths[c] = max(widths.get(c, 0), *map(len, lines))
        out = []
        for cells in grid:
            for k in range(max(map(len, cells), default=0)):
                parts = [(lines[k] if k < len(lines) else "").ljust(widths[c] if widths[c] <= widest else 0) for c, lines in enumerate(cells) if widths[c]]
                out.append("  ".join(parts).rstrip(" "))
        return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "").strip()
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 10 else 1


def _unseen(node: Node, parent: Node | None) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attributes:
        return True
    if node.tag == "dialog" and "open" not in node.attributes:
        return True
    if parent is not None and parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary":
        return True
    return bool(node.attributes) and bool(_HIDING.search(node.attributes.get("style", "")))


def render(page: str | None, widest: int = WIDEST) -> str:
    """The visible text of a page, as lines; columns of tables are aligned up to a width of `widest`."""
    if not page:
        return ""
    root = build(page)
    writers, tables, lists = [Writer()], [], []
    pre = 0
    # (node, place of its next child, whether its text is visible)
    walk: list[list] = [[root, 0, True]]
    while walk:
        top = walk[-1]
        node, k, seen = top
        if k < len(node.children):
            top[1] += 1
            child = node.children[k]
            if isinstance(child, str):
                if not seen or node.tag in ("table", "tr", "thead", "tbody", "tfoot") and child.isspace() or node.tag == "details" and "open" not in node.attributes:
                    continue
                if pre:
                    first, *more = child.replace("\r\n", "\n").split("\n")
                    for line in ([first] if first or not more else []) + more:
                        writers[-1].lines([line])
                else:
                    writers[-1].text(child)
                continue
            if _unseen(child, node):
                continue
            visible = _VISIBILITY.search(child.attributes.get("style", "")) if child.attributes else None
            walk.append([child, 0, seen if not visible else visible[1].lower() == "visible"])
            pre += _enter(child, writers, tables, lists)
        else:
            walk.pop()
            pre -= _leave(node, writers, tables, lists, widest)
    return writers[0].result()


def _enter(node: Node, writers: list, tables: list, lists: list) -> int:
    tag, w = node.tag, writers[-1]
    if tag == "br":
        w.line_break()
    elif tag == "table":
        w.block(2)
        tables.append(Table())
    elif tag == "tr" and tables:
        tables[-1].rows.append([])
    elif tag in ("td", "th") and tables:
        writers.append(Writer())
    elif tag in ("td", "th"):
        w.text(" ")  # a cell without a table still stands apart
    elif tag in ("ul", "ol", "menu"):
        w.block(1 if lists else 2)
        start = node.attributes.get("start", "1")
        lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
    elif tag == "li":
        w.block(1)
        kind = lists[-1] if lists else ["ul", 1]
        mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
        kind[1] += 1
        node.attributes = {"_width": str(len(mark))}
        w.indent, w.mark = w.indent + len(mark), mark
    elif tag in ("dd", "blockquote"):
        w.block(2 if tag in SPACED else 1)
        w.indent += 2
    elif tag in BLOCK:
        w.block(2 if tag in SPACED else 1)
    return tag in ("pre", "textarea", "listing", "xmp")


def _leave(node: Node, writers: list, tables: list, lists: list, widest: int) -> int:
    tag, w = node.tag, writers[-1]
    if tag == "table" and tables:
        lines = tables.pop().lines(widest)
        w.block(2)
        w.lines(lines)
        w.block(2)
    elif tag in ("td", "th") and tables:
        text = writers.pop().result()
        if not tables[-1].rows:
            tables[-1].rows.append([])
        tables[-1].rows[-1].append((text, _span(node, "colspan", MOST_SPAN), _span(node, "rowspan", 65534)))
    elif tag in ("ul", "ol", "menu"):
        lists.pop()
        w.block(1 if lists else 2)
    elif tag == "li":
        w.indent -= int(node.attributes["_width"])
        w.mark = ""
        w.block(1)
    elif tag in ("dd", "blockquote"):
        w.indent -= 2
        w.block(2 if tag in SPACED else 1)
    elif tag in BLOCK and tag != "tr":
        w.block(2 if tag in SPACED else 1)
    return tag in ("pre", "textarea", "listing", "xmp")


def extract(pages: DataFrame, column: str = "html", name: str = "text", widest: int = WIDEST) -> DataFrame:
    """`pages` with the visible text of `column`.

    Null and empty pages have the empty text; text without any tag is one block.  Every
    page is rendered whole and by itself; columns of tables wider than `widest` are not aligned.  A column `name` of `pages` is replaced.
    """
    return with_columns_from(pages, column, [T.StructField(name, T.StringType())], lambda: lambda pages: [[render(p, widest) for p in pages]])
