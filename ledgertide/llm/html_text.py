"""HTML extraction by layout-aware rendering.

A small tree builder reads tags, applies the usual implied tags (a block ends an open paragraph, an item the item before it,
a row the cells and row before it; text, and any element that does not belong into a head, ends an open head; whatever stays
open ends with its parent) and drops what is never shown: scripts, styles, heads, templates, comments, and elements with
``hidden``, ``aria-hidden=true`` or a style of ``display:none`` or ``visibility:hidden``. The tree is rendered as plain text:
blocks on lines of their own with a blank line around paragraphs, headings, lists and tables; list items with bullets or
numbers and indented by depth; table cells padded so that the columns of a table align; preformatted text kept as it is. Formulas (MathML without its annotations) and the texts of drawings
(SVG without title, desc, defs, metadata and other parts that are not drawn where they stand) are inline text.

Null and empty pages give an empty text. Unclosed and stray tags never fail; nesting deeper than ``DEEPEST`` is flattened. Rendering keeps
its own stack, so that no depth of lists and tables meets Python's limit of recursion.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm import common

DEEPEST = 400

# The element classes of the HTML standard that decide about spacing and implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title noscript template iframe noembed noframes object audio video canvas datalist meta link base".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp blockquote figure fieldset hr".split())
BLOCK = SPACED | frozenset("address article aside body details dd dialog div dt footer figcaption form header html li legend main menu nav option section summary tr caption thead tbody tfoot td th".split())
CLOSES_P = SPACED | frozenset("address article aside details div dialog figcaption footer form header main menu nav section li dd dt".split())
#: An opening tag ends these open elements, searched up to the named borders.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*+(?>\"[^\"]*\"|'[^']*')|[\"'=])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?+")
#: Only elements with one of these words among their attributes can be hidden.
MAY_HIDE = re.compile(r"hidden|style", re.I)
#: What may hold a semicolon or colon inside a style declaration.
STYLE_PARTS = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*\"|'[^']*'|\([^()]*\)", re.S)
START = re.compile(r"\bstart\s*=\s*[\"']?(-?\d{1,9})", re.I)
SPAN = re.compile(r"\bcolspan\s*=\s*[\"']?(\d{1,3})", re.I)
#: Drawings and formulas: what brings back to HTML inside them, which HTML elements end them, what of them is not shown in its place,
#: and whose parts in a formula stand apart.
INTEGRATION = frozenset("foreignobject desc mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
UNDRAWN = frozenset("desc defs metadata symbol clippath mask marker pattern annotation annotation-xml mphantom".split())
APART = frozenset("mfrac mtable mtr mlabeledtr mtd".split())
#: Whatever else begins, or any text, ends an open head.
IN_HEAD = frozenset("title meta link base style script noscript noframes template".split())
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "parts", "gone")

    def __init__(self, name: str, attributes: str = "", gone: bool = False):
        self.name, self.attributes, self.parts, self.gone = name, attributes, [], gone


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts, one without a value is empty."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else value))
    return found


def hidden(node: Node) -> bool:
    """Whether the element's kind or own attributes take it out of the layout; a display style wins over ``hidden``."""
    if node.gone or not MAY_HIDE.search(node.attributes):
        return node.gone
    found = attributes_of(node.attributes)
    style: dict[str, tuple[bool, str]] = {}
    for declaration in STYLE_PARTS.sub(" ", found.get("style", "")).split(";"):
        name, _, value = (x.strip().lower() for x in declaration.partition(":"))
        firm = value.endswith("!important")
        value = value.removesuffix("!important").strip()
        if value and (firm or not style.get(name, (False,))[0]):
            style[name] = firm, value
    display, visibility = style.get("display", (False, ""))[1], style.get("visibility", (False, ""))[1]
    return (display == "none" or "hidden" in found and not display or visibility in ("hidden", "collapse")
            or found.get("aria-hidden", "").strip().lower() == "true")


def tree(source: str) -> Node:
    root = Node("#root")
    stack = [root]
    position, length = 0, len(source)
    drawn = False  # whether any svg or math came

    def close(names: set, borders: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                if not names - {"p"}:
                    return
                return close(names, borders)
            if stack[i].name in borders:
                return

    def foreign() -> int:
        """Place of the open drawing or formula whose own elements the next tag is among; 0 for none."""
        if drawn:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ("svg", "math"):
                    return i
                if stack[i].name in INTEGRATION or stack[i].name == "annotation-xml" and "html" in stack[i].attributes.lower():
                    return 0
        return 0

    def write(text: str) -> None:
        if stack[-1].name == "head" and text.strip():
            del stack[-1]
        stack[-1].parts.append(html.unescape(text))

    while position < length:
        found = TAG.search(source, position)
        if not found:
            write(source[position:])
            break
        if found.start() > position:
            write(source[position:found.start()])
        position = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            if name in ("html", "head"):  # one more of them opens nothing
                continue
            del stack[-1]
        if name in BREAKOUT and (i := foreign()):
            del stack[i:]
        if name in CLOSES_P:
            close({"p"}, {"td", "th", "table", "button", "li", "div", "section", "article", "blockquote", "body"})
        if name in ("tr", "td", "th"):  # a row without table parts around it still makes one
            if name != "tr" and not any(n.name == "tr" for n in stack[_last(stack, "table"):]):
                close({"td", "th", "caption"}, {"table"})
                _push(stack, Node("tr"))
        if name in IMPLIED:
            close(*IMPLIED[name])
        node = Node(name, found[3], name in UNDRAWN and foreign() > 0)
        stack[-1].parts.append(node)
        drawn |= name in ("svg", "math")
        if found[3].endswith("/") and (name in ("svg", "math") or foreign()):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, position)
            if name == "textarea":
                node.parts.append(html.unescape(source[position:end.start() if end else length]))
            elif name == "xmp":
                node.parts.append(source[position:end.start() if end else length])
            position = end.end() if end else length
        elif name not in VOID and len(stack) < DEEPEST + (name in ("text", "foreignobject")):  # without them a drawing shows nothing
            stack.append(node)
    return root


def _last(stack: list[Node], name: str) -> int:
    return max((i for i, n in enumerate(stack) if n.name == name), default=0)


def _push(stack: list[Node], node: Node) -> None:
    stack[-1].parts.append(node)
    stack.append(node)


class Page:
    """Collects lines; ``blank`` tells that an empty line is owed before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.space = False

    def text(self, value: str) -> None:
        shown = BLANKS.sub(" ", value)
        if shown == " " or not shown:
            self.space |= bool(shown) and bool(self.line)
            return
        if self.line and (self.space or shown[0] == " "):
            self.line.append(" ")
        self.line.append(shown.strip(" "))
        self.space = shown[-1] == " "

    def end(self, blank: bool = False) -> None:
        if self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append("".join(self.line))
            self.line, self.blank = [], False
        self.space = False
        self.blank |= blank

    def whole(self, lines: list[str], blank: bool) -> None:
        self.end(blank)
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines += lines
            self.blank = False
        self.blank |= blank


def result_of(first: Generator):
    """The result of steps that hand over to their inner steps by ``yield`` instead of calling them."""
    steps, value = [first], None
    while steps:
        try:
            inner = steps[-1].send(value)
        except StopIteration as end:
            steps.pop()
            value = end.value
        else:
            steps.append(inner)
            value = None
    return value


def render(node: Node, page: Page, depth: int = 0) -> Generator:
    for part in node.parts:
        if isinstance(part, str):
            page.text(part)
            continue
        name = part.name
        if name in UNSEEN or hidden(part):
            continue
        if name == "br":
            if page.line:
                page.end()
        elif name == "hr":
            page.end(True)
        elif name in ("pre", "xmp"):
            raw = "".join(_plain(part)).strip("\n").split("\n")
            page.whole([x.rstrip() for x in raw] if any(x.strip() for x in raw) else [], True)
        elif name in ("ul", "ol", "menu"):
            page.whole((yield items(part, depth)), depth == 0)
        elif name == "table":
            page.whole((yield cells(part)), True)
        elif name in BLOCK:
            page.end(name in SPACED)
            yield render(part, page, depth)
            page.end(name in SPACED)
        elif name == "svg":
            for label in labels(part):
                page.text(" ")
                yield render(label, page, depth)
                page.text(" ")
        elif name in APART or node.name == "mfrac":
            page.text(" ")
            yield render(part, page, depth)
            page.text(" ")
        else:
            yield render(part, page, depth)


def labels(drawing: Node) -> Iterator[Node]:
    """The texts of a drawing that are drawn; characters outside them are not."""
    left = list(reversed(drawing.parts))
    while left:
        part = left.pop()
        if isinstance(part, str) or part.name in UNSEEN or hidden(part):
            continue
        if part.name in ("text", "foreignobject"):
            yield part
        else:
            left.extend(reversed(part.parts))


def _plain(node: Node) -> Iterator[str]:
    left = list(reversed(node.parts))
    while left:
        part = left.pop()
        if isinstance(part, str):
            yield part
        elif part.name == "br":
            yield "\n"
        elif part.name not in UNSEEN and not hidden(part):
            inner = part.parts
            if part.name == "svg":
                inner = [x for label in labels(part) for x in (" ", label)][1:]
            left.extend(reversed(inner))


def lines_of(node: Node, depth: int = 0) -> Generator:
    page = Page()
    yield render(node, page, depth)
    page.end()
    return page.lines


def items(node: Node, depth: int) -> Generator:
    start = START.search(node.attributes)
    number, out, loose = int(start[1]) if start else 1, [], Node("#loose")

    def rest() -> Generator:
        out.extend((yield lines_of(loose, depth + 1)))
        loose.parts = []

    for part in node.parts:
        if isinstance(part, str) or part.name != "li":
            loose.parts.append(part)
            continue
        yield rest()
        if hidden(part):
            continue
        mark = f"{number}. " if node.name == "ol" else "- "
        number += 1
        own = (yield lines_of(part, depth + 1)) or [""]
        out.append((mark + own[0]).rstrip())
        out.extend(" " * len(mark) + x if x else "" for x in own[1:])
    yield rest()
    return out


def cells(node: Node) -> Generator:
    """Rows of a table with aligned columns; a caption and stray text come before it."""
    rows: list[list[tuple[list[str], int]]] = []
    loose = Node("#loose")

    def gather(parent: Node) -> Generator:
        for part in parent.parts:
            if isinstance(part, str):
                loose.parts.append(part)
            elif part.name in UNSEEN or hidden(part):
                continue
            elif part.name == "tr":
                row = []
                for cell in part.parts:
                    if not isinstance(cell, str) and cell.name in ("td", "th"):
                        if hidden(cell):
                            continue
                        span = SPAN.search(cell.attributes)
                        row.append(((yield lines_of(cell)), max(1, int(span[1])) if span else 1))
                    else:
                        loose.parts.append(cell)
                rows.append(row)
            elif part.name in ("thead", "tbody", "tfoot", "colgroup"):
                yield gather(part)
            else:
                loose.parts.append(part)

    yield gather(node)
    widths: dict[int, int] = {}
    for row in rows:
        column = 0
        for lines, span in row:
            if span == 1:
                widths[column] = max(widths.get(column, 0), max(map(len, lines), default=0))
            column += span
    out = yield lines_of(loose)
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            column, line = 0, []
            for lines, span in row:
                width = sum(widths.get(c, 0) for c in range(column, column + span)) + 3 * (span - 1)
                line.append((lines[k] if k < len(lines) else "").ljust(width))
                column += span
            out.append(" | ".join(line).rstrip())
    return out


def visible_text(source: str | None) -> str:
    """All visible text of one page."""
    return "\n".join(result_of(lines_of(tree(source)))) if source else ""


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text, n_chars, n_lines."""
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "html"):
            texts = [visible_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return plain.mapInArrow(run, f"page_id {plain.schema['page_id'].dataType.simpleString()}, text string, n_chars long, n_lines long")
