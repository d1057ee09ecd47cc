"""Layout-aware text of web pages: a tree with implied tags, visibility rules, block layout.

All visible text is kept. Blocks stand on lines of their own with the spacing of their
kind, list items get a marker and an indent, preformatted text keeps its white space,
and the cells of a table are padded to columns.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

# Kinds of elements, as the HTML standard names them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template title meta link noscript iframe noembed noframes audio video canvas datalist".split()
)
# Parts of drawings and formulas that are not shown.
UNSHOWN = {"svg": frozenset("title desc metadata".split()), "math": frozenset("annotation annotation-xml".split())}
# Lines between a block and its neighbours.
SPACED = {tag: 2 for tag in "p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split()}
SPACED |= {
    tag: 1
    for tag in "html body div section article aside header footer nav main address li dt dd tr caption form fieldset "
    "figcaption details summary center legend option hgroup search dir menu optgroup thead tbody tfoot".split()
}
CLOSES_P = frozenset(SPACED) - {"li", "dt", "dd", "tr", "caption", "option", "optgroup", "thead", "tbody", "tfoot", "html", "body"}
# A start tag ends these open elements, up to one of the elements that hold them.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("td th tr caption colgroup", "table thead tbody tfoot"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "thead": ("td th tr thead tbody tfoot caption colgroup", "table"),
    "tbody": ("td th tr thead tbody tfoot caption colgroup", "table"),
    "tfoot": ("td th tr thead tbody tfoot caption colgroup", "table"),
    "body": ("head", "html"),
}
ENDS = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in ENDS.items()}
TABLE_PARTS = frozenset("tr td th thead tbody tfoot".split())
BARRIERS = frozenset("table td th caption html button object".split())
HEAD_ONLY = frozenset("base link meta title script style template noscript head html".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)",
    re.S,
)
# Attributes up to the end of a tag; with a quote left open the tag ends at the next bracket.
REST = re.compile(r"((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
# In drawings and formulas a slash ends an element at once; after a bare value it belongs to that.
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$|^[^=]*/\s*$")
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def parse(source: str) -> Node:
    """The tree of a page. Missing end tags and parents are implied, stray end tags ignored."""
    root = Node("html", {})
    stack = [root]
    counts: dict[str, int] = {"html": 1}  # open elements by tag: stray end tags cost nothing

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            counts[stack.pop().tag] -= 1

    def push(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        stack.append(node)
        counts[tag] = counts.get(tag, 0) + 1
        return node

    def close(tag: str, barriers=frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                return pop_to(k)
            if stack[k].tag in barriers:
                return None

    def imply_table(tag: str) -> None:
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push("tr", {})

    at, n = 0, len(source)
    while at < n:
        opened = source.find("<", at)
        if opened < 0:
            opened = n
        if opened > at:
            text(stack, source[at:opened], counts, close)
        if opened == n:
            break
        token = TOKEN.match(source, opened)
        if not token:
            text(stack, "<", counts, close)
            at = opened + 1
            continue
        at = token.end()
        if (data := token.group("data")) is not None:
            text(stack, html.escape(data, quote=False), counts, close)
        elif tag := token.group("end"):
            tag = tag.lower()
            if tag == "p" and not counts.get("p"):
                push("p", {})
                pop_to(len(stack) - 1)
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif counts.get(tag) and tag not in ("html", "body"):
                close(tag, frozenset() if tag in BARRIERS else frozenset({"table", "td", "th"}) - {tag})
        elif tag := token.group("start"):
            rest = REST.match(source, at)
            if not rest:
                text(stack, source[opened:], counts, close)
                break
            tag, raw, at = tag.lower(), rest.group(1) or rest.group(2) or "", rest.end()
            if tag in ("html", "body") and counts.get(tag):
                continue
            if counts.get("head") and tag not in HEAD_ONLY:
                close("head")
            if tag in ENDS:
                ended, holders = ENDS[tag]
                cut, k = len(stack), len(stack) - 1
                while k > 0 and stack[k].tag not in holders and (stack[k].tag in ended or stack[k].tag not in BARRIERS):
                    if stack[k].tag in ended or (tag in TABLE_PARTS and any(map(counts.get, holders))):
                        cut = k
                    k -= 1
                if k > 0 or cut < len(stack):
                    pop_to(max(1, cut))
            if tag in CLOSES_P and counts.get("p"):
                close("p", BARRIERS)
            imply_table(tag)
            attrs = _attributes(raw) if raw.strip(" \t\n\r\f/") else {}
            foreign = (counts.get("svg") or counts.get("math")) and not counts.get("foreignobject")
            if foreign and any(counts.get(kind) and tag in parts for kind, parts in UNSHOWN.items()):
                attrs["hidden"] = ""
            if tag in VOID or (foreign and SELF_CLOSED.search(raw)):
                stack[-1].children.append(Node(tag, attrs))
            elif tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)|\Z", re.I).search(source, at)
                node = Node(tag, attrs)
                body = source[at : stop.start()]
                if tag in ("textarea", "xmp"):
                    node.children.append(html.unescape(body) if tag == "textarea" else body)
                stack[-1].children.append(node)
                at = stop.end()
            else:
                push(tag, attrs)
    return root


def text(stack: list[Node], raw: str, counts: dict[str, int], close) -> None:
    """Add character data; text that no longer fits a head ends it."""
    if counts.get("head") and raw.strip() and stack[-1].tag == "head":
        close("head")
    stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)


def hidden(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return True
    style = node.attrs.get("style")
    return bool(style and INVISIBLE.search(style))


def width(line: str) -> int:
    """Columns a line takes: wide characters two, combining marks none."""
    if line.isascii():
        return len(line)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line
    )


class Layout:
    """Lines under construction: pending breaks, the indent and an open inline run."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = 0
        self.indent = 0
        self.marker = ""

    def break_line(self, lines: int) -> None:
        """End the line; at least ``lines - 1`` empty lines follow before more text."""
        joined = SPACES.sub(" ", "".join(self.run)).strip(" ")
        self.run = []
        if joined:
            self.put(joined)
        self.gap = max(self.gap, lines)

    def put(self, line: str) -> None:
        if self.lines and self.gap > 1:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        lead = " " * max(0, self.indent - len(self.marker)) + self.marker if self.marker else " " * self.indent
        self.lines.append((lead + line).rstrip(" "))
        self.marker = ""


def render(root: Node) -> list[str]:
    """Lines of all visible text below a node; works with its own stack, so depth is no limit."""
    out = Layout()
    # Enter and leave steps: (node, leaving, saved state).
    steps: list = [(root, False)]
    preformatted = 0
    lists: list[list] = []
    while steps:
        node, leaving = steps.pop()
        if isinstance(node, str):
            if preformatted:
                parts = node.replace("\r\n", "\n").split("\n")
                for k, part in enumerate(parts):
                    if k:
                        out.put("".join(out.run)) if out.run else out.put("")
                        out.run = []
                    if part:
                        out.run.append(part)
            else:
                out.run.append(node)
            continue
        tag = node.tag
        space = SPACED.get(tag, 0)
        if leaving:
            if tag in ("pre", "textarea", "xmp"):
                if out.run:
                    out.put("".join(out.run))
                    out.run = []
                preformatted -= 1
            if space:
                out.break_line(space)
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                out.gap = max(out.gap, 1 if lists else 2)
            if tag == "li":
                out.indent -= 2 if not lists or lists[-1][0] != "ol" else 3
                if out.marker:
                    out.put("")
            if tag in ("dd", "blockquote"):
                out.indent -= 2
            continue
        if hidden(node):
            continue
        if tag == "br":
            if out.run:
                out.break_line(1)
            else:
                out.gap = max(out.gap, 1) + 1 if out.lines else 0
            continue
        if tag == "wbr":
            continue
        if tag == "hr":
            out.break_line(2)
            continue
        if tag == "img":
            if node.attrs.get("alt"):
                out.run.append(f" {node.attrs['alt']} ")
            continue
        if tag == "input":
            if node.attrs.get("type", "text").lower() not in ("hidden", "password", "checkbox", "radio", "file"):
                out.run.append(f" {node.attrs.get('value') or node.attrs.get('placeholder') or ''} ")
            continue
        if tag == "table":
            out.break_line(2)
            for line in table_lines(node):
                if line:
                    out.put(line)
                else:
                    out.gap = max(out.gap, 2)
            out.break_line(2)
            continue
        if tag in ("td", "th", "text"):  # labels of a drawing stand apart
            out.run.append(" ")
        if space:
            out.break_line(1 if tag in ("ul", "ol", "menu", "dir") and lists else space)
        if tag in ("ul", "ol", "menu", "dir"):
            start = node.attrs.get("start", "1")
            lists.append(["ol" if tag == "ol" else "ul", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        if tag == "li":
            kind = lists[-1] if lists else ["ul", 1]
            out.marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
            out.indent += 3 if kind[0] == "ol" else 2
        if tag in ("dd", "blockquote"):
            out.indent += 2
        if tag in ("pre", "textarea", "xmp"):
            out.break_line(1)
            preformatted += 1
            if node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")
        steps.append((node, True))
        steps += [(child, False) for child in reversed(node.children)]
    out.break_line(0)
    return out.lines


def _rows(table: Node) -> Iterator[Node]:
    """Rows, captions and stray elements of a table, in order; inner tables stay closed."""
    pending = list(reversed(table.children))
    while pending:
        child = pending.pop()
        if isinstance(child, str):
            continue
        if child.tag in ("thead", "tbody", "tfoot", "colgroup") and not hidden(child):
            pending += reversed(child.children)
        elif not hidden(child):
            yield child


def _stray(table: Node) -> list[str]:
    """Text that stands directly in a table or its sections; browsers show it before the table."""
    found, pending = [], list(reversed(table.children))
    while pending:
        child = pending.pop()
        if isinstance(child, str):
            if child.strip():
                found.append(child)
        elif child.tag in ("thead", "tbody", "tfoot", "colgroup") and not hidden(child):
            pending += reversed(child.children)
    return found


def table_lines(table: Node) -> list[str]:
    """A table's lines, cells padded to the widest of their column; a cell may have many lines."""
    done: dict[int, list[str]] = {}
    # Inner tables first, so that nesting needs no recursion.
    order, walk = [], [table]
    while walk:
        node = walk.pop()
        if isinstance(node, Node):
            if node.tag == "table":
                order.append(node)
            walk += node.children
    for node in reversed(order):
        done[id(node)] = _one_table(node, done)
    return done[id(table)]


def _cell(node: Node, done: dict[int, list[str]]) -> list[str]:
    """Lines of a cell, with inner tables already laid out standing as preformatted text."""
    copy = Node("div", {})
    work = [(node, copy)]
    while work:
        old, new = work.pop()
        for child in old.children:
            if isinstance(child, str):
                new.children.append(child)
            elif child.tag == "table":
                made = Node("pre", child.attrs)
                made.children.append("\n".join(done[id(child)]))
                new.children.append(made)
            else:
                made = Node(child.tag, child.attrs)
                new.children.append(made)
                work.append((child, made))
    return render(copy)


def _one_table(table: Node, done: dict[int, list[str]]) -> list[str]:
    grid: list[tuple[bool, list[list[str]]]] = []
    stray = Node("div", {})
    stray.children = [" ".join(_stray(table))]
    if stray.children[0]:
        grid.append((False, [render(stray)]))
    for row in _rows(table):
        if row.tag == "tr":
            cells = [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c)]
            loose = Node("td", {})
            loose.children = [c for c in row.children if not (isinstance(c, Node) and c.tag in ("td", "th"))]
            made = [_cell(c, done) for c in cells]
            extra = _cell(loose, done)
            if extra:
                made.append(extra)
            if made:
                grid.append((True, made))
        elif row.children:
            grid.append((False, [_cell(row, done)]))
    columns = max((len(cells) for aligned, cells in grid if aligned), default=0)
    widths = [
        max((width(line) for aligned, cells in grid if aligned and k < len(cells) for line in cells[k]), default=0)
        for k in range(columns)
    ]
    lines: list[str] = []
    for aligned, cells in grid:
        if not aligned:
            lines += cells[0]
            continue
        for depth in range(max(1, max(map(len, cells)))):
            parts = []
            for k, cell in enumerate(cells):
                line = cell[depth] if depth < len(cell) else ""
                parts.append(line + " " * (widths[k] - width(line)))
            lines.append("  ".join(parts).rstrip(" "))
    while lines and not lines[-1]:
        lines.pop()
    return lines


def visible_text(source: str) -> str:
    return "\n".join(render(parse(source)))


def extract_text(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html"
) -> DataFrame:
    """``page_id`` and ``text``: the visible text of every page, laid out in lines.

    One row per row of ``pages``; repeated rows and null ids stay. A null or empty page
    gives the empty text, text without any tag is itself with white space collapsed,
    and no page fails: what is not a tag is text. Other columns are not read. A narrow
    step without shuffles; a page is held on its own.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, 1):
                found = [visible_text(source) for source in texts_of(block.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(found, pa.string())], names=["page_id", "text"]
                )

    return rows.mapInArrow(run, f"page_id {kind}, text string")
