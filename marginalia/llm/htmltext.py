"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder with implied end tags (p, li, dt, dd, options, table parts) and implied table parts;
visibility rules drop what a browser would not paint (script, style, template, hidden, display:none, closed dialogs, closed
details but their summary; text under visibility:hidden but for elements that are visible again; of a drop-down list all but
the shown option; descriptions and definitions in svg and math); the
renderer emits all other text: blank lines between paragraphs and headings, list markers with nested indentation,
preformatted text as it stands, and tables as aligned cells.

Defined cases: a null or empty page gives an empty text and title; unclosed or misnested tags, broken comments and stray
``<`` are text or ignored as a browser would; nesting of any depth is walked without recursion; repeated rows stay; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import slices, table

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?(?:--!?>|\Z))|(?P<bogus>[!?][^>]*(?:>|\Z))|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|(?P<loose>[a-zA-Z][^\s/>]*)(?P<looser>[^>]*)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNEVEN = re.compile(r"[\t\n\r\f]|  |^ | $")
_BARE = re.compile("hidden|open|selected|multiple|disabled", re.I)
_NONE: dict[str, str] = {}
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript iframe object noembed noframes canvas audio video datalist title".split())
#: Not painted inside svg and math.
FOREIGN_UNSEEN = set("desc defs symbol metadata clippath mask marker pattern annotation annotation-xml mphantom".split())
#: Labels and formula tokens that stand apart from their neighbours.
_APART = set("svg text foreignobject mi mn mo mtext ms option".split())
BLOCK = set("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul caption tbody thead tfoot tr td th".split())
SPACED = set("p blockquote pre h1 h2 h3 h4 h5 h6 ul ol dl table figure menu".split())
CLOSES_P = BLOCK - set("body html caption tbody thead tfoot tr td th dd dt li".split()) | {"li", "dd", "dt"}
#: Start tag -> (open elements it closes, elements that stop the search).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: What the renderer treats in a way of its own; any other element is a block or flows inline.
_SPECIAL = set("details br hr wbr img pre textarea select table ul ol menu li blockquote dd td th".split())
_SCOPE = {"table", "td", "th", "caption", "html", "button", "object", "template"}


_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
_PLAIN_TAG = re.compile(r"<(/?)([a-z][a-z0-9]*)>")


def entities(text: str) -> str:
    """text without character references; the common ones without a callback for each."""
    n = text.count("&")
    if not n:
        return text
    if n == sum(text.count(name) for name, _ in _NAMED):
        for name, char in _NAMED:  # the ampersand last, as it makes no new references
            text = text.replace(name, char)
        return text
    return unescape(text)


class Node:
    """hidden: nothing below is painted; shown: whether its own text is, which elements below may change."""

    __slots__ = ("tag", "hidden", "shown", "attrs", "children")

    def __init__(self, tag: str, hidden: bool = False, attrs: dict[str, str] | None = None, shown: bool = True) -> None:
        self.tag, self.hidden, self.shown, self.attrs, self.children = tag, hidden, shown, attrs or _NONE, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def is_hidden(tag: str, attrs: dict[str, str]) -> bool:
    """Whether a browser paints nothing of the element."""
    if tag in UNSEEN or "hidden" in attrs:
        return True
    if tag == "dialog" and "open" not in attrs:
        return True
    return "style" in attrs and bool(_HIDDEN_STYLE.search(attrs["style"]))


def is_shown(inherited: bool, attrs: dict[str, str]) -> bool:
    """Whether text is visible by the visibility property, which an element may set against its parents."""
    said = _VISIBILITY.findall(attrs["style"]) if "style" in attrs else []
    return said[-1].lower() == "visible" if said else inherited


def parse(html: str) -> tuple[Node, str]:
    """The tree and the text of the first title element."""
    root, title, at, end = Node("html"), None, 0, len(html)
    stack = [root]
    count: dict[str, int] = {}  # open elements by tag

    def text(part: str) -> None:
        if part and stack[-1].shown:
            stack[-1].children.append(entities(part))

    def close(tags: set[str], stop: set[str]) -> None:
        if not any(count.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for n in stack[i:]:
                    count[n.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    def foreign() -> bool:
        return bool(count.get("svg") or count.get("math"))

    def made(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, is_hidden(tag, attrs) or (tag in FOREIGN_UNSEEN and foreign()), attrs, is_shown(stack[-1].shown, attrs))
        stack[-1].children.append(node)
        return node

    def opened(tag: str, attrs: dict[str, str]) -> None:
        stack.append(made(tag, attrs))
        count[tag] = count.get(tag, 0) + 1

    def leave() -> None:
        count[stack.pop().tag] -= 1

    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            text(html[at:])
            break
        m = _PLAIN_TAG.match(html, begin)
        if m:
            ending, tag, raw = m[1], m[2], ""
        else:
            m = _TAG.match(html, begin)
            if m is None:  # a stray sign
                text(html[at : begin + 1])
                at = begin + 1
                continue
            ending, tag, raw = m["end"], (m["end"] or m["start"] or m["loose"] or "").lower(), m["attrs"] or m["looser"] or ""
        if begin > at:
            text(html[at:begin])
        at = m.end()
        if ending:
            if tag == "p" and not count.get("p"):
                stack[-1].children.append(Node("p"))
            elif tag in BLOCK:
                close({tag}, {"table"} - {tag})
            else:  # inline: not through a block, whose own end comes first
                close({tag}, BLOCK)
            continue
        if not tag:
            continue
        attrs = attributes(raw) if raw and ("=" in raw or _BARE.search(raw)) else _NONE
        if tag in ("html", "body", "head"):
            if tag != "head":
                root.hidden = root.hidden or is_hidden(tag, attrs)
                root.shown = is_shown(root.shown, attrs)
            if tag == "body":
                close({"head"}, set())
            if tag != "head":
                continue
        elif stack[-1].tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "noscript", "template"):
            leave()
        if tag in CLOSES_P:
            close({"p"}, _SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
            if tag == "tr":
                close({"tr"}, {"table", "tbody", "thead", "tfoot"})
        if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
            leave()
        if tag in ("td", "th") and stack[-1].tag != "tr" and count.get("table"):
            opened("tr", {})
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            inner = html[at : stop.start() if stop else end]
            at = stop.end() if stop else end
            if tag == "title" and title is None and not foreign():
                title = " ".join(unescape(inner).split())
            if tag in ("textarea", "xmp"):
                node = made("pre" if tag == "xmp" else tag, attrs)
                node.children += [inner if tag == "xmp" else entities(inner)] if node.shown else []
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr"):
                made(tag, attrs)
            continue
        opened(tag, attrs)
        if raw.endswith("/") and foreign():  # only there does the slash close an element
            leave()
    return root, title or ""


class Layout:
    """Collects lines: inline text flows together, blocks break lines, and spaced blocks leave one blank line between."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.flow: list[str] = []
        self.blank = False
        self.indent: list[str] = []
        self.mark = ""

    def inline(self, text: str) -> None:
        self.flow.append(text)

    def line_break(self, force: bool = False) -> None:
        if self.flow:
            line = "".join(self.flow)
            line = _SPACE.sub(" ", line).strip(" ") if _UNEVEN.search(line) else line
            self.flow = []
        else:
            line = ""
        if line:
            self._put(line)
        elif force and self.lines and self.lines[-1]:
            self.lines.append("")

    def _put(self, line: str) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        pad = "".join(self.indent)
        if self.mark:
            pad = pad[: -len(self.mark)] + self.mark if pad else self.mark
            self.mark = ""
        self.lines.append(pad + line)

    def space(self) -> None:
        self.line_break()
        self.blank = True

    def block(self, lines: list[str]) -> None:
        self.line_break()
        for line in lines:
            self._put(line)

    def text(self) -> str:
        self.line_break()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _content(node: Node) -> str:
    """All text below node as it stands."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif not x.hidden:
            todo += reversed(x.children)
    return "".join(out)


def _shown(select: Node) -> list[Node]:
    """The options that a closed drop-down list shows (one) or a list box (all)."""
    options, todo = [], [select]
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.hidden:
            options += [x] if x.tag == "option" else []
            todo += reversed(x.children)
    size = select.attrs.get("size", "").strip()
    if not options or "multiple" in select.attrs or (size.isascii() and size.isdigit() and int(size) > 1):
        return options
    chosen = [x for x in options if "selected" in x.attrs][-1:]
    return chosen or [x for x in options if "disabled" not in x.attrs][:1]


def _rows(tree: Node) -> tuple[list[list[Node] | None], list[Node], list]:
    """Rows of cells (None where a row group starts or ends), captions, and what else stands in the table (painted before it)."""
    rows, captions, other = [], [], []
    todo = list(reversed(tree.children))
    while todo:
        x = todo.pop()
        if x is None:
            rows.append(None)
        elif isinstance(x, str):
            if x.strip():
                other.append(x)
        elif x.hidden:
            continue
        elif x.tag in ("tbody", "thead", "tfoot"):
            todo += [None, *reversed(x.children), None]
        elif x.tag == "tr":
            cells = [c for c in x.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden]
            other += [c for c in x.children if (isinstance(c, str) and c.strip()) or (isinstance(c, Node) and c.tag not in ("td", "th"))]
            rows.append(cells)
        elif x.tag == "caption":
            captions.append(x)
        elif x.tag not in ("colgroup", "col"):
            other.append(x)
    return rows, captions, other


def _span(cell: Node, name: str = "colspan", most: int = 1000) -> int:
    digits = cell.attrs.get(name, "1").strip()
    return min(most, max(1, int(digits))) if digits.isascii() and digits.isdigit() else 1


def _placed(rows: list[list[Node] | None]) -> list[list[tuple[int, Node, int]]]:
    """(column, cell, columns) of each row; columns that a cell from above still covers are left out."""
    out: list[list[tuple[int, Node, int]]] = []
    covered: dict[int, int] = {}  # column -> rows still covered, this one included
    for row in rows:
        if row is None:  # no cell reaches into the next row group
            covered = {}
            continue
        at, line, below = 0, [], {c: n - 1 for c, n in covered.items() if n > 1}
        for cell in row:
            while at in covered:
                at += 1
            span = _span(cell)
            down = 65534 if cell.attrs.get("rowspan", "").strip() == "0" else _span(cell, "rowspan", 65534)
            line.append((at, cell, span))
            if down > 1:
                for c in range(at, at + span):
                    below[c] = max(below.get(c, 0), down - 1)
            at += span
        covered = below
        out.append(line)
    return out


def _aligned(grid: list[list[tuple[int, list[str], int]]]) -> list[str]:
    """Lines of a table: cells of a column start at one place; a cell over several columns does not widen them."""
    widths: dict[int, int] = {}
    for row in grid:
        for at, lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
    out = []
    for row in grid:
        for i in range(max((len(lines) for _, lines, _ in row), default=0)):
            at, line = 0, ""
            for start, lines, span in row:
                for c in range(at, start):  # covered from above
                    line += (" | " if c else "") + " " * widths.get(c, 0)
                wide = sum(widths.get(c, 0) for c in range(start, start + span)) + 3 * (span - 1)
                line += (" | " if start else "") + (lines[i] if i < len(lines) else "").ljust(wide)
                at = start + span
            out.append(line.rstrip(" ") if line.strip(" |") else line.rstrip(" |"))
    return [x for x in out if x]


def render(root: Node) -> str:
    """The visible text below root; tables in cells of tables wait on a list here, not on the call stack."""
    running, done = [_render(root)], None
    while running:
        try:
            running.append(_render(running[-1].send(done)))
            done = None
        except StopIteration as end:
            running.pop()
            done = end.value
    return done


def _holder(children: list) -> Node:
    out = Node("div")
    out.children = children
    return out


def _render(root: Node) -> Generator[Node, str, str]:
    """Yields what is to be rendered apart, takes its text, returns the text below root."""
    page = Layout()
    lists: list[list] = []  # open lists: [ordered, next number]
    todo: list = [("open", root)]
    while todo:
        what, node = todo.pop()
        if what == "text":
            page.flow.append(node)
        elif what == "close":
            tag = node.tag
            if tag in ("ul", "ol", "menu"):
                lists.pop()
                page.line_break()
                page.blank = not lists
            elif tag == "li":
                page.line_break()
                page.mark = ""
                page.indent.pop()
            elif tag in ("blockquote", "dd"):
                page.line_break()
                page.indent.pop()
                page.blank = page.blank or tag == "blockquote"
            elif tag in SPACED:
                page.space()
            else:
                page.line_break()
        elif what == "open":
            if node.hidden:
                continue
            tag = node.tag
            if tag not in _SPECIAL:
                if tag in _APART:
                    page.flow.append(" ")
                    todo.append(("text", " "))
                elif tag in BLOCK:
                    page.line_break()
                    if tag in SPACED:
                        page.blank = True
                    todo.append(("close", node))
                for x in reversed(node.children):
                    todo.append(("text", x) if isinstance(x, str) else ("open", x))
                continue
            if tag == "br":
                page.line_break(force=True)
                continue
            if tag == "hr":
                page.space()
                continue
            if tag == "wbr":
                continue
            if tag == "img":
                page.inline(" " + node.attrs.get("alt", "") + " " if node.attrs.get("alt") and node.shown else "")
                continue
            if tag == "pre":
                page.space()
                page.block(_content(node).strip("\n").expandtabs(8).split("\n"))
                page.space()
                continue
            if tag == "textarea":
                page.block([x for x in _content(node).expandtabs(8).split("\n") if x.strip()])
                continue
            if tag == "select":
                for x in reversed(_shown(node)):
                    todo.append(("text", f" {x.attrs['label']} ") if x.attrs.get("label") and x.shown else ("open", x))
                continue
            if tag == "details" and "open" not in node.attrs:  # closed: its summary alone is painted
                summary = next((x for x in node.children if isinstance(x, Node) and x.tag == "summary"), None)
                page.line_break()
                todo += [("close", node), *([("open", summary)] if summary else [])]
                continue
            if tag == "table":
                page.space()
                rows, captions, other = _rows(node)
                for x in [*captions, *other]:
                    shown = yield _holder(x.children if isinstance(x, Node) and x.tag == "caption" else [x])
                    page.block([y for y in shown.split("\n") if y])
                grid = []
                for row in _placed(rows):
                    cells = []
                    for at, c, span in row:
                        shown = yield _holder(c.children)
                        cells.append((at, [y for y in shown.split("\n") if y], span))
                    grid.append(cells)
                page.block(_aligned(grid))
                page.space()
                continue
            if tag in BLOCK:
                if tag in ("ul", "ol", "menu"):
                    page.line_break()
                    page.blank = page.blank or not lists
                    start = node.attrs.get("start", "1").strip()
                    lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                elif tag == "li":
                    page.line_break()
                    mark = "- "
                    if lists and lists[-1][0]:
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    page.indent.append(" " * len(mark))
                    page.mark = mark
                elif tag in ("blockquote", "dd"):
                    page.space() if tag == "blockquote" else page.line_break()
                    page.indent.append("    " if tag == "dd" else "> ")
                elif tag in ("td", "th"):
                    page.inline(" ")
                else:
                    page.line_break()
                todo.append(("close", node))
            for x in reversed(node.children):
                todo.append(("text", x) if isinstance(x, str) else ("open", x))
    return page.text()


def extract(html: str | None) -> tuple[str, str]:
    """Title and visible text of a page."""
    if not html:
        return "", ""
    root, title = parse(html)
    return title, render(root)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text, n_chars, n_lines of every whole page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [extract(x) for x in batch.column(2).to_pylist()]
            columns = [pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for _, x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["page_id", "url", "title", "text", "n_chars", "n_lines"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, title string, text string, n_chars bigint, n_lines bigint")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
