"""Readable content of an HTML page: title, plain text, Markdown, tables and references.

The tree is built by the standard library's parser with implied end tags. The article is the first ``article``, ``main`` or
``role=main`` element with text, else the body; navigation, footers, forms and scripts are left out. Null pages give null
fields; a page whose one format fails still has the other.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from marginalia.functions.types import FLAG, NUMBER, TEXT, struct
from marginalia.functions.urls import safe_link

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template nav footer aside form button select iframe svg head title".split())
BLOCKS = frozenset("address article blockquote body caption dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag ends, and those the search for them does not leave.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})} | {
    t: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for t in ("thead", "tbody", "tfoot")
}
MAX_REFERENCES, MAX_LABEL, MAX_START, MAX_SPAN = 100, 300, 999_999_999, 1000


class Element:
    __slots__ = ("tag", "attrs", "inside")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.inside = tag, attrs, []

    def walk(self) -> Iterator[Element]:
        """This element and all below, in document order."""
        todo = [self]
        while todo:
            at = todo.pop()
            yield at
            todo += [c for c in reversed(at.inside) if not isinstance(c, str)]

    def text(self) -> str:
        """All text below, as it stands; a line break is a space."""
        out, todo = [], [self]
        while todo:
            at = todo.pop()
            if isinstance(at, str):
                out.append(at)
            elif at.tag == "br":
                out.append(" ")
            else:
                todo += reversed(at.inside)
        return "".join(out)

    def find(self, *tags: str) -> Element | None:
        return next((e for e in self.walk() if e.tag in tags), None)

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {})
        self.open = [self.root]
        self.count: dict[str, int] = {}  # open elements by tag
        self.depth = 0

    def _leave(self, i: int) -> None:
        for element in self.open[i:]:
            self.count[element.tag] -= 1
        del self.open[i:]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop or not any(map(self.count.get, tags)):
                break
            if self.open[i].tag in tags:
                self._leave(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found: dict[str, str] = {}
        for name, value in attrs:
            found.setdefault(name, value or "")
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        elif tag in BLOCKS:
            self._close({"p"}, BLOCKS - {"p"})
        element = Element(tag, found)
        self.open[-1].inside.append(element)
        if tag not in VOID:
            self.open.append(element)
            self.count[tag] = self.count.get(tag, 0) + 1
            self.depth = max(self.depth, len(self.open))

    def handle_endtag(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._leave(i)
                return
            if self.open[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def tree(html: str) -> Element:
    return _built(html)[0]


def _built(html: str) -> tuple[Element, int]:
    """The tree and how deep its elements nest."""
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except AssertionError:  # malformed marked sections: what was read so far stands
        pass
    return builder.root, builder.depth


@contextmanager
def deep(levels: int) -> Iterator[None]:
    """Room for the renderers' calls on a tree of so many levels; theirs are Python frames alone, which live on the heap."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 4 * levels + 1000))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def title(root: Element) -> str:
    found = root.find("title")
    return squeeze(found.text()) if found else ""


def title_source(html: Column) -> Column:
    """What stands between the first title tags of a page: ASCII white space squeezed, spaces of any kind cut off its ends, character
    references as written. Empty without such tags; ``title`` is what a browser shows."""
    found = F.regexp_extract(html, r"(?is)\A(?>.*?<title[^>]*+>)(.*?)</title", 1)  # after the first start tag or nowhere
    return F.regexp_replace(F.regexp_replace(found, r"[\t\n\f\r ]+", " "), r"\A\p{Zs}+|\p{Zs}+\z", "")


def main_part(root: Element) -> Element:
    for wanted in (lambda e: e.tag == "article", lambda e: e.tag == "main" or e.attrs.get("role") == "main"):
        found = next((e for e in root.walk() if wanted(e) and e.text().strip()), None)
        if found:
            return found
    return root.find("body") or root


def _number(raw: str | None, default: int, low: int, high: int) -> int:
    return min(high, int(raw)) if raw and re.fullmatch(r"[0-9]{1,18}", raw) and int(raw) >= low else default


def grid(table: Element) -> tuple[list[list[Element | None]], bool]:
    """Rows of cells with spans filled in (a spanning cell stands at each place it covers), and whether row one is a header.

    A row span of 0 reaches to the end of its own row group, a larger one is cut there; a bad span or a column span of 0 is 1.
    """
    groups: list[tuple[str, list[Element]]] = []
    for child in table.inside:
        if isinstance(child, str):
            continue
        if child.tag in ("thead", "tbody", "tfoot"):
            groups.append((child.tag, [r for r in child.inside if not isinstance(r, str) and r.tag == "tr"]))
        elif child.tag == "tr":
            if not groups or groups[-1][0] != "":
                groups.append(("", []))
            groups[-1][1].append(child)
    rows: list[list[Element | None]] = []
    for _, members in groups:
        placed: list[dict[int, Element]] = [{} for _ in members]
        for r, row in enumerate(members):
            column = 0
            for cell in row.inside:
                if isinstance(cell, str) or cell.tag not in ("td", "th"):
                    continue
                while column in placed[r]:
                    column += 1
                down = _number(cell.attrs.get("rowspan"), 1, 0, len(members)) or len(members)
                across = _number(cell.attrs.get("colspan"), 1, 1, MAX_SPAN)
                for i in range(r, min(len(members), r + down)):
                    for j in range(column, column + across):
                        placed[i].setdefault(j, cell)
                column += across
        rows += [[p.get(j) for j in range(max(p, default=-1) + 1)] for p in placed]
    width = max(map(len, rows), default=0)
    rows = [r + [None] * (width - len(r)) for r in rows if r]
    filled = [(kind, members) for kind, members in groups if members]
    header = bool(rows) and (filled[0][0] == "thead" or all(c is None or c.tag == "th" for c in rows[0]))
    return rows, header


def fence(code: str, least: int = 3) -> str:
    """Backticks, more than any run within code."""
    return "`" * max(least, 1 + max(map(len, re.findall("`+", code)), default=0))


class Markdown:
    """Renders a part of a page; collects its references on the way."""

    def __init__(self, base: str) -> None:
        self.base, self.seen = base, {}
        self.truncated = False
        self.counts = {"code_blocks": 0, "tables": 0}

    def link(self, element: Element) -> str | None:
        url = safe_link(self.base, element.attrs["href"]) if element.attrs.get("href") else None
        if url and url not in self.seen:
            if len(self.seen) < MAX_REFERENCES:
                self.seen[url] = squeeze(element.text())[:MAX_LABEL] or url[:MAX_LABEL]
            else:
                self.truncated = True
        return url

    def inline(self, item: Element | str, cell: bool = False) -> str:
        if isinstance(item, str):
            return re.sub(r"\s+", " ", item)
        tag = item.tag
        if tag in SKIPPED:
            return ""
        if tag == "br":
            return " " if cell else "\n"
        if tag in ("code", "kbd", "samp", "tt"):
            code = squeeze(item.text())
            if not code:
                return ""
            marks = fence(code, 1)
            code = f" {code} " if code[0] == "`" or code[-1] == "`" else code
            return marks + (code.replace("|", "\\|") if cell else code) + marks
        said = "".join([self.inline(c, cell) for c in item.inside])
        if tag == "a":
            url = self.link(item)
            return f"[{said.strip()}]({url})" if url and said.strip() else said
        mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}.get(tag)
        if mark and said.strip():
            return said[: len(said) - len(said.lstrip())] + mark + said.strip() + mark + said[len(said.rstrip()) :]
        return f" {said} " if tag in BLOCKS else said

    def blocks(self, element: Element) -> list[str]:
        out: list[str] = []
        run: list[str] = []
        last_list = False

        def flush() -> bool:
            said = "\n".join(filter(None, (" ".join(x.split()) for x in "".join(run).split("\n"))))
            run.clear()
            if said:
                out.append(said)
            return bool(said)

        for child in element.inside:
            if isinstance(child, str) or child.tag not in BLOCKS and not any(e.tag in BLOCKS for e in child.walk()):
                run.append(self.inline(child))
                continue
            if flush():
                last_list = False
            if child.tag in SKIPPED:
                continue
            is_list = child.tag in ("ul", "ol")
            made = self.block(child)
            if made and is_list and last_list:
                out.append("<!-- -->")  # else two lists would read as one
            out += made
            last_list = is_list if made else last_list
        flush()
        return out

    def block(self, element: Element) -> list[str]:
        tag = element.tag
        if re.fullmatch("h[1-6]", tag):
            said = squeeze("".join([self.inline(c) for c in element.inside]))
            return [f"{'#' * int(tag[1])} {said}"] if said else []
        if tag == "pre":
            return self.code(element)
        if tag == "hr":
            return ["---"]
        if tag in ("ul", "ol"):
            return self.items(element)
        if tag == "table":
            return self.table(element)
        if tag == "blockquote":
            inner = "\n\n".join(self.blocks(element))
            return ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
        return self.blocks(element)

    def code(self, element: Element) -> list[str]:
        code = "".join("\n" if not isinstance(e, str) and e.tag == "br" else e for e in _leaves(element)).removeprefix("\n").rstrip("\n")
        if not code.strip():
            return []
        self.counts["code_blocks"] += 1
        names = " ".join(e.attrs.get("class", "") for e in element.walk())
        language = re.search(r"(?:^|\s)lang(?:uage)?-([\w+#.-]+)", names)
        marks = fence(code)
        return [f"{marks}{language[1] if language else ''}\n{code}\n{marks}"]

    def items(self, element: Element) -> list[str]:
        number = _number(element.attrs.get("start"), 1, 0, MAX_START)
        out = []
        for child in element.inside:
            if isinstance(child, str) or child.tag in SKIPPED:
                continue
            marker = "- " if element.tag == "ul" else f"{number}. "
            holder = child
            if child.tag != "li":
                holder = Element("li", {})
                holder.inside.append(child)
            inner = self.blocks(holder)
            if not inner:
                continue
            pad = " " * len(marker)
            body = inner[0]
            for before, part in zip(inner, inner[1:]):
                tight = re.match(r"(?:- |\d+\. )", part) and "\n" not in before
                body += ("\n" if tight else "\n\n") + part
            out.append(marker + "\n".join(x and (pad + x if i else x) for i, x in enumerate(body.split("\n"))))
            number += 1
        return ["\n".join(out)] if out else []

    def table(self, element: Element) -> list[str]:
        rows, header = grid(element)
        caption = next((c for c in element.inside if not isinstance(c, str) and c.tag == "caption"), None)
        out = self.blocks(caption) if caption else []
        if not rows:
            return out
        self.counts["tables"] += 1
        shown = [["" if c is None else squeeze("".join([self.cell(x) for x in c.inside])) for c in row] for row in rows]
        if not header:
            shown.insert(0, [""] * len(shown[0]))
        lines = ["| " + " | ".join(row) + " |" for row in shown]
        lines.insert(1, "|" + " --- |" * len(shown[0]))
        return [*out, "\n".join(lines)]

    def cell(self, item: Element | str) -> str:
        if isinstance(item, str):
            return item.replace("|", "\\|")
        if item.tag == "code":
            return self.inline(item, cell=True)
        if item.tag == "a":
            said = squeeze("".join([self.cell(c) for c in item.inside]))
            url = self.link(item)
            return f"[{said}]({url})" if url and said else said
        if item.tag in SKIPPED:
            return ""
        said = "".join([self.cell(c) for c in item.inside])
        return f" {said} " if item.tag in BLOCKS or item.tag == "br" else said


def _leaves(element: Element) -> Iterator[Element | str]:
    todo = list(reversed(element.inside))
    while todo:
        at = todo.pop()
        if isinstance(at, str) or not at.inside:
            yield at if isinstance(at, str) or at.tag == "br" else ""
        else:
            todo += reversed(at.inside)


def plain(element: Element) -> str:
    """Visible text, a line a block; cells of a row stand side by side."""
    out: list[str] = [""]

    def visit(item: Element | str) -> None:
        if isinstance(item, str):
            out[-1] += re.sub(r"\s+", " ", item)
        elif item.tag == "pre":
            out.extend(["", *"".join(x if isinstance(x, str) else "\n" for x in _leaves(item)).strip("\n").split("\n"), ""])
        elif item.tag not in SKIPPED:
            apart = item.tag in BLOCKS and item.tag not in ("td", "th") or item.tag == "br"
            if apart:
                out.append("")
            for child in item.inside:
                visit(child)
            if item.tag in ("td", "th"):
                out[-1] += " | "
            elif apart:
                out.append("")

    visit(element)
    return "\n".join(filter(str.strip, (x.strip(" ").removesuffix(" |") if x.endswith(" | ") else x.rstrip() for x in out)))


def extract(html: str | None, url: str = "") -> dict:
    """title, text, markdown, references, references_truncated, code_blocks, tables, and an error for each format that failed."""
    blank = dict.fromkeys(("title", "text", "markdown", "references", "references_truncated", "code_blocks", "tables", "text_error", "markdown_error"))
    if html is None:
        return blank
    root, levels = _built(html)
    part = main_part(root)
    found = blank | {"title": title(root), "text": "", "markdown": "", "references": [], "references_truncated": False, "code_blocks": 0, "tables": 0}
    try:
        with deep(levels):
            found["text"] = plain(part)
    except (RecursionError, ValueError) as error:
        found["text_error"] = type(error).__name__
    base = root.find("base")
    writer = Markdown((safe_link(url, base.attrs["href"]) if base and base.attrs.get("href") else None) or url)
    try:
        with deep(levels):
            found["markdown"] = "\n\n".join(writer.blocks(part))
    except (RecursionError, ValueError) as error:
        found["markdown_error"] = type(error).__name__
    found["references"] = [{"text": text, "url": link} for link, text in writer.seen.items()]
    return found | {"references_truncated": writer.truncated} | writer.counts


ARTICLE = struct(title=TEXT, text=TEXT, markdown=TEXT, references=ArrayType(struct(text=TEXT, url=TEXT)), references_truncated=FLAG, code_blocks=NUMBER, tables=NUMBER, text_error=TEXT, markdown_error=TEXT)


@F.pandas_udf(ARTICLE)
def extract_udf(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    """extract() of each page."""
    return pd.DataFrame([extract(h, u or "") for h, u in zip(html, url)], columns=ARTICLE.names, dtype=object)
