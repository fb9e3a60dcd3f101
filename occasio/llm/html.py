"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a text renderer.

The tree builder follows the HTML standard where it bears on text: void elements, raw-text elements, end tags that
are implied by other tags, table parts, and a limit on depth (deeper elements become siblings, as in browsers). An
element is hidden by its kind, the ``hidden`` attribute, an inline style, or a rule of the page's own style sheets whose
selectors are simple (type, class, id, or these together); ``visibility: visible`` shows parts of an invisible element.

The renderer collapses white space, puts blocks on lines of their own, a blank line around paragraphs and headings,
marks and indents list items, keeps preformatted text, and aligns the cells of tables in columns.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import bounded, table

MAX_DEPTH = 200
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head title script style template noscript meta link base param source track area datalist iframe noembed noframes object audio video canvas svg math rp dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tr ul xmp".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu".split())
#: What a start tag closes, up to the nearest element named after it.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "optgroup"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
CLOSES_P = BLOCK - frozenset("body dd dt html legend li option optgroup tr summary".split()) | {"li", "dd", "dt"}
SCOPE = frozenset("button td th caption table html object template".split())
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_RULE = re.compile(r"([^{}]++)\{([^{}]*+)\}")
_SIMPLE = re.compile(r"(?:[a-zA-Z][\w-]*+|\*)?(?:[.#][\w-]++)*+")

#: Fixed values of the HTML standard: the most columns and rows that a cell spans; a rowspan of 0 is as many as there are.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65_534


def unescape(text: str) -> str:
    """The text with its character references resolved; numbers of any length, those beyond Unicode as U+FFFD."""
    if "&#" in text:
        text = re.sub(r"&#0+(?=[0-9])", "&#", text)
        text = re.sub(r"&#[0-9]{8,}", "&#9999999", text)
    return entities.unescape(text)


def _number(text: str | None, least: int, most: int, default: int) -> int:
    """A whole number of any length held between two bounds."""
    if not text or not (m := re.fullmatch(r"[ \t\n\f\r]*\+?0*([0-9]+)[^0-9]?.*", text, re.S)):
        return default
    return max(least, min(int(m[1][:9]) if len(m[1]) <= 9 else most, most))



class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> tuple[Node, list[str]]:
    """The page's tree and the texts of its style sheets. Never fails; a tag that does not end ends the page."""
    root = Node("html", {})
    stack, sheets = [root], []
    at, n = 0, len(source)

    def close(names: frozenset[str], until: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in until:
                return
            if tag in names:
                del stack[k:]
                close(names, until)
                return

    def add(node: Node) -> None:
        stack[min(len(stack), MAX_DEPTH) - 1].children.append(node)

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            add_text(stack, source[at:lt])
        if lt >= n:
            break
        at = lt + 1
        nxt = source[at : at + 1]
        if nxt == "!" or nxt == "?":
            if source.startswith("!--", at):
                end = source.find("-->", at + 1)
                at = n if end < 0 else end + 3
            elif source.startswith("![CDATA[", at):
                end = source.find("]]>", at)
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", at)
                at = n if end < 0 else end + 1
            continue
        if nxt == "/":
            m = _NAME.match(source, at + 1)
            end = source.find(">", at)
            at = n if end < 0 else end + 1
            if not m:
                continue
            tag = m[0].lower()
            if tag == "br":
                add(Node("br", {}))
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                add(Node("p", {}))
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in ("table", "td", "th", "template") and tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html", "template"):
                        break
            continue
        m = _NAME.match(source, at)
        if not m:
            add_text(stack, "<")
            continue
        tag, at = m[0].lower(), m.end()
        attrs: dict[str, str] = {}
        while True:
            while at < n and source[at] in " \t\n\r\f/":
                at += 1
            if at >= n or source[at] == ">":
                break
            a = _ATTRIBUTE.match(source, at)
            if not a or a.end() == at:
                at += 1
                continue
            at = a.end()
            if at < n and source[at] in "\"'" and a[2] is None and a[3] is None and a[4] is None and source[at - 1 : at] in "= \t\n":
                at = n  # a quoted value that does not end
                break
            attrs.setdefault(a[1].lower(), unescape(next((v for v in a.groups()[1:] if v is not None), "")))
        if at >= n:
            break
        at += 1
        if tag == "html":
            root.attrs = {**attrs, **root.attrs}
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag not in ("meta", "link", "base", "script", "style", "title", "template", "noscript", "head") and len(stack) > 1 and stack[-1].tag == "head":
            stack.pop()  # the body begins
        node = Node(tag, attrs)
        add(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            if tag == "style":
                sheets.append(body)
            elif tag in ("textarea", "xmp", "plaintext"):
                node.children.append(unescape(body) if tag == "textarea" else body)
            stop = source.find(">", end.start()) if end else -1
            at = n if stop < 0 else stop + 1
            continue
        stack.append(node)
        if len(stack) > MAX_DEPTH:
            stack.pop()
    return root, sheets


def add_text(stack: list[Node], text: str) -> None:
    node = stack[min(len(stack), MAX_DEPTH) - 1]
    if node.tag == "head" and text.strip():
        stack.pop()
        node = stack[-1]
    node.children.append(unescape(text) if "&" in text else text)


def _declared(style: str) -> tuple[bool | None, bool | None]:
    """(display none?, invisible?) of a declaration block; None: it says nothing."""
    display = visibility = None
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.replace("!important", "").strip()
        if name == "display":
            display = value == "none"
        elif name == "visibility":
            visibility = value in ("hidden", "collapse")
    return display, visibility


def rules(sheets: list[str]) -> list[tuple[str, frozenset[str], frozenset[str], bool | None, bool | None]]:
    """(type, classes, ids, display none?, invisible?) of the simple selectors that bear on visibility."""
    out = []
    for sheet in sheets:
        for selectors, body in _RULE.findall(re.sub(r"/\*.*?(?:\*/|$)", "", sheet, flags=re.S)):
            display, visibility = _declared(body)
            if display is None and visibility is None:
                continue
            for s in map(str.strip, selectors.split(",")):
                if s and _SIMPLE.fullmatch(s):
                    parts = re.findall(r"[.#]?[\w*-]+", s)
                    out.append((next((p.lower() for p in parts if p[0] not in ".#*"), ""), frozenset(p[1:] for p in parts if p[0] == "."), frozenset(p[1:] for p in parts if p[0] == "#"), display, visibility))
    return out


class Lines:
    """Lines of rendered text, with pending spaces and line breaks."""

    def __init__(self):
        self.out: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.breaks = 0
        self.indent, self.mark = 0, ""

    def text(self, s: str) -> None:
        words = _SPACES.split(s)
        if len(words) > 1 and not words[0]:
            self.space = True
        core = " ".join(w for w in words if w)
        if core:
            self._start()
            self.line.append(f" {core}" if self.space and self.line else core)
            self.space = False
        if len(words) > 1 and not words[-1]:
            self.space = True

    def _start(self) -> None:
        if self.breaks and self.line:
            self._flush()
        if not self.line:
            if self.breaks > 1 and self.out and self.out[-1]:
                self.out.append("")
            self.breaks, self.space = 0, False

    def _flush(self) -> None:
        pad = " " * self.indent
        if self.mark:
            pad, self.mark = pad[: -len(self.mark)] + self.mark, ""
        self.out.append((pad + "".join(self.line)).rstrip())
        self.line = []

    def end_line(self) -> None:
        """End the line under way, if any."""
        if self.line:
            self._flush()
        self.space = False

    def block(self, n: int) -> None:
        self.end_line()
        self.breaks = max(self.breaks, n)

    def newline(self) -> None:
        """A forced break."""
        self._start()
        self._flush()
        self.space = False

    def raw(self, lines: list[str]) -> None:
        self.end_line()
        for s in lines:
            self._start()
            self.line.append(s)
            self._flush()

    def lines(self) -> list[str]:
        self.end_line()
        out = self.out
        while out and not out[-1]:
            out.pop()
        while out and not out[0]:
            out.pop(0)
        return out


class Renderer:
    def __init__(self, sheets: list[str]):
        self.rules = rules(sheets)

    def shown(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """Whether the element is laid out, and whether its text is visible."""
        attrs = node.attrs
        if node.tag in HIDDEN and not (node.tag == "dialog" and "open" in attrs) or "hidden" in attrs and attrs["hidden"].lower() != "until-found" or node.tag == "input":
            return False, visible
        display = visibility = None
        if self.rules:
            classes = frozenset(attrs.get("class", "").split())
            for tag, want, ids, d, v in self.rules:
                if (not tag or tag == node.tag) and want <= classes and (not ids or ids == {attrs.get("id", "")}):
                    display, visibility = d if d is not None else display, v if v is not None else visibility
        if "style" in attrs:
            d, v = _declared(attrs["style"])
            display, visibility = d if d is not None else display, v if v is not None else visibility
        return not display, visible if visibility is None else not visibility

    def render(self, node: Node, out: Lines, visible: bool = True, pre: bool = False, depth: int = 0) -> None:
        for child in node.children:
            if isinstance(child, str):
                if visible:
                    if pre:
                        first, *rest = child.replace("\r\n", "\n").split("\n")
                        if first:
                            out._start()
                            out.line.append(first)
                        for s in rest:
                            out.newline()
                            if s:
                                out._start()
                                out.line.append(s)
                    else:
                        out.text(child)
                continue
            shown, sees = self.shown(child, visible)
            if not shown:
                continue
            tag = child.tag
            if tag == "br":
                if sees:
                    out.newline()
            elif tag == "wbr" or tag == "hr":
                if tag == "hr":
                    out.block(1)
            elif tag == "table":
                out.block(2)
                out.raw(self.table(child, sees, depth))
                out.block(2)
            elif tag in ("ul", "ol", "menu"):
                out.block(1 if depth else 2)
                self.list(child, out, sees, depth)
                out.block(1 if depth else 2)
            elif tag == "details" and "open" not in child.attrs:
                out.block(1)
                only = Node("details", {})
                only.children = [x for x in child.children if isinstance(x, Node) and x.tag == "summary"][:1]
                self.render(only, out, sees, pre, depth)
                out.block(1)
            elif tag in BLOCK or tag in ("td", "th", "caption"):
                n = 2 if tag in SPACED else 1
                out.block(n)
                if tag in ("blockquote", "dd"):
                    out.indent += 2
                if tag == "pre" and child.children and isinstance(child.children[0], str):
                    child.children[0] = child.children[0].removeprefix("\n")
                self.render(child, out, sees, pre or tag in ("pre", "listing", "xmp", "plaintext"), depth)
                out.end_line()
                if tag in ("blockquote", "dd"):
                    out.indent -= 2
                out.block(n)
            elif tag == "q":
                out.text("“") if sees else None
                self.render(child, out, sees, pre, depth)
                out.line.append("”") if sees else None
            else:
                self.render(child, out, sees, pre or tag == "textarea", depth)

    def list(self, node: Node, out: Lines, visible: bool, depth: int) -> None:
        m = re.fullmatch(r"\s*([-+]?[0-9]{1,9})\s*", node.attrs.get("start", "1"))
        number = int(m[1]) if m else 1
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                shown, sees = self.shown(child, visible)
                if not shown:
                    continue
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                out.block(1)
                out.indent += len(mark)
                before, out.mark = out.mark, mark
                inner = Node("li", {})
                inner.children = child.children
                self.render(inner, out, sees, False, depth + 1)
                out.end_line()
                out.mark = "" if out.mark == mark else before
                out.indent -= len(mark)
                out.block(1)
            else:
                wrap = Node("li", {})
                wrap.children = [child]
                self.render(wrap, out, visible, False, depth + 1)

    def table(self, node: Node, visible: bool, depth: int) -> list[str]:
        """Rows of cells, each column as wide as its widest line."""
        rows: list[list[tuple[list[str], int]]] = []
        above: dict[int, int] = {}  # columns that cells of rows before reach into, with the rows left
        before: list[str] = []

        def cells(row: Node, sees: bool) -> None:
            line: list[tuple[list[str], int]] = []
            taken: dict[int, int] = {}
            column = 0
            for c in row.children:
                if isinstance(c, str) or c.tag not in ("td", "th"):
                    if isinstance(c, str) and not c.strip():
                        continue
                    loose = Node("td", {})
                    loose.children = [c]
                    c = loose
                shown, inner = self.shown(c, sees)
                if not shown:
                    continue
                while above.get(column, 0):
                    line.append(([], 1))
                    column += 1
                span = _number(c.attrs.get("colspan"), 1, MAX_COLSPAN, 1)
                down = _number(c.attrs.get("rowspan"), 0, MAX_ROWSPAN, 1) or MAX_ROWSPAN
                one = Lines()
                self.render(c, one, inner, False, depth + 1)
                line.append((one.lines(), span))
                for k in range(column, column + span):
                    if down > 1:
                        taken[k] = down
                column += span
            for k in list(above):
                above[k] -= 1
                if not above[k]:
                    del above[k]
            for k, v in taken.items():
                above[k] = v - 1
            if line:
                rows.append(line)

        def part(x: Node, sees: bool) -> None:
            loose: list = []
            for c in x.children:
                if isinstance(c, Node) and c.tag in ("tr", "tbody", "thead", "tfoot", "caption", "colgroup", "col"):
                    shown, inner = self.shown(c, sees)
                    if not shown or c.tag in ("colgroup", "col"):
                        continue
                    if c.tag == "caption":
                        one = Lines()
                        self.render(c, one, inner, False, depth + 1)
                        before.extend(one.lines())
                    elif c.tag == "tr":
                        cells(c, inner)
                    else:
                        part(c, inner)
                elif not isinstance(c, str) or c.strip():
                    loose.append(c)
            if loose:
                row = Node("tr", {})
                row.children = loose
                cells(row, sees)

        part(node, visible)
        widths: dict[int, int] = {}
        for line in rows:
            k = 0
            for text, span in line:
                if span == 1:
                    widths[k] = max(widths.get(k, 0), max(map(len, text), default=0))
                k += span
        out = list(before)
        for line in rows:
            for i in range(max((len(t) for t, _ in line), default=0)):
                k, s, at = 0, "", 0
                for text, span in line:
                    s = s.ljust(at) + (text[i] if i < len(text) else "")
                    for c in range(k, k + span):
                        if c in widths:
                            at += widths[c] + 2 if widths[c] else 0
                    at = max(at, len(s) + 2 if span > 1 and s else 0)
                    k += span
                out.append(s.rstrip())
        return out


def render(source: str | None) -> tuple[str, str]:
    """(title, visible text) of a page; both empty for null, empty or tagless blank input."""
    if not source:
        return "", ""
    root, sheets = parse(source)
    found = re.search(r"<title(?:\s[^>]*)?>(.*?)(?:</title|$)", source, re.S | re.I)
    title = " ".join(unescape(found[1]).split()) if found else ""
    out = Lines()
    r = Renderer(sheets)
    shown, sees = r.shown(root, True)
    if shown:
        r.render(root, out, sees)
    return title, "\n".join(out.lines())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title, text, n_lines of every page; null or empty html gives empty text. Narrow: no shuffle.

    Repeated rows each give a row; other columns do not matter. A page is read whole, however long it is or deep its
    tags are nested; markup that is broken in whatever way gives the text that a browser would show.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [render(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([s for _, s in got], pa.string()), pa.array([s.count("\n") + 1 if s else 0 for _, s in got], pa.int64())], names=["page_id", "title", "text", "n_lines"])

    return bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, title string, text string, n_lines long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
