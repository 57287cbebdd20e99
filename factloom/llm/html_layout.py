"""HTML to text by layout: what a reader would see, with its blocks, lists and tables.

A tokenizer turns the page into tags and text; a tree builder opens and closes elements by the rules of HTML's implied
tags (a paragraph ends where a block begins, items and cells end where the next begins, unclosed elements end with
their parent); visibility rules drop what isn't shown (scripts, styles, templates, hidden elements, comments, closed
details, input fields, and media, frames and noscript with their fallback; what aria-hidden marks is hidden from
assistive technology only and stays); a renderer lays out the rest. Formulas, the text of SVG drawings (not their
titles and definitions), all options of a choice, the contents of text areas and the fallback of objects are shown.
Inline text flows with white space collapsed, blocks stand on lines of their own, paragraphs, headings, lists and
tables have a blank line around them, list items carry bullets or numbers and indent with their depth, preformatted
text keeps its spaces, and the cells of a table are padded to aligned columns. What stands in a table outside its cells
comes before it, as in browsers; elements around cells or rows are looked through.

Null and empty pages give the empty text. Pages of any length, nesting and damage give their whole text in time and
memory that grow with their length: no input raises, and no depth ends the tree. Only spacing has bounds. Cells wider
than WIDEST columns aren't padded to; beyond PADDING times the page's length of padding, a table's cells are joined
without padding; lines indent by INDENT columns at most; tables nested deeper than NESTED in cells are laid out as
blocks; beyond SPANS open row spans of a table a cell spans one row. Repeated rows are rendered alike; other columns
are ignored, whatever their names. Tags whose quotes don't end are text; where many don't, quotes are no longer heeded.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_rows

#: Element names by the part they play in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style template head title noscript iframe canvas audio video datalist noembed noframes annotation annotation-xml mphantom".split())
#: Of SVG, text is shown where it is in a text element or is HTML, unless it is in one of these.
SVG_TEXT = frozenset("text foreignobject".split())
SVG_HIDDEN = frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split())
#: Elements of MathML whose children stand at places of their own.
MATH_PLACES = frozenset("mfrac msub msup msubsup munder mover munderover mmultiscripts mroot mtable mtr mlabeledtr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p pre search section summary table ul xmp tr td th thead tbody tfoot caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu dir fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre section summary table ul".split())
#: For an opening tag: the elements it closes, and those that its search doesn't leave.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"]))),
}
#: A closing tag doesn't reach beyond these, but for those that name a part of a table or the page.
SCOPES = frozenset("table td th caption body html".split())
BEYOND = frozenset("table tr tbody thead tfoot body html td th".split())
#: Bounds of spacing, see above. No text depends on them.
WIDEST, PADDING, INDENT, NESTED, SPANS = 100, 16, 80, 12, 64
#: What unended tags may cost, in times the page's length, before quotes are no longer heeded.
UNENDED = 50

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)")
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^<>]*+)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
UNQUOTED = re.compile(r"=\s*[^\s\"'<>=`]+$")
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attrs", "children", "holds_cells")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs = name, attrs
        self.children: list[Node | str] = []
        self.holds_cells = False  # wraps rows or cells of the table around it


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        found.setdefault(m[1].lower(), unescape(value))
    return found


def tokens(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, place after it); kind: text, open, close. Sent a place, it goes on from there."""
    at = begun = spent = 0
    pattern, allowed = TAG, UNENDED * len(html) + 100_000
    while (lt := html.find("<", at)) >= 0:
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?") or after == "/" and not html[lt + 2 : lt + 3].isalpha():
            if after == "/" and html[lt + 2 : lt + 3] != ">":
                end = html.find(">", lt)
            elif html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                end = end + 2 if end >= 0 else end
            else:
                end = html.find(">", lt)
            yield "text", html[begun:lt], "", lt
            at = begun = end + 1 if end >= 0 else len(html)
            continue
        m = pattern.match(html, lt)
        if m is None:
            at = lt + 1
        elif html[m.end() : m.end() + 1] == ">":
            if lt > begun:
                yield "text", html[begun:lt], "", lt
            at = begun = m.end() + 1
            to = yield ("close" if m[1] else "open"), m[2].lower(), m[3], at
            if to is not None:
                at = begun = to
        else:
            at = lt + 1
            spent += m.end() - lt
            if spent > allowed:
                pattern = PLAIN_TAG
    yield "text", html[begun:], "", len(html)


class Open:
    """The open elements, and where those of each name are."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {root.name: [0]}
        self.foreign = [""]  # the innermost of the elements that decide whether a closing slash counts

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)
        self.foreign.append(node.name if node.name in ("svg", "math", "foreignobject", "desc", "annotation-xml") else self.foreign[-1])

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()
            self.foreign.pop()

    def last(self, names) -> int:
        """Place of the innermost element of these names; the root and none are 0."""
        places = self.places
        return max([places[n][-1] for n in names if places.get(n)], default=0)

    def close(self, names: frozenset[str], within: frozenset[str]) -> None:
        """Closes the innermost element of the names, of cells and rows all of them, unless one of `within` is nearer."""
        while (at := self.last(names)) and at > self.last(within):
            self.cut(at)
            if not names & {"td", "th", "tr"}:
                return

    def add(self, child: Node) -> None:
        self.stack[-1].children.append(child)
        if child.name in ("td", "th", "tr"):
            for node in reversed(self.stack):
                if node.holds_cells or node.name in ("table", "caption"):
                    break
                node.holds_cells = True


def build(html: str) -> Node:
    """The tree of a page, implied tags closed."""
    root = Node("html", {})
    now = Open(root)
    found = tokens(html)
    to: int | None = None
    while True:
        try:
            kind, name, attrs, at = found.send(to) if to is not None else next(found)
        except StopIteration:
            return root
        to = None
        if kind == "text":
            if name:
                now.stack[-1].children.append(unescape(name))
            continue
        if kind == "close":
            if name == "br":
                now.add(Node("br", {}))
            elif name == "p" and not now.last(("p",)):
                now.add(Node("p", {}))
            elif (place := now.last((name,))) and (name in BEYOND or place >= now.last(SCOPES)):
                now.cut(place)
            continue
        if name in ("html", "body") and now.places.get(name):
            continue
        if name in BLOCK and name != "head" or name == "body":
            now.close(frozenset(["head"]), frozenset(["body"]))
        if name in ENDS_P:
            now.close(frozenset(["p"]), SCOPES | {"button"})
        if name in CLOSES:
            now.close(*CLOSES[name])
        elif _heading(name) and _heading(now.stack[-1].name):
            now.cut(len(now.stack) - 1)
        node = Node(name, attributes(attrs) if attrs.strip(" /\n\t") else {})
        now.add(node)
        if attrs.endswith("/") and (now.foreign[-1] in ("svg", "math") or name in ("svg", "math")) and not UNQUOTED.search(attrs):
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            body = html[at : end.start() if end else len(html)]
            node.children.append(unescape(body) if name in ("textarea", "title") else body)
            to = end.end() if end else len(html)
        elif name not in VOID:
            now.push(node)


def _heading(name: str) -> bool:
    return name[0] == "h" and name[1:].isdigit()


def visible(node: Node) -> bool:
    if node.name in HIDDEN:
        return False
    a = node.attrs
    if not a:
        return True
    return not ("hidden" in a or node.name == "input" or ("style" in a and INVISIBLE.search(a["style"])))


def width(s: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines of laid-out text. nested: cells around it; padding: what tables may still pad, shared by pages in cells."""

    def __init__(self, nested: int = 0, padding: list[int] | None = None) -> None:
        self.lines: list[str] = []
        self.flow: list[str] = []
        self.indent = ""
        self.bullet = ""
        self.gap = False
        self.nested, self.padding = nested, padding if padding is not None else [0]

    def say(self, s: str) -> None:
        self.flow.append(s)

    def end_line(self) -> None:
        """Ends the line that inline text is on, if there is any."""
        line = SPACES.sub(" ", "".join(self.flow)).strip(" ")
        self.flow.clear()
        if line:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        head = self.indent[: max(0, len(self.indent) - len(self.bullet))] + self.bullet if self.bullet else self.indent
        self.bullet = ""
        self.lines.append((head + line).rstrip())

    def space(self) -> None:
        self.end_line()
        self.gap = True


#: A step of the layout: it yields the steps inside it, so that no depth of the tree is one of the interpreter's.
Step = Iterator["Step"]


def run(step: Step) -> None:
    stack = [step]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def render(html: str | None) -> str:
    page = Page()
    if html:
        page.padding[0] = PADDING * len(html) + 10_000
        run(_children(build(html), page))
        page.end_line()
    return "\n".join(page.lines)


def _children(node: Node, page: Page) -> Step:
    for child in node.children:
        if isinstance(child, str):
            page.say(child)
        elif visible(child):
            yield _block(child, page)


def _block(node: Node, page: Page) -> Step:
    name = node.name
    if name not in BLOCK:
        yield _inline(node, page)
        return
    if name == "table":
        yield _table(node, page)
        return
    apart = name in SPACED and not (name in ("ul", "ol") and page.indent)
    page.space() if apart else page.end_line()
    if name in ("pre", "listing", "xmp"):
        for line in _plain(node).strip("\n").split("\n"):
            page.put(line.rstrip())
    elif name in ("ul", "ol", "menu", "dir"):
        yield _list(node, page)
    elif name in ("dd", "blockquote"):
        before = page.indent
        page.indent = (before + "  ")[:INDENT]
        yield _children(node, page)
        page.end_line()
        page.indent = before
    elif name == "hr":
        page.put("---")
    elif name == "details" and "open" not in node.attrs:
        for child in node.children:
            if isinstance(child, Node) and child.name == "summary":
                yield _block(child, page)
                break
    else:
        yield _children(node, page)
    page.space() if apart else page.end_line()


def _inline(node: Node, page: Page) -> Step:
    if node.name == "br":
        if any(x.strip() for x in page.flow):
            page.end_line()
        else:
            page.flow.clear()
    elif node.name == "img":
        if alt := node.attrs.get("alt", "").strip():
            page.say(f" {alt} ")
    elif node.name == "svg":
        yield _svg(node, page)
    elif node.name in MATH_PLACES:
        for child in node.children:
            page.say(" ")
            if isinstance(child, str):
                page.say(child)
            elif visible(child):
                yield _block(child, page)
        page.say(" ")
    elif node.name == "textarea":
        lines = _plain(node).split("\n")
        if len(lines) == 1:
            page.say(f" {lines[0]} ")
        else:
            page.end_line()
            for line in lines[not lines[0] :]:
                page.put(line.rstrip())
    elif node.name in ("optgroup", "option"):
        label = node.attrs.get("label", "").strip()
        page.say(f" {label} ")
        if node.name == "optgroup" or not label:
            yield _children(node, page)
        page.say(" ")
    elif node.name == "q":
        page.say("“")
        yield _children(node, page)
        page.say("”")
    elif node.name not in ("wbr", "col", "colgroup"):
        yield _children(node, page)


def _drawn(node: Node) -> bool:
    return node.name not in SVG_HIDDEN and visible(node) and node.attrs.get("display") != "none" and node.attrs.get("visibility") not in ("hidden", "collapse")


def _svg(node: Node, page: Page) -> Step:
    """The text of a drawing; each text element is apart from the others."""
    for child in node.children:
        if isinstance(child, Node) and _drawn(child):
            if child.name in SVG_TEXT:
                page.say(" ")
                yield _svg_text(child, page) if child.name == "text" else _children(child, page)
                page.say(" ")
            else:
                yield _svg(child, page)


def _svg_text(node: Node, page: Page) -> Step:
    for child in node.children:
        if isinstance(child, str):
            page.say(child)
        elif _drawn(child):
            yield _svg_text(child, page)


def _list(node: Node, page: Page) -> Step:
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start := node.attrs.get("start", "1")) else 1
    for child in node.children:
        if isinstance(child, Node) and visible(child):
            if child.name == "li":
                page.end_line()
                if node.name == "ol" and re.fullmatch(r"-?\d{1,9}", value := child.attrs.get("value", "")):
                    number = int(value)
                mark = f"{number}. " if node.name == "ol" else "- "
                number += 1
                before = page.indent
                page.indent, page.bullet = (before + " " * len(mark))[: max(INDENT, len(mark))], mark
                yield _children(child, page)
                page.end_line()
                page.indent, page.bullet = before, ""
            else:
                yield _block(child, page)
        elif isinstance(child, str):
            page.say(child)


def _plain(node: Node) -> str:
    parts: list[str] = []
    left: list[Node | str] = node.children[::-1]
    while left:
        child = left.pop()
        if isinstance(child, str):
            parts.append(child)
        elif child.name == "br":
            parts.append("\n")
        elif not visible(child):
            continue
        elif child.name == "svg":
            inner = Page()
            run(_svg(child, inner))
            inner.end_line()
            parts.append(" ".join(inner.lines))
        else:
            left.extend(reversed(child.children))
    return "".join(parts).replace("\r\n", "\n").expandtabs(8)


def _span(attrs: dict[str, str], name: str) -> int:
    value = attrs.get(name, "1").strip()
    return max(1, min(1000, int(value))) if value.isdecimal() and len(value) < 10 else 1


#: A row of a table: the column and the lines of each of its cells.
Row = list[tuple[int, list[str]]]


def _table(node: Node, page: Page) -> Step:
    page.space()
    grid: list[Row] = []
    spans: list[list[int]] = []  # cells from above: first column, column after the last, rows that they still cover

    def row(cells: list[Node]) -> Step:
        if page.nested >= NESTED:
            for cell in cells:
                page.end_line()
                yield _children(cell, page)
            page.end_line()
            return
        found: Row = []
        at, later = 0, []
        for cell in cells:
            while (over := next((s for s in spans if s[0] <= at < s[1]), None)) is not None:
                at = over[1]
            inner = Page(page.nested + 1, page.padding)
            yield _children(cell, inner)
            inner.end_line()
            found.append((at, [x for x in inner.lines if x] or [""]))
            across, down = _span(cell.attrs, "colspan"), _span(cell.attrs, "rowspan")
            if down > 1 and len(spans) + len(later) < SPANS:
                later.append([at, at + across, down])
            at += across
        spans.extend(later)
        for s in spans:
            s[2] -= 1
        spans[:] = [s for s in spans if s[2] > 0]
        grid.append(found)

    def cells(part: Node, found: list[Node]) -> Step:
        """The cells of a row, also those that other elements wrap. What else the row holds goes before the table."""
        for child in part.children:
            if isinstance(child, str):
                page.say(child)
            elif visible(child):
                if child.name in ("td", "th"):
                    found.append(child)
                elif child.name not in ("table", "caption") and child.holds_cells:
                    yield cells(child, found)
                else:
                    yield _block(child, page)

    def walk(part: Node) -> Step:
        for child in part.children:
            if isinstance(child, str):
                page.say(child)
            elif visible(child):
                if child.name == "tr":
                    own: list[Node] = []
                    yield cells(child, own)
                    yield row(own)
                elif child.name in ("td", "th"):
                    yield row([child])
                elif child.name in ("thead", "tbody", "tfoot") or child.name not in ("table", "caption") and child.holds_cells:
                    yield walk(child)
                elif child.name not in ("col", "colgroup"):
                    yield _block(child, page)

    yield walk(node)
    page.end_line()
    for line in aligned(grid, page.padding):
        page.put(line)
    page.space()


def aligned(grid: list[Row], padding: list[int]) -> Iterator[str]:
    """The lines of a table. padding: how many characters of padding are left; what it takes is subtracted."""
    columns = sorted({c for r in grid for c, _ in r})
    if len(columns) == 1:
        yield from (x for r in grid for _, lines in r for x in lines)
        return
    rank = {c: i for i, c in enumerate(columns)}
    wide = [0] * len(columns)
    for r in grid:
        for c, lines in r:
            wide[rank[c]] = max(wide[rank[c]], max((n for x in lines if (n := width(x)) <= WIDEST), default=0))
    begins = [0]  # of columns, with the marks between them
    for w in wide:
        begins.append(begins[-1] + w + 3)
    rows = [list(_lines([(rank[c], lines) for c, lines in r])) for r in grid]
    needed = begins[-1] + sum(begins[line[-1][0]] for lines in rows for line in lines if line)
    if needed > padding[0]:
        yield from (" | ".join(x for _, x in line) for lines in rows for line in lines)
        return
    padding[0] -= needed
    ruler = "".join(" " * w + " | " for w in wide)
    for lines in rows:
        for line in lines:
            parts, done = [], 0  # columns that are written
            for k, x in line:
                parts += [ruler[begins[done] : begins[k]], x, " " * (wide[k] - width(x)), " | "]
                done = k + 1
            yield "".join(parts[:-2])


def _lines(cells: Row) -> Iterator[Row]:
    """Line by line, the cells that have text on it."""
    n = 0
    live = cells
    while live:
        yield [(k, lines[n]) for k, lines in live if lines[n]]
        n += 1
        live = [x for x in live if len(x[1]) > n]


def extract(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text (all visible text, laid out), n_lines, n_chars, text_sha256 for every row of df."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, page in found:
            text = render(page)
            yield k, text, text.count("\n") + 1 if text else 0, len(text), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

    return map_rows(df.select(F.col(key), F.col(html)), rows, f"{key} bigint, text string, n_lines bigint, n_chars bigint, text_sha256 string")
