"""HTML extraction by layout-aware rendering."""

from __future__ import annotations

import bisect
import html as entities
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import small_batches, stored, table

# Fixed values of the HTML standard: void elements, blocks, hidden elements, raw text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul caption".split())
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas audio video datalist title meta link noembed noframes rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote figure table fieldset details".split())
# Start tag -> open elements that it ends, and the elements that the search for them doesn't leave.
_CELLS = frozenset({"td", "th"})
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", *_CELLS, "caption", "colgroup"}, {"table"}),
    "td": (_CELLS, {"tr", "table"}),
    "th": (_CELLS, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", *_CELLS, "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", *_CELLS, "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", *_CELLS, "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
# Starting one of these ends an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
_STAY = frozenset({"table", "td", "th", "caption", "button", "object", "html", "template"})
#: Open elements; browsers, too, nest no further: what comes then stands beside the deepest element.
DEEPEST = 512
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DISPLAY, _VISIBILITY = (re.compile(rf"(?:^|;)\s*{name}\s*:\s*([a-z-]+)", re.I) for name in ("display", "visibility"))


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class _Tree(HTMLParser):
    """Nodes nested as a browser nests them, as far as implied and unmatched tags go."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def _end(self, tags, stay) -> None:
        """Ends the innermost open element of ``tags`` and what it holds, unless one of ``stay`` is open inside it."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in stay:
                return
            if self.open[k].tag in tags:
                del self.open[k:]
                return

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "html":
            return
        if tag in IMPLIED:
            tags, stay = IMPLIED[tag]
            for _ in range(3 if "tr" in tags else 1):
                self._end(tags, stay)
        if tag in ENDS_P:
            self._end({"p"}, _STAY)
        if tag in BLOCKS and tag != "body":
            self._end({"head"}, set())
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing but on void elements

    def handle_endtag(self, tag) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        elif tag not in VOID and tag not in ("html", "body"):
            self._end({tag}, {"td", "th", "table"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})

    def handle_data(self, data) -> None:
        self.open[-1].children.append(data)


def _declared(attrs: dict[str, str | None], name: re.Pattern) -> str | None:
    """The last value that an element's style gives to a property."""
    found = name.findall(attrs.get("style") or "")
    return found[-1].lower() if found else None


def without_invisible(root: Node) -> None:
    """Takes out the text of invisible elements. Visibility is inherited, and an element inside an invisible one may be visible;
    elements that are not displayed are gone with all that they hold, which ``hidden`` tells."""
    todo = [(root, True)]
    while todo:
        node, seen = todo.pop()
        kept = []
        for c in node.children:
            if isinstance(c, str):
                if seen:
                    kept.append(c)
                continue
            own = _declared(c.attrs, _VISIBILITY)
            shown = seen if own in (None, "inherit", "unset") else own not in ("hidden", "collapse")
            if not shown:
                c.attrs.pop("alt", None)
            todo.append((c, shown))
            kept.append(c)
        node.children = kept


def hidden(node: Node) -> bool:
    a = node.attrs
    return (
        node.tag in HIDDEN
        or "hidden" in a
        or node.tag == "input" and (a.get("type") or "").lower() == "hidden"
        or _declared(a, _DISPLAY) == "none"
        or node.tag == "dialog" and "open" not in a
    )


def width_of(text: str) -> int:
    """Columns a text takes: wide characters two, combining marks none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Lines:
    """Finished lines, the open one, and how many line ends must come before more text."""

    def __init__(self) -> None:
        self.lines, self.line, self.gap, self.space, self.prefix = [], "", 0, False, ""

    def need(self, ends: int) -> None:
        if self.line:
            self.lines.append(self.line.rstrip())
            self.line = ""
        self.gap, self.space = max(self.gap, ends), False

    def text(self, data: str) -> None:
        flat = _SPACE.sub(" ", data)
        if flat.startswith(" "):
            self.space = True
        words = flat.strip(" ")
        if words:
            self._open()
            self.line += (" " if self.space and self.line and not self.line.endswith(" ") else "") + words
            self.space = flat.endswith(" ")

    def _open(self) -> None:
        if not self.line:
            if self.lines and self.gap > 1 and self.lines[-1]:
                self.lines.append("")
            self.gap, self.line, self.prefix = 0, self.prefix, ""

    def br(self) -> None:
        self._open()
        self.lines.append(self.line.rstrip())
        self.line, self.space = "", False

    def raw(self, rows: list[str]) -> None:
        for row in rows:
            self._open()
            self.lines.append((self.line + row).rstrip())
            self.line = ""
        self.space = False

    def done(self) -> list[str]:
        self.need(1)
        return self.lines


def _plain(node: Node) -> str:
    """All visible text of a node as it stands, for preformatted text."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "br":
            out.append("\n")
        elif not hidden(n):
            todo += reversed(n.children)
    return "".join(out)


def _steps(first: Iterator) -> list[str]:
    """Runs a renderer; each yields the renderers of the parts it needs. Depth costs memory, not stack."""
    stack, got = [first], None
    while True:
        try:
            stack.append(stack[-1].send(got))
            got = None
        except StopIteration as e:
            stack.pop()
            got = e.value
            if not stack:
                return got


def _indented(mark: str, lines: list[str], depth: int) -> list[str]:
    """Deeper levels than INDENTED keep their marks but move no further to the right."""
    pad = " " * len(mark) if depth <= INDENTED else ""
    return [mark + lines[0], *(pad + x if x else "" for x in lines[1:])] if lines else [mark.rstrip()]


def _number(cell: Node, name: str, most: int) -> int:
    found = re.match(r"\s*(\d{1,5})", cell.attrs.get(name) or "")
    return min(most, max(1, int(found[1]))) if found else 1


def _preset(cell: Node) -> bool:
    """Whether a cell holds lines whose blanks mean something: a table of its own, or preformatted text."""
    todo = [cell]
    while todo:
        n = todo.pop()
        if n.tag in ("table", "pre", "textarea"):
            return True
        todo += [c for c in n.children if isinstance(c, Node)]
    return False


def _wrapped(line: str) -> list[str]:
    """A line in parts of CELL columns, cut at blanks."""
    if width_of(line) <= CELL:
        return [line]
    out, now, width = [], [], 0
    for word in line.split(" "):
        w = width_of(word)
        if now and width + 1 + w > CELL:
            out.append(" ".join(now))
            now, width = [], -1
        now.append(word)
        width += w + (1 if len(now) > 1 or width < 0 else 0)
    return [*out, " ".join(now)]


def _overlaid(old: list[tuple[int, int, int]], new: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint intervals in order: the new ones, and what they leave of the old; neighbours that end together are one."""
    parts, k = [], 0
    for a, b, until in old:
        while k < len(new) and new[k][1] <= a:
            k += 1
        at, j = a, k
        while j < len(new) and new[j][0] < b:
            if new[j][0] > at:
                parts.append((at, new[j][0], until))
            at = max(at, new[j][1])
            j += 1
        if at < b:
            parts.append((at, b, until))
    out: list[tuple[int, int, int]] = []
    for x in sorted(parts + new):
        if out and out[-1][1] == x[0] and out[-1][2] == x[2]:
            out[-1] = (out[-1][0], x[1], x[2])
        else:
            out.append(x)
    return out


def _table(node: Node, depth: int) -> Iterator:
    """Rows with cells side by side, each column as wide as its widest line; cells of several lines take several rows.

    Lines of a cell are wrapped between words where they are longer than CELL columns, so that one long cell leaves the others
    aligned; a word that is longer stays whole, and so do lines of cells that hold a table or preformatted text. Cells that begin beyond LINE columns stand side by side with two blanks between. So
    a row takes LINE columns more than its text at most. Rows that a cell reaches down into are those of the table; reaches are
    kept as intervals of columns, neighbours that end together as one.
    """
    rows, captions, todo = [], [], list(reversed(node.children))
    loose: list = []
    while todo:
        n = todo.pop()
        if isinstance(n, str) or n.tag not in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption"):
            if isinstance(n, Node) or n.strip():
                loose.append(n)
            continue
        if hidden(n):
            continue
        if n.tag == "caption":
            captions += yield _block(n, depth + 1)
        elif n.tag in ("td", "th"):
            rows.append([n])
        elif n.tag == "tr":
            rows.append([c for c in n.children if isinstance(c, Node) and c.tag in _CELLS and not hidden(c)])
            loose += [c for c in n.children if not (isinstance(c, Node) and c.tag in _CELLS) and (isinstance(c, Node) or c.strip())]
        else:
            todo += reversed(n.children)
    out = captions
    if loose:
        stray = Node("div")
        stray.children = loose
        out = out + (yield _block(stray, depth + 1))
    grid, taken = [], []  # (column, span, lines) by row; intervals (first, end, last row) of columns that cells above reach into
    rows = [row for row in rows if row]
    for r, row in enumerate(rows):
        made, at, k, reach = [], 0, 0, []
        for c in row:
            while k < len(taken) and taken[k][0] <= at:
                at = max(at, taken[k][1])
                k += 1
            span, down = _number(c, "colspan", 1000), _number(c, "rowspan", 65_534)
            lines = (yield _block(c, depth + 1)) or [""]
            if max(map(len, lines)) * 2 > CELL and not _preset(c):
                lines = [part for x in lines for part in _wrapped(x)]
            made.append((at, span, lines))
            if down > 1 and r + 1 < len(rows):
                reach.append((at, at + span, min(r + down, len(rows)) - 1))
            at += span
        taken = _overlaid([x for x in taken if x[2] > r], reach)
        grid.append(made)
    widths: dict[int, int] = {}
    for row in grid:
        for at, span, lines in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(CELL, max(map(width_of, lines))))
    columns = sorted(widths)
    ends = dict(zip(columns, accumulate(widths[c] + 2 for c in columns)))
    place = lambda at: min(LINE, ends[columns[k - 1]]) if (k := bisect.bisect_left(columns, at)) else 0
    for row in grid:
        for k in range(max(len(lines) for *_, lines in row)):
            parts, width = [], 0
            for at, _, lines in row:
                cell = lines[k] if k < len(lines) else ""
                if cell:
                    gap = max(2 if width else 0, place(at) - width)
                    parts += [" " * gap, cell]
                    width += gap + width_of(cell)
            out.append("".join(parts).rstrip())
    return out


def _block(node: Node, depth: int) -> Iterator:
    out = _Lines()
    yield from _fill(node, out, depth)
    lines = out.done()
    first, last = 0, len(lines)
    while last > first and not lines[last - 1]:
        last -= 1
    while first < last and not lines[first]:
        first += 1
    return lines[first:last]


#: Levels of lists and quotes that are indented: deeper ones keep their marks and their lines, but move no further to the right.
INDENTED = 40
#: Columns of a table's cell before its lines are wrapped, and of a row up to which cells are aligned.
CELL, LINE = 60, 240


def _fill(root: Node, out: _Lines, depth: int) -> Iterator:
    """Depth first; items are nodes, strings, or a number of line ends to ask for."""
    todo: list = list(reversed(root.children))
    while todo:
        n = todo.pop()
        if isinstance(n, int):
            out.need(n)
        elif isinstance(n, str):
            out.text(n)
        elif n.tag == "br":
            out.br()
        elif hidden(n):
            continue
        elif n.tag == "hr":
            out.need(1)
        elif n.tag in ("img", "area"):
            if n.attrs.get("alt"):
                out.text(n.attrs["alt"])
        elif n.tag in ("pre", "textarea"):
            out.need(2)
            out.raw(_plain(n).removeprefix("\n").rstrip("\n").split("\n"))
            out.need(2)
        elif n.tag in ("table", "ul", "ol", "menu", "dir", "blockquote", "dd"):
            gap = 1 if n.tag == "dd" or depth and n.tag in ("ul", "ol", "menu", "dir") else 2
            out.need(gap)
            if n.tag == "table":
                out.raw((yield _table(n, depth)))
            elif n.tag in ("blockquote", "dd"):
                pad = "  " if depth <= INDENTED else ""
                out.raw([pad + x if x else "" for x in (yield _block(n, depth + 1))])
            else:
                out.raw((yield _list(n, depth)))
            out.need(gap)
        elif n.tag in BLOCKS:
            gap = 2 if n.tag in SPACED else 1
            out.need(gap)
            todo.append(gap)
            todo += reversed(n.children)
        else:
            todo += reversed(n.children)


def _list(node: Node, depth: int) -> Iterator:
    out = []
    start = node.attrs.get("start") or ""
    n = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for c in node.children:
        item = c if isinstance(c, Node) else Node("div")
        if isinstance(c, str):
            if not c.strip():
                continue
            item.children = [c]
        if hidden(item):
            continue
        if item.tag == "li":
            mark = f"{n}. " if node.tag == "ol" else "- "
            n += 1
            out += _indented(mark, (yield _block(item, depth + 1)), depth)
        else:
            holder = Node("div")
            holder.children = [item]
            pad = "  " if depth <= INDENTED else ""
            out += [pad + x if x else "" for x in (yield _block(holder, depth + 1))]
    return out


def render(html: str | None) -> str:
    """The visible text of a page: blocks on lines of their own, a blank line around paragraphs, headings, lists and tables,
    ``-`` or a number before list items, table cells in aligned columns. No visible text is dropped."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    if "visibility" in html.lower():
        without_invisible(tree.root)
    return "\n".join(_steps(_block(tree.root, 0)))


def title_of(html: str | None) -> str:
    found = re.search(r"<title[^>]*>(.*?)</title", html or "", re.I | re.S)
    return _SPACE.sub(" ", entities.unescape(found[1])).strip() if found else ""


def _render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield pd.DataFrame({"id": x["id"], "url": x["url"], "title": list(map(title_of, x["html"])), "text": list(map(render, x["html"]))})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, title, text. A null or empty page has empty title and text; ids may repeat or be null."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    with small_batches(pages.sparkSession):
        found = stored(rows.mapInPandas(_render, "id string, url string, title string, text string"), "page-texts")
    return found.withColumn("id", F.col("id").cast(kind)).withColumnsRenamed({"id": id_col, "url": url_col})


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
