"""HTML extraction: visible text in reading layout."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import long_rows

#: Fixed values of HTML: elements by their role in the layout.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp plaintext".split())
#: Of these, what browsers show.
PLAIN = frozenset("textarea xmp plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist rp".split())
#: Within drawings and formulas: what is not drawn where it stands, and what stands apart from its neighbours.
FOREIGN = frozenset("svg math".split())
UNDRAWN = frozenset("title desc metadata defs symbol clippath mask marker pattern annotation annotation-xml mphantom".split())
APART = frozenset("text mi mn mo ms mtext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer form header html legend li main nav section summary tr caption thead tbody tfoot select optgroup option".split())
#: An opening tag closes these first, up to the nearest of the elements that bound it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "caption": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
#: A closing tag does not reach beyond these; those of a table and of its rows reach beyond cells.
SCOPE = ("table", "td", "th")
REACH = {"table": ()} | dict.fromkeys("tr tbody thead tfoot".split(), ("table",))
#: Attributes as HTML reads them: a quote opens a value only right behind "=", anywhere else it is a character like others.
ATTRIBUTES = r"""(?>[ \t\n\r\f/]+|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^ \t\n\r\f>"'][^ \t\n\r\f>]*|(?=>|\Z)))?)*+"""
#: Comments, which "<!-->", "<!--->", "-->" and "--!>" end; what HTML takes for comments; tags.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</>|</[^A-Za-z>][^>]*>?|<(/?)([A-Za-z][^ \t\n\r\f/>]*)(" + ATTRIBUTES + r")(?:>|\Z)", re.S)
#: Attributes without any of these hide nothing.
HIDING = re.compile("hidden|style", re.I)
ATTR = re.compile(r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*)(?:[ \t\n\r\f]*=[ \t\n\r\f]*("[^"]*"|'[^']*'|[^ \t\n\r\f>]+))?""")
#: What separates no declarations of a style: comments, strings, arguments.
ENCLOSED = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*"|'[^']*'|\([^()]*\)""", re.S)
SELF_CLOSED = re.compile(r"""(?:^|[ \t\n\r\f"']|=[ \t\n\r\f]*(?:"[^"]*"|'[^']*')|(?:^|[ \t\n\r\f/"'])[^ \t\n\r\f/>="']+)/$""")
NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?\d{1,9})", re.A)
SPACE = " \t\n\r\f"
#: Greatest spans of cells; and characters up to which a column, and a line's columns together, are padded: one long cell widens no other row.
MOST_COLUMNS, MOST_ROWS, PAD, LINE = 1000, 65534, 200, 1000
#: Levels up to which lists and quotes are indented: the lines of ever deeper ones would grow with the square of the page.
MOST_INDENT = 50


@cache
def closing(tag: str) -> re.Pattern:
    return re.compile("</" + re.escape(tag), re.I | re.A)


def attributes(source: str) -> dict[str, str]:
    """Names in small letters and values; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(source):
        value = m[2] or ""
        value = value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0] else value
        out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return out


def visibility(source: str) -> tuple[bool, bool | None]:
    """Whether attributes take an element out of the layout, and whether they veil its text (None: as around it)."""
    if not HIDING.search(source):
        return False, None
    named, style = attributes(source), {}
    for part in ENCLOSED.sub("", named.get("style", "")).split(";"):
        key, _, value = part.partition(":")
        value, mark, _ = value.strip().lower().partition("!")
        key = key.strip().lower()
        if value and (mark or not style.get(key, ("", ""))[1]):
            style[key] = (value.strip(), mark)
    display, seen = style.get("display", ("", ""))[0], style.get("visibility", ("", ""))[0]
    gone = display == "none" if display and not display.startswith("revert") else "hidden" in named
    return gone, True if seen in ("hidden", "collapse") else False if seen in ("visible", "initial") else None


class Numbers:
    """The numbers of a list's items. Those of a reversed one without a start are known at its end: until then they count from 0 down."""

    def __init__(self, named: dict[str, str]):
        start = NUMBER.match(named.get("start", ""))
        self.step = -1 if "reversed" in named else 1
        self.from_end = self.step < 0 and not start
        self.next = int(start[1]) if start else 0 if self.from_end else 1
        self.now = 0
        self.items, self.places = 0, []

    def item(self, value: str | None) -> int | None:
        """The number of the next item, None if it is known later."""
        self.items += 1
        if own := NUMBER.match(value or ""):
            self.next, self.from_end = int(own[1]), False
        late = self.from_end
        self.now, self.next = self.next, self.next + self.step
        return None if late else self.now

    def end(self) -> None:
        for out, at, mark, now in self.places:
            out[at] = f"{mark}{self.items + now}. "


class Page:
    """Lines of text being laid out: pending spacing is written before the next visible text."""

    def __init__(self):
        self.out: list[str] = []
        self.line, self.space, self.depth, self.mark = 0, False, 0, ""
        self.item: Numbers | None = None  # whose number the mark is to get

    @property
    def indent(self) -> str:
        return "  " * min(self.depth, MOST_INDENT)

    @property
    def outer(self) -> str:
        """The indent around the innermost list."""
        return "  " * min(self.depth - 1, MOST_INDENT)

    def block(self, lines: int) -> None:
        self.line, self.space = max(self.line, lines), False

    def lead(self) -> None:
        if self.line and self.out:
            self.out.append("\n" * self.line)
        if self.line or not self.out:
            if self.item:
                self.item.places.append((self.out, len(self.out), self.mark, self.item.now))
            self.out.append(self.mark or self.indent)
            self.mark, self.space, self.item = "", False, None
        elif self.space:
            self.out.append(" ")
        self.line, self.space = 0, False

    def text(self, s: str) -> None:
        words = s.split() if "\xa0" not in s else [w for w in re.split(r"[ \t\n\r\f]+", s) if w]
        if not words:
            self.space = self.space or bool(s)
            return
        if s[0] in SPACE:
            self.space = True
        self.lead()
        self.out.append(" ".join(words))
        self.space = s[-1] in SPACE

    def verbatim(self, s: str) -> None:
        if s:
            self.lead()
            self.out.append(s.replace("\n", "\n" + self.indent))

    def done(self) -> str:
        return "".join(self.out)


def span(value: str | None, most: int) -> int:
    """A number of columns or rows that a cell takes; 0 is as many as there are."""
    digits = re.match(r"\s*\+?(\d{1,9})", value or "1", re.A)
    number = int(digits[1]) if digits else 1
    return min(number or most, most)


def grid(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of cells (text, columns, rows) as lines, each column as wide as its widest line.

    A cell of several columns begins with the first; one of several rows stands in the first
    and keeps its place free in the others.
    """
    placed, below = [], []
    for r in filter(None, rows):
        taken, at, line, long = sorted((x, y) for x, y, _ in below), 0, [], []
        i = 0
        for text, wide, tall in r:
            while i < len(taken) and taken[i][0] <= at:
                at, i = max(at, taken[i][1]), i + 1
            line.append((at, at + wide, text.split("\n")))
            if tall > 1:
                long.append((at, at + wide, tall))
            at += wide
        placed.append(line)
        below = [(x, y, n - 1) for x, y, n in below + long if n > 1]
    # Only columns in which some cell begins count.
    begins = sorted({x for line in placed for x, _, _ in line})
    placed = [[(bisect_left(begins, x), bisect_left(begins, y), c) for x, y, c in line] for line in placed]
    width = [0] * len(begins)
    for x, y, c in sorted((cell for line in placed for cell in line), key=lambda cell: cell[1] - cell[0]):
        w = min(PAD, max(map(len, c)))
        width[y - 1] += max(0, w - sum(width[x:y]) - 2 * (y - x - 1))
    start = [0, *accumulate(w + 2 for w in width)]
    lines = []
    for line in placed:
        for k in range(max(len(c) for _, _, c in line)):
            s = ""
            for x, _, c in line:
                if t := c[k] if k < len(c) else "":
                    at = min(LINE, start[x])
                    s = (s + "  " if s and len(s) + 2 > at else s.ljust(at)) + t
            lines.append(s.rstrip())
    return lines


def render(source: str) -> str:
    """All visible text of a page.

    Tags open and close elements on a stack, with those that HTML implies. Text in hidden
    elements is left out: by their kind, the attribute ``hidden`` or their own style. Blocks
    begin on lines of their own, paragraphs, headings, lists, tables and quotes with an empty line between; list items carry "- " or their number,
    indented by depth; the cells of a table stand in aligned columns, spans counted. Text in a
    table but in no cell stands before its rows, where browsers show it. The options of a
    choice are lines of their own. Tags are read by HTML's states, so a stray quote is part of a
    name or value and takes no text with it; a tag or comment that the page breaks off in holds
    its rest; a ``dialog`` is seen if it is open. Values of input fields are no text of the page. A tag costs
    the same however deep it stands, and padding and indents are bounded, so work and output grow in
    proportion to the page.
    """
    page, stack, at, hidden = Page(), [], 0, 0
    lists: list[Numbers | None] = []  # of the open lists, those that count
    tables: list[tuple[Page, list[list[tuple[str, int, int]]], list[str]]] = []  # the page around, rows, texts in no cell
    cells: list[list[tuple[int, int]]] = []  # spans of the open cells of each table
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    pre = foreign = 0

    def nearest(tags) -> int:
        """The place of the last open one of these elements, or -1."""
        place = -1
        for t in tags:
            if (own := opened[t]) and own[-1] > place:
                place = own[-1]
        return place

    def veil() -> bool:
        return bool(stack) and stack[-1][2]

    def stray() -> None:
        """Keep what the current table has in no cell."""
        if text := page.done().strip("\n"):
            tables[-1][2].append(text)

    def leave() -> None:
        nonlocal page, hidden, pre, foreign
        tag, unseen, _ = stack.pop()
        opened[tag].pop()
        foreign -= tag in FOREIGN
        hidden -= unseen
        if unseen or hidden:
            return
        if tag in ("td", "th", "caption") and tables:
            spans = cells[-1].pop()
            text = page.done()
            if tag == "caption" or not tables[-1][1]:
                tables[-1][1].append([])
            tables[-1][1][-1].append((text, *spans))
            if tag == "caption":
                tables[-1][1].append([])
            page = Page()
        elif tag == "table":
            stray()
            cells.pop()
            page, rows, lines = tables.pop()
            lines += grid(rows)
            if lines:
                page.block(2)
                page.verbatim("\n".join(lines))
            page.block(2)
        elif tag in ("ul", "ol") and lists:
            if numbers := lists.pop():
                numbers.end()
            page.depth -= 1
            page.block(1 if lists else 2)
        elif tag == "pre":
            pre -= 1
            page.block(2)
        elif tag == "blockquote":
            page.depth -= 1
            page.block(2)
        elif foreign and tag in APART:
            page.space = True
        elif tag in BLOCKS:
            page.block(2 if tag in SPACED else 1)

    def enter(tag: str, attrs: str) -> None:
        nonlocal page, hidden, pre, foreign
        unseen, veiled = visibility(attrs)
        unseen = unseen or tag in HIDDEN or (foreign > 0 and tag in UNDRAWN) or (tag == "dialog" and "open" not in attributes(attrs))
        opened[tag].append(len(stack))
        stack.append((tag, unseen, veil() if veiled is None else veiled))
        foreign += tag in FOREIGN
        hidden += unseen
        if hidden:
            return
        if tag == "table":
            page.block(2)
            tables.append((page, [], []))
            cells.append([])
            page = Page()
        elif tag == "tr" and tables:
            tables[-1][1].append([])
        elif tag in ("td", "th", "caption") and tables:
            named = attributes(attrs) if "span" in attrs.lower() else {}
            cells[-1].append((MOST_COLUMNS, 1) if tag == "caption" else (min(MOST_COLUMNS, span(named.get("colspan"), MOST_COLUMNS)), span(named.get("rowspan"), MOST_ROWS)))
            stray()
            page = Page()
        elif tag in ("ul", "ol"):
            page.block(1 if lists else 2)
            lists.append(Numbers(attributes(attrs)) if tag == "ol" else None)
            page.depth += 1
        elif tag == "li":
            page.block(1)
            own = lists[-1] if lists else None
            page.mark, page.item = page.outer if lists else page.indent, None
            if own is None:
                page.mark += "- "
            elif (number := own.item(attributes(attrs).get("value"))) is None:
                page.item = own
            else:
                page.mark += f"{number}. "
        elif tag == "pre":
            pre += 1
            page.block(2)
        elif tag == "blockquote":
            page.block(2)
            page.depth += 1
        elif foreign and tag in APART:
            page.space = True
        elif tag in BLOCKS:
            page.block(2 if tag in SPACED else 1)

    def say(s: str) -> None:
        if s and not hidden and not veil():
            if cells and not cells[-1] and not s.strip(SPACE):
                page.space = page.space or bool(page.out)
                return
            s = html.unescape(s) if "&" in s else s
            page.verbatim(s) if pre else page.text(s)

    def plain(tag: str, attrs: str, s: str) -> None:
        """What a text field or an example holds: no tags, blanks as they are."""
        unseen, veiled = visibility(attrs)
        s = html.unescape(s) if tag == "textarea" else s
        if s.strip() and not hidden and not unseen and not (veil() if veiled is None else veiled):
            s = s.removeprefix("\r").removeprefix("\n") if tag == "textarea" else s
            apart = tag != "textarea" or "\n" in s
            if apart:
                page.block(1)
            else:
                page.space = True
            page.verbatim(s)
            if apart:
                page.block(1)
            else:
                page.space = True

    while m := TOKEN.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if foreign and m[0].startswith("<![CDATA["):
                end = source.find("]]>", m.start())
                end = len(source) if end < 0 else end
                say(source[m.start() + 9 : end].replace("&", "&amp;"))
                at = end + 3
            continue
        tag = m[2].lower()
        if m[1]:
            own = opened[tag]
            if not own:
                if tag == "br" or tag == "p":
                    page.block(1 if tag == "br" else 2)
            elif own[-1] >= nearest(REACH.get(tag, SCOPE)):
                i = own[-1]
                while len(stack) > i:
                    leave()
            continue
        if tag in CLOSES:
            closed, bound = CLOSES[tag]
            while (i := nearest(closed)) > nearest(bound):
                while len(stack) > i:
                    leave()
        elif tag in BLOCKS and stack and stack[-1][0] == "p":
            leave()
        if stack and stack[-1][0] == "head" and tag not in RAW - PLAIN and tag not in VOID and tag != "head":
            leave()
        if tag == "br":
            if not hidden:
                page.verbatim("\n") if pre else page.block(page.line + 1 if page.line < 2 else 2)
        elif tag in VOID:
            if tag == "hr" and not hidden:
                page.block(2)
        elif (foreign or tag in FOREIGN) and m[3].endswith("/") and SELF_CLOSED.search(m[3]):
            continue
        elif tag in RAW and not (foreign and tag in UNDRAWN):
            end = closing(tag).search(source, at) if tag != "plaintext" else None  # nothing ends that one
            end = end.start() if end else len(source)
            if tag in PLAIN:
                plain(tag, m[3], source[at:end])
            at = len(source) if end == len(source) else (source.find(">", end) + 1 or len(source))
        else:
            enter(tag, m[3])
    say(source[at:])
    while stack:
        leave()
    return page.done().strip("\n")


def extract(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with a column ``out`` in place of ``column``: the visible text of the HTML.

    Null stays null, empty gives empty; text that is no HTML is laid out as it is. Unclosed
    and misnested tags are closed as a browser would. Other columns and repeated rows stay.
    """
    base = long_rows(pages.drop(out) if out != column else pages)
    keep = [c for c in base.columns if c != column]
    schema = base.select(*keep).schema.add(out, "string") if keep else None

    def run(batches):
        for batch in batches:
            text = pa.array([None if h is None else render(h) for h in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), text], names=[*keep, out])

    return base.mapInArrow(run, schema)
