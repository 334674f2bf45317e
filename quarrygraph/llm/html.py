"""Layout-aware HTML to text (operator 6).

A tree builder reads tags, closes elements whose end tags are implied, and renders as it goes:
inline white space collapses, blocks stand on their own lines with the blank lines that their
margins give, list items get bullets or numbers and are indented, pre keeps its spacing, and tables
are laid out in aligned columns with spanned cells. Visibility rules leave out head, script,
style, template and other elements that are never shown, hidden attributes, and inline display:none
and visibility:hidden. Of a select the chosen option is shown (all of them in a list box), of SVG what its
text elements and foreign objects hold, of MathML all but annotations. All other text is emitted. The open elements are a stack of our own, so
nesting of any depth is fine, and each page is read once, in time that grows with its length whatever it holds. Indentation stops at
INDENT columns; columns of a table in which no cell begins take no room.

Defined results: null or empty HTML gives empty text; broken markup is read as far as it goes; an
end tag without its start is ignored, except that </p> and </br> act as browsers have it; a < without a later > is text. Repeated rows stay.
Columns other than page_id, url and html are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^>"'<])*+|[^>]*+)>|[!?/][^>]*>)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"hidden|display|visibility|open|colspan|rowspan|start|value|type|alt", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style template noscript title datalist iframe object audio video canvas noframes noembed".split())
#: Never shown within SVG and MathML.
FOREIGN = {"svg": frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()), "math": frozenset(["annotation", "annotation-xml", "mphantom"])}
LABEL = ("text", "foreignobject")
#: Start tags that end SVG and MathML, if not within one of the second set.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = {"foreignobject", "annotation-xml", "desc", "title", "mi", "mo", "mn", "ms", "mtext"}
RAW = frozenset("script style title textarea noscript iframe noframes noembed xmp".split())
#: Blocks and the blank lines above and below them.
MARGIN = dict.fromkeys("address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html legend li main nav option search section summary caption".split(), 0)
MARGIN |= dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split(), 1)
CLOSES_P = frozenset(MARGIN) - {"body", "html", "legend", "option", "caption"}
#: Start tag -> elements that it closes, looked for up to one of the barriers.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "table"}), "body": ({"head"}, set()),
} | dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}))
_CELL = {"td", "th", "caption"}
INDENT = 200


class Writer:
    """Lines of one flow: a page's or a table cell's."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.indent, self.marker = "", ""

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if s[0] == " " and (not self.now or self.now[-1][-1:] in ("", " ")):
            s = s[1:]
        if s:
            self.now.append(s)

    def block(self, margin: int) -> None:
        line = "".join(self.now).rstrip(" ") if self.now else ""
        if line:
            self.put(line)
            self.now = []
        if margin > self.gap:
            self.gap = margin

    def put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(self.indent + self.marker + line)
        if self.marker:
            self.indent, self.marker = (self.indent + " " * len(self.marker))[:INDENT], ""

    def verbatim(self, s: str) -> None:
        first, *rest = s.split("\n")
        self.now.append(first)
        for line in rest:
            self.put("".join(self.now))
            self.now = [line]


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # column, span, lines
        self.taken: list[list[int]] = []  # columns from, to, and rows that cells above still take there
        self.new: list[list[int]] = []

    def row(self) -> None:
        self.rows.append([])
        self.column = 0
        above = sorted([a, b, n - 1] for a, b, n in self.taken + self.new if n > 1)
        self.taken, self.new = [], []
        for x in above:  # runs side by side are one
            if self.taken and self.taken[-1][1] == x[0] and self.taken[-1][2] == x[2]:
                self.taken[-1][1] = x[1]
            else:
                self.taken.append(x)
        self.ahead = self.taken[::-1]

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.ahead and self.ahead[-1][0] <= self.column:
            self.column = max(self.column, self.ahead.pop()[1])
        self.rows[-1].append((self.column, across, lines))
        if down > 1:
            self.new.append([self.column, self.column + across, down])
        self.column += across

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for c, across, lines in row:
                if across == 1:
                    width[c] = max(width.get(c, 0), max(map(len, lines), default=0))
        spot, at = {}, 0
        for c in sorted({c for row in self.rows for c, _, _ in row}):
            spot[c] = at
            at += width.get(c, 0) + 2
        out = []
        for row in self.rows:
            tall = sorted(((len(lines), spot[c], lines) for c, _, lines in row if lines), key=lambda x: (-x[0], x[1]))
            for k in range(tall[0][0] if tall else 0):
                while tall[-1][0] <= k:
                    tall.pop()
                parts, end, at = [], 0, 0  # where the text ends, and where the line does
                for _, begin, lines in sorted(tall, key=lambda x: x[1]):
                    if at > begin:
                        begin = max(begin, end + 2)
                    said, at = lines[k].rstrip(), begin + len(lines[k])
                    if said:
                        parts += [" " * (begin - end), said]
                        end = begin + len(said)
                out.append("".join(parts))
        return out


def _number(value: str | None, least: int, most: int, otherwise: int) -> int:
    try:
        return min(most, max(least, int(value)))
    except (TypeError, ValueError):
        return otherwise


class Renderer:
    def __init__(self):
        self.writer = Writer()
        #: tag, hidden, shown again inside hidden visibility, what to put back at its end
        self.stack: list[tuple[str, bool, bool, tuple]] = []
        self.hidden = self.unseen = False
        self.tables: list[Table] = []
        self.writers: list[Writer] = []
        self.lists: list[list] = []
        self.pre = 0
        self.count = {"tables": 0, "items": 0}
        self.open: dict[str, int] = {}
        self.where: dict[str, list[int]] = {}  # places in the stack
        #: of the open select: text, selected, disabled, hidden and whether it is a group's label
        self.choices: list[list] = []

    def text(self, s: str) -> None:
        if self.hidden or self.unseen or not s or self.open.get("svg") and not any(map(self.open.get, LABEL)):
            return
        if "&" in s:
            s = unescape(s)
        if self.pre:
            self.writer.verbatim(s)
        elif s:
            self.writer.text(s)

    def _close_up_to(self, tags: set[str], barrier: set[str]) -> None:
        last = max((self.where[t][-1] for t in tags if self.open.get(t)), default=-1)
        if last > max((self.where[t][-1] for t in barrier - tags if self.open.get(t)), default=-1):
            while len(self.stack) > last:
                self._pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in BREAKOUT:
            self._close_up_to(set(FOREIGN), HOLDS_HTML)
        if tag in CLOSES_P:
            self._close_up_to({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in IMPLIED:
            self._close_up_to(*IMPLIED[tag])
            if tag in ("thead", "tbody", "tfoot", "tr"):
                self._close_up_to({"td", "th"}, {"table"})
                self._close_up_to({"tr"}, {"table"})
        if tag in ("select", "input", "textarea"):
            self._close_up_to({"select"}, set())
        chosen = tag in ("option", "optgroup") and bool(self.open.get("select"))
        found = {}
        if attributes and (chosen or tag == "select" or _HIDING.search(attributes)):
            for name, a, b, c in _ATTR.findall(attributes):
                found.setdefault(name.lower(), a or b or c)
        style = found.get("style", "").lower().replace(" ", "") if found else ""
        hides = tag in NEVER or "hidden" in found or "display:none" in style or (tag == "dialog" and "open" not in found)
        foreign = next((k for k in FOREIGN if self.open.get(k)), "")
        hides = hides or bool(foreign) and tag in FOREIGN[foreign]
        if chosen:
            found["=off"], hides = hides, False
        unseen = self.unseen
        if "visibility:" in style:
            unseen = "visibility:hidden" in style or "visibility:collapse" in style
        hidden = self.hidden or hides
        if tag in VOID:
            if not hidden and not unseen:
                if tag == "br":
                    if self.writer.now:
                        self.writer.block(0)
                    elif self.writer.lines:
                        self.writer.gap += 1
                elif tag == "hr":
                    self.writer.block(1)
                    self.writer.put("---")
                    self.writer.gap = 1
                elif tag == "img" and found.get("alt"):
                    self.writer.text(unescape(found["alt"]))
                elif tag == "input" and found.get("value") and found.get("type", "text").lower() not in ("hidden", "checkbox", "radio", "password"):
                    self.writer.text(unescape(found["value"]))
            return
        undo: tuple = (self.hidden, self.unseen)
        if not hidden:
            undo += self._enter(tag, found)
        self.stack.append((tag, hidden, unseen, undo))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.where.setdefault(tag, []).append(len(self.stack) - 1)
        self.hidden, self.unseen = hidden, unseen
        if attributes.endswith("/") and (foreign or tag in FOREIGN):
            self._pop()

    def _enter(self, tag: str, found: dict) -> tuple:
        w = self.writer
        if tag == "select":
            saved = (w, self.lists, self.pre, self.choices, "multiple" in found or _number(found.get("size"), 1, 1000, 1) > 1)
            self.writer, self.lists, self.pre, self.choices = Writer(), [], 0, []
            return saved
        if "=off" in found:
            group = tag == "optgroup"
            self.choices.append([unescape(found.get("label", "")), "selected" in found, "disabled" in found, found["=off"], group])
            if group:
                return ()
            self.writer = Writer()
            return (w, self.choices[-1])
        if tag in LABEL and self.open.get("svg"):
            w.text(" ")
            return ()
        if tag in _CELL and self.tables and self.writers:
            if tag == "caption":
                w.block(0)
                return ()
            if not self.tables[-1].rows:
                self.tables[-1].row()
            saved = (w, self.lists, self.pre)
            self.writer, self.lists, self.pre = Writer(), [], 0
            return (*saved, _number(found.get("colspan"), 1, 1000, 1), _number(found.get("rowspan"), 1, 65534, 1))
        if tag == "tr" and self.tables:
            self.tables[-1].row()
            return ()
        if tag not in MARGIN:
            if tag == "textarea":
                self.pre += 1
            return ()
        margin = MARGIN[tag]
        if tag in ("ul", "ol", "menu") and self.lists:
            margin = 0
        w.block(margin)
        if tag == "table":
            self.tables.append(Table())
            self.writers.append(w)
            self.count["tables"] += 1
        elif tag in ("ul", "ol", "menu"):
            self.lists.append([tag == "ol", _number(found.get("start"), -(10**9), 10**9, 1)])
        elif tag == "li":
            self.count["items"] += 1
            saved = (w.indent, w.marker)
            kind = self.lists[-1] if self.lists else [False, 1]
            if "value" in found:
                kind[1] = _number(found["value"], -(10**9), 10**9, kind[1])
            w.indent, w.marker = (w.indent + " " * len(w.marker))[:INDENT], f"{kind[1]}. " if kind[0] else "- "
            kind[1] += 1
            return saved
        elif tag in ("dd", "blockquote"):
            saved = (w.indent, w.marker)
            w.indent, w.marker = (w.indent + " " * len(w.marker) + "    ")[:INDENT], ""
            return saved
        elif tag in ("pre", "xmp"):
            self.pre += 1
        return ()

    def _pop(self) -> None:
        tag, hidden, _, (was_hidden, was_unseen, *saved) = self.stack.pop()
        self.open[tag] -= 1
        self.where[tag].pop()
        self.hidden, self.unseen = was_hidden, was_unseen
        if hidden:
            return
        w = self.writer
        if tag == "select":
            choices = self.choices
            self.writer, self.lists, self.pre, self.choices, every = saved
            if every:
                for label, _, _, off, _ in choices:
                    if label and not off:
                        self.writer.block(0)
                        self.writer.text(label)
                        self.writer.block(0)
                return
            options = [c for c in choices if not c[4]]
            shown = next((c for c in reversed(options) if c[1]), None) or next((c for c in options if not c[2]), None)
            if shown and shown[0]:
                self.writer.text(shown[0])
            return
        if tag == "option" and saved:
            w.block(0)
            self.writer, choice = saved
            choice[0] = choice[0] or " ".join(x.strip() for x in w.lines if x.strip())
            return
        if tag in LABEL and self.open.get("svg"):
            w.text(" ")
            return
        if tag in ("td", "th") and saved:
            w.block(0)
            self.writer, self.lists, self.pre, across, down = saved
            if self.tables:
                self.tables[-1].cell(w.lines, across, down)
            return
        if tag == "textarea":
            self.pre -= 1
        if tag not in MARGIN:
            return
        margin = MARGIN[tag]
        if tag == "table":
            self.writers.pop()
            w.block(0)
            for line in self.tables.pop().lines():
                w.put(line)
        elif tag in ("ul", "ol", "menu"):
            if self.lists:
                self.lists.pop()
            margin = 0 if self.lists else 1
        elif tag in ("pre", "xmp"):
            self.pre -= 1
        w.block(margin)
        if tag in ("li", "dd", "blockquote") and saved:
            w.indent, w.marker = saved

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif self.open.get(tag):
            barrier = {"table", "td", "th"} if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") else {"table"} - {tag}
            self._close_up_to({tag}, barrier)
        elif tag == "p":
            self.start("p", "")
            self._pop()

    def finish(self) -> str:
        while self.stack:
            self._pop()
        self.writer.block(0)
        return "\n".join(x.rstrip() for x in self.writer.lines).replace("\xa0", " ")


def render(html: str | None) -> tuple[str, int, int]:
    """Visible text of a page, and its numbers of tables and list items."""
    r, at, n = Renderer(), 0, len(html or "")
    html = html or ""
    last = html.rfind(">") + 1  # no tag ends beyond
    while at < n:
        m = _TAG.search(html, at, last) if at < last else None
        if not m:
            stop = html.find("<!--", at)
            r.text(html[at : stop if stop >= 0 else n])
            break
        if m.start() > at:
            r.text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # a comment that never ends
            continue
        tag = m[2].lower()
        if m[1]:
            r.end(tag)
            continue
        r.start(tag, m[3])
        if tag in RAW and not (m[3].endswith("/") and any(map(r.open.get, FOREIGN))):
            close = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
            stop = close.start() if close else n
            r.text(html[at:stop])
            at = stop
    return r.finish(), r.count["tables"], r.count["items"]


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "html"):
        text, tables, items = zip(*map(render, b.column("html").to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(text), pa.array([len(t) for t in text]), pa.array(np.array(tables, np.int64)), pa.array(np.array(items, np.int64))],
            ["page_id", "url", "text", "n_chars", "n_tables", "n_items"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_tables and n_items of every page, without a shuffle."""
    wanted = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return wanted.mapInArrow(_render, "page_id long, url string, text string, n_chars long, n_tables long, n_items long")
