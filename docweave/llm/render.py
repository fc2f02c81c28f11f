"""Layout-aware rendering of HTML: all visible text, laid out as blocks, lists and tables.

A tokenizer feeds an explicit stack of open elements, which supplies implied start and end
tags; hidden subtrees are skipped; each box (document, list item, cell, quotation) gathers
lines and hands them to the box around it. Nothing recurses, so depth is unbounded.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.I)
#: Unlike display, children can set it back.
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)\s*(?:!important\s*)?(?=;|$)", re.I)
#: A slash that ends a tag, not an unquoted value.
_CLOSED = re.compile(r"(?<![^\s\"'/])/$|(?:^|\s)[^\s=]*/$")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to the end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never shown by a browser that runs scripts.
UNSEEN = frozenset(
    "head script style template noscript title iframe noembed noframes object canvas audio video datalist".split()
)
#: Inside of SVG and MathML: never shown in their place.
UNSEEN_IN = {
    "svg": frozenset("desc metadata defs symbol clippath mask marker pattern filter lineargradient radialgradient".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
#: Elements of MathML and SVG that hold HTML, and tags of HTML that end SVG and MathML.
HOLDS_HTML = frozenset("foreignobject mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby "
    "s small span strong strike sub sup table tt u ul var".split()
)
HEAD_PARTS = frozenset("title base link meta style script noscript template".split())
#: Blocks with an empty line around them, and blocks without.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr fieldset listing".split())
BLOCKS = SPACED | frozenset(
    "address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main nav optgroup "
    "option search section summary caption tr td th thead tbody tfoot".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("body html optgroup option caption tr td th thead tbody tfoot".split())
#: Start tag: (open elements it ends, elements at which the search stops).
_CELL = frozenset(["td", "th"])
_LISTS = frozenset("ul ol menu dl table td th body".split())
IMPLIED_END = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), _LISTS),
    "dd": (frozenset(["dt", "dd"]), _LISTS),
    "td": (_CELL, frozenset(["table"])),
    "th": (_CELL, frozenset(["table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "caption"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
#: End tags do not reach out of these.
SCOPES = frozenset("table td th caption html".split())
#: Lines of cells are wrapped at this width, so that padding stays in proportion.
WIDEST = 60
MOST_COLUMNS = 1000


class Box:
    """Lines gathered so far, and the line being written."""

    __slots__ = ("lines", "line", "gap", "open")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.open = False  # the line ends in a space or is empty

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.line.append(first)
            for more in rest:
                self.end_line(True)
                self.line.append(more)
            return
        s = _BLANKS.sub(" ", s)
        if (not self.line or self.line[-1].endswith(" ")) and s.startswith(" "):
            s = s[1:]
        if s:
            self.line.append(s)

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.extend(lines)

    def end_line(self, forced: bool = False) -> None:
        line = "".join(self.line).rstrip(" ")
        self.line = []
        if line or forced:
            self.put([line])

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    """Rows of cells with their spans; laid out when the table ends."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.caption: list[str] = []
        self.reserved: dict[int, int] = {}

    def row(self) -> None:
        self.rows.append([])
        self.reserved = {c: n - 1 for c, n in self.reserved.items() if n > 1}

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        column = row[-1][0] + row[-1][1] if row else 0
        while column in self.reserved:
            column += 1
        row.append((column, across, lines))
        if down > 1:
            for c in range(column, column + across):
                self.reserved[c] = down

    def layout(self) -> list[str]:
        """Aligned lines. Long lines are wrapped between words; a word wider than a column may
        be has its line to itself, and the cells to its right begin below it."""
        rows = [[(column, across, _wrapped(lines)) for column, across, lines in row] for row in self.rows]
        widths: dict[int, int] = {}
        for row in rows:
            for column, across, lines in row:
                if across == 1:
                    widest = max((len(x) for x in lines if len(x) <= WIDEST), default=0)
                    widths[column] = max(widths.get(column, 0), widest)
        out = list(self.caption)
        for row in rows:
            begins, below = [], 0
            for _, _, lines in row:
                begins.append(below)
                below += max((k + 1 for k, x in enumerate(lines) if len(x) > WIDEST), default=0)
            for k in range(max((b + len(lines) for b, (_, _, lines) in zip(begins, row, strict=True)), default=0)):
                parts, have, at, column = [], 0, 0, 0
                for begin, (start, _, lines) in zip(begins, row, strict=True):
                    at += sum(widths.get(c, 0) + 2 for c in range(column, start))
                    column = start
                    if 0 <= k - begin < len(lines) and lines[k - begin]:
                        parts.append(" " * (at - have if at >= have else 2 * bool(parts)) + lines[k - begin])
                        have += len(parts[-1])
                out.append("".join(parts).rstrip(" "))
        return out


def _wrapped(lines: list[str]) -> list[str]:
    out = []
    for x in lines:
        while len(x) > WIDEST:
            at = x.rfind(" ", 0, WIDEST + 1)
            if not x[: max(at, 0)].strip(" "):
                lead = len(x) - len(x.lstrip(" "))
                at = x.find(" ", max(WIDEST, lead))
            if at < 0:
                break
            out.append(x[:at])
            x = x[at:].lstrip(" ")
        out.append(x)
    return out


class Element:
    __slots__ = ("tag", "hidden", "veiled", "foreign", "mute", "pre", "box", "table", "kind", "number", "marker", "spans", "options", "listed", "chosen", "label")

    def __init__(self, tag: str, parent: Element | None):
        self.tag = tag
        self.hidden = parent.hidden if parent else False
        self.veiled = parent.veiled if parent else False  # takes its place without being seen
        self.foreign = parent.foreign if parent else ""
        self.mute = parent.mute if parent else False  # SVG shows the characters of its texts only
        self.options: list[tuple[bool, bool, str]] = parent.options if parent else []
        self.listed, self.chosen, self.label = False, False, ""
        self.pre = parent.pre if parent else False
        self.box = parent.box if parent else Box()
        self.table = parent.table if parent else None
        self.kind = ""
        self.number = 0
        self.marker = ""
        self.spans = (1, 1)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _whole(value: str | None, default: int, least: int, most: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "", re.A)
    return min(most, max(least, int(m[1]))) if m else default


class Renderer:
    def __init__(self):
        root = Element("html", None)
        self.stack = [root]
        self.open = Counter(["html"])  # tags of the stack
        self.counts = {"blocks": 0, "items": 0, "cells": 0, "tables": 0, "hidden": 0}

    @property
    def top(self) -> Element:
        return self.stack[-1]

    def pop(self) -> None:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        parent = self.stack[-1]
        if e.hidden:
            return
        if e.tag == "option" and e.box is not parent.box:
            e.options.append((e.chosen, False, e.label or " ".join(e.box.finish())))
            return
        if e.tag == "optgroup" and e.options is parent.options and e.box is parent.box and e.kind == "optgroup":
            return
        if e.tag == "select":
            # A list shows all of its options, a closed menu the last selected or the first one.
            shown = [o for o in e.options if e.listed or not o[1]]
            if not e.listed:
                shown = ([o for o in shown if o[0]] or shown[:1])[-1:]
            for _, _, text in shown:
                parent.box.text(f" {text} ", False)
            return
        if e.tag in ("text", "foreignobject") and parent.mute:
            parent.box.text(" ", False)
        if e.tag == "li" or e.tag in ("dd", "blockquote"):
            lines = e.box.finish()
            if e.tag == "li":
                lines = [(e.marker if k == 0 else " " * len(e.marker) if x else "") + x for k, x in enumerate(lines or ([""] if e.marker else []))]
                lines[:1] = [x.rstrip(" ") for x in lines[:1]]
            else:
                lines = ["  " + x if x else x for x in lines]
            parent.box.block(0)
            parent.box.put(lines)
        elif e.tag in _CELL:
            parent.table.cell(e.box.finish(), *e.spans)
        elif e.tag == "caption":
            parent.table.caption.extend(e.box.finish())
        elif e.tag == "table":
            parent.box.block(1)
            # Text that stood in a table outside of its cells comes before it.
            parent.box.put(e.box.finish())
            parent.box.put(e.table.layout())
        if e.tag in BLOCKS and e.tag not in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption"):
            parent.box.block(self.gap(e.tag))

    def gap(self, tag: str) -> int:
        nested = tag in ("ul", "ol", "menu") and self.open["li"] > 0
        return int(tag in SPACED and not nested)

    def end_until(self, tags: frozenset, stops: frozenset) -> None:
        """End the outermost open element of ``tags`` this side of ``stops``."""
        if not any(self.open[t] for t in tags):
            return
        last = None
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in tags:
                last = k
            if tag in stops:
                break
        if last is not None:
            while len(self.stack) > last:
                self.pop()

    def start(self, tag: str, raw: str) -> Element | None:
        if tag == "html":
            return None
        if tag == "image":
            tag = "img"
        if self.top.tag == "head" and tag not in HEAD_PARTS:
            self.pop()
        while self.top.foreign and tag in ENDS_FOREIGN:
            self.pop()
        if tag in ("select", "input", "textarea") and self.open["select"]:
            self.end_until(frozenset(["select"]), frozenset())
            if tag == "select":
                return None
        if tag == "head" and len(self.stack) > 1 or tag == "body" and self.open["body"]:
            return None
        if tag in ENDS_P and self.open["p"]:
            self.end_until(frozenset(["p"]), SCOPES | {"button"})
        if tag in IMPLIED_END:
            self.end_until(*IMPLIED_END[tag])
        if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "col", "colgroup"):
            if self.top.table is None:
                return None  # no table around it
            if tag in _CELL and self.top.tag != "tr":
                self.start("tr", "")
        names = _attributes(raw) if raw and not raw.isspace() else {}
        e = Element(tag, self.top)
        style = names.get("style", "")
        hides = tag in UNSEEN or "hidden" in names or bool(style and _HIDING.search(style)) or tag == "dialog" and "open" not in names
        hides = hides or tag in UNSEEN_IN.get(e.foreign, ())
        if hides and not e.hidden:
            e.hidden = True
            self.counts["hidden"] += 1
        if style and (seen := _VISIBILITY.findall(style)):
            e.veiled = seen[-1].lower() in ("hidden", "collapse")
            self.counts["hidden"] += e.veiled and not self.top.veiled and not e.hidden
        if tag in ("svg", "math"):
            e.foreign, e.mute = tag, tag == "svg"
        elif e.foreign and tag in HOLDS_HTML:
            e.mute, e.foreign = False, ""
        elif e.foreign and tag == "text":
            e.mute = False
        if not e.hidden:
            self.enter(e, names)
        if tag in VOID or e.foreign and _CLOSED.search(raw):
            return None
        self.stack.append(e)
        self.open[tag] += 1
        return e

    def enter(self, e: Element, names: dict[str, str]) -> None:
        tag, box = e.tag, self.top.box
        if tag == "br":
            box.end_line(True)
        elif tag == "select":
            e.box, e.pre, e.options = Box(), False, []
            e.listed = "multiple" in names or _whole(names.get("size"), 1, 0, 10**6) > 1
        elif tag == "option" and self.open["select"]:
            e.box, e.chosen, e.label = Box(), "selected" in names, "" if e.veiled else names.get("label", "")
        elif tag == "optgroup" and self.open["select"]:
            e.kind = "optgroup"
            if names.get("label") and not e.veiled:
                e.options.append((False, True, names["label"]))
        elif tag in ("text", "foreignobject") and self.top.mute:
            box.text(" ", False)
        elif tag == "tr":
            if e.table is not None:
                e.table.row()
        elif tag in _CELL:
            e.box, e.pre = Box(), False
            e.spans = (_whole(names.get("colspan"), 1, 1, MOST_COLUMNS), _whole(names.get("rowspan"), 1, 1, 65534))
            e.table = self.top.table
            self.counts["cells"] += 1
        elif tag == "caption":
            e.box = Box()
        elif tag in BLOCKS and tag not in ("thead", "tbody", "tfoot"):
            box.block(self.gap(tag))
            self.counts["blocks"] += 1
            if tag == "pre" or tag == "listing":
                e.pre = True
            if tag in ("ul", "ol", "menu"):
                e.kind, e.number = tag, _whole(names.get("start"), 1, -(10**9), 10**9) - 1
            elif tag == "li":
                self.counts["items"] += 1
                around = next((x for x in reversed(self.stack) if x.kind), None)
                if around is not None and around.kind == "ol":
                    around.number = _whole(names.get("value"), around.number + 1, -(10**9), 10**9)
                    e.marker = f"{around.number}. "
                else:
                    e.marker = "- "
                if e.veiled:
                    e.marker = ""
                e.box = Box()
            elif tag in ("dd", "blockquote"):
                e.box = Box()
            elif tag == "table":
                self.counts["tables"] += 1
                e.box, e.table = Box(), Table()

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in ("p", "br"):
            if tag == "br" or not self.open["p"]:
                if not self.top.hidden:
                    self.top.box.end_line(True) if tag == "br" else self.top.box.block(1)
                return
        stops = frozenset(["table"]) if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else frozenset() if tag == "table" else SCOPES
        heading = tag in HEADINGS
        if not any(self.open[t] for t in (HEADINGS if heading else (tag,))):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k].tag
            if name == tag or heading and len(name) == 2 and name[0] == "h" and name[1].isdigit():
                while len(self.stack) > k:
                    self.pop()
                return
            if name in stops:
                return

    def characters(self, raw: str) -> None:
        top = self.top
        if top.tag == "head" and raw.strip():
            self.pop()
            top = self.top
        if top.hidden or top.veiled or top.mute:
            return
        text = html.unescape(raw) if "&" in raw else raw
        box = top.box
        if top.tag in ("table", "tr", "thead", "tbody", "tfoot") and not text.strip():
            return
        if top.tag in ("tr", "thead", "tbody", "tfoot"):
            box = next((x.box for x in reversed(self.stack) if x.tag == "table"), box)
        box.text(text.replace("\0", ""), top.pre)

    def finish(self) -> str:
        while len(self.stack) > 1:
            self.pop()
        lines = self.top.box.finish()
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return "\n".join(lines)


def render(source: str | None) -> tuple[str, dict[str, int]]:
    """(text, counts of blocks, list items, cells, tables and hidden subtrees)."""
    r = Renderer()
    source = source or ""
    at, last = 0, source.rfind(">")
    while at < len(source):
        # Behind the last > nothing but an open comment is markup.
        m = _TOKEN.search(source, at) if at <= last else _OPEN_COMMENT.search(source, at)
        if m is None:
            r.characters(source[at:])
            break
        if m.start() > at:
            r.characters(source[at : m.start()])
        at = m.end()
        if m.re is _OPEN_COMMENT or m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            r.end(tag)
            continue
        e = r.start(tag, m[3])
        if tag in ("pre", "listing", "textarea"):  # a line break right after them is dropped
            at += 2 * source.startswith("\r\n", at) or source.startswith("\n", at)
        if e is not None and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if tag == "textarea":
                r.characters(source[at : close.start() if close else len(source)])
            at = close.end() if close else len(source)
            r.end(tag)
        elif e is not None and tag == "plaintext":
            r.characters(source[at:])
            break
    return r.finish(), r.counts


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64())]
    + [(f"n_{c}", pa.int64()) for c in ("blocks", "items", "cells", "tables", "hidden")]
)


def render_pages(pages: DataFrame) -> DataFrame:
    """Visible text and layout counts of every page, in one narrow pass.

    Null and empty pages give ''. Broken markup never fails: stray end tags are ignored,
    open elements end with the page. A null ``page_id`` stays; repeated rows give repeated
    results; other columns are ignored; pages of any length and depth are rendered whole.
    """
    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in _SCHEMA)

    def run(batches):
        for batch in slices(batches, 256):
            rows = []
            for source in batch.column(1).to_pylist():
                text, counts = render(source)
                rows.append((text, text.count("\n") + 1 if text else 0, *counts.values()))
            columns = zip(*rows, strict=True)
            arrays = [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, ddl)
