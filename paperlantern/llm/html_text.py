"""HTML extraction: a page as the text that a reader sees, laid out in lines.

A small tree builder follows the tags: it closes what the next tag implies closed (a
``p`` before a block, an ``li`` before the next, table parts), adds the row that a lone
cell implies, and ignores stray end tags.  Elements are invisible by kind (``head``,
``script``, …), by attribute (``hidden``, inline style), in a closed ``details`` or ``dialog``,
or by a rule of the page's own style sheet with ``display:none`` or ``visibility:hidden``
(tags, classes, ids and attributes, inside or directly below others; selectors with anything
else are not applied).  Of several rules the important, the more specific, then the later one
counts; at-rules count when they hold on a screen of ``WIDTH`` pixels.  A visible element
inside one of hidden visibility is seen.  All other text is kept: blocks on lines of their own, paragraphs and headings apart by a
blank line, list items with marks and indents, cells of tables in aligned columns.

Elements are handled as they open and close, with a stack and no recursion, so depth
does not matter.  Comments and tags that never end reach to the end of the page.  So that
time and text stay in proportion to the page, an indent is drawn up to ``INDENT``
characters, a column padded to ``PAD`` and a row of empty cells to ``GAP``, and tables
nested deeper than ``NEST`` have their cells on lines of their own.

Input: ``pages`` (page_id, html), each whole page in one task's memory.  A null or empty
page gives an empty text.  Repeated rows are rendered one by one; other columns are not
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD = 60
GAP = 4 * PAD
INDENT = 40
NEST = 16
WIDTH = 1280
#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object audio video canvas datalist".split())
#: The same inside svg and math.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure form fieldset hr".split())
BLOCKS = APART | frozenset(
    "html body div section article aside header footer nav main address center li dt dd tr caption legend details summary "
    "figcaption option optgroup select textarea menu dir hgroup search td th thead tbody tfoot".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
#: A start tag closes the nearest open element of the first set, not looking past the second.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "optgroup": (frozenset("option optgroup".split()), frozenset({"select"})),
    "td": (CELLS, frozenset({"table"})),
    "th": (CELLS, frozenset({"table"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "thead": (PARTS, frozenset({"table"})),
    "tbody": (PARTS, frozenset({"table"})),
    "tfoot": (PARTS, frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
_SCOPE = frozenset("table td th caption button".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_QUIET = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|<!--|-->""", re.S)
_MARK = re.compile(r"[{};]")
_SET = re.compile(r"\s*(display|visibility)\s*:\s*([\w-]+)[^!]*(!\s*important)?\s*", re.I)
_WIDE = re.compile(r"\(\s*(min-width\s*:|max-width\s*:|width\s*[<>]=?)\s*([\d.]+)(px|em|rem)\s*\)")
_INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,18})(?![0-9])")
_COMPOUND = re.compile(r"""(\*|[\w-]+)?((?:[.#][\w-]+|\[[\w-]+(?:=(?:"[^"\]]*"|'[^'\]]*'|[\w-]+))?\])*)""")
_NAME = re.compile(r"""[.#][\w-]+|\[[^\]]*\]""")
_LISTS = ("ul", "ol", "menu", "dir")


def _fits(part: str) -> bool | None:
    """Whether a part of a media query holds on the screen; None: not known."""
    if not part.startswith("("):
        return part in ("screen", "all")
    if part.replace(" ", "") in ("(orientation:landscape)", "(orientation:portrait)"):
        return "landscape" in part
    m = _WIDE.fullmatch(part)
    if not m:
        return None
    sign, edge = m[1].replace(" ", ""), float(m[2]) * (1 if m[3] == "px" else 16)
    if sign.startswith("min") or ">" in sign:
        return WIDTH > edge or WIDTH == edge and sign != "width>"
    return WIDTH < edge or WIDTH == edge and sign != "width<"


def on_screen(query: str) -> bool:
    """Whether a list of media queries holds on a screen; one that cannot be told does not."""
    for one in _SPACE.sub(" ", query.lower()).split(","):
        one = one.strip().removeprefix("only ")
        fits = [_fits(p.strip()) for p in one.removeprefix("not ").split(" and ")] if one else [True]
        if None not in fits and all(fits) != one.startswith("not "):
            return True
    return False


def _set(text: str) -> tuple[str, str, bool] | None:
    """(property, value, important) of a declaration that can hide."""
    m = _SET.fullmatch(text)
    return (m[1].lower(), m[2].lower(), bool(m[3])) if m else None


def sheet_rules(sheet: str) -> Iterator[tuple[str, list[tuple[str, str, bool]]]]:
    """(selectors, declarations that can hide) of the rules that apply on a screen, in order."""
    sheet = _QUIET.sub(" ", sheet)
    blocks: list[tuple[bool, str | None, list]] = []  # applies; selectors of a rule; its declarations
    last = 0
    for m in [*_MARK.finditer(sheet), None]:
        text, mark = sheet[last : m.start() if m else len(sheet)].strip(), m[0] if m else ""
        last = m.end() if m else last
        if mark == "{":
            applies = not blocks or blocks[-1][0] and blocks[-1][1] is None
            if text.startswith("@"):
                name, *rest = re.split(r"(?=[\s(])", text[1:], maxsplit=1)
                rest = "".join(rest).strip()
                holds = {"media": lambda: on_screen(rest), "supports": lambda: not rest.startswith("not"), "layer": lambda: True}
                blocks.append((applies and name.lower() in holds and holds[name.lower()](), None, []))
            else:
                blocks.append((applies, text, []))
            continue
        if blocks and blocks[-1][1] is not None and (found := _set(text)):
            blocks[-1][2].append(found)
        while blocks and mark != ";":
            applies, selectors, declarations = blocks.pop()
            if applies and selectors is not None and declarations:
                yield selectors, declarations
            if mark:
                break


class Rule:
    """A selector, the compounds of which are sets of names that an element has to bear."""

    __slots__ = ("compounds", "below", "weight", "declared")

    def __init__(self, compounds: list[frozenset[str]], below: list[bool], weight: tuple[int, int, int]) -> None:
        self.compounds, self.weight = compounds, weight
        self.below = below  # whether a compound has to stand directly below the one before
        self.declared: dict[str, tuple[bool, tuple[int, int, int], int, str]] = {}


def selector(text: str) -> Rule | None:
    """None for what is not applied."""
    compounds, below, weight, direct = [], [], [0, 0, 0], False
    for part in text.replace(">", " > ").split():
        if part == ">":
            if direct or not compounds:
                return None
            direct = True
            continue
        m = _COMPOUND.fullmatch(part)
        if not m or not part:
            return None
        names = {n.replace('"', "").replace("'", "") for n in _NAME.findall(m[2])}
        weight[0] += sum(n[0] == "#" for n in names)
        weight[1] += sum(n[0] != "#" for n in names)
        if m[1] and m[1] != "*":
            names.add(m[1].lower())
            weight[2] += 1
        compounds.append(frozenset(names))
        below.append(direct)
        direct = False
    return Rule(compounds, below, tuple(weight)) if compounds and not direct else None


def bears(tag: str, given: dict) -> frozenset[str]:
    """The names of an element that selectors ask for."""
    names = {tag, *("." + c for c in (given.get("class") or "").split())}
    if given.get("id"):
        names.add("#" + given["id"])
    for name, value in given.items():
        names |= {f"[{name}]", f"[{name}={value or ''}]"}
    return frozenset(names)


class Canvas:
    """Lines of text under an indent; asks for blank lines before the next content."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False
        self.indents: list[int] = []
        self.indent = 0
        self.mark = ""

    def enter(self, width: int) -> None:
        self.indents.append(width)
        self.indent += width

    def leave(self) -> None:
        if self.indents:
            self.indent -= self.indents.pop()

    def text(self, s: str, kept: bool) -> None:
        if kept:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._add(first)
            for line in rest:
                self._line(always=True)
                self._add(line)
            return
        s = _SPACE.sub(" ", s)
        if not self.now or self.now[-1].endswith(" "):
            s = s.lstrip(" ")
        self._add(s)

    def _add(self, s: str) -> None:
        if s:
            self.now.append(s)

    def _line(self, always: bool = False) -> None:
        line = "".join(self.now).rstrip()
        self.now = []
        if not line and not always:
            return
        if line and self.blank and self.lines:
            self.lines.append("")
        if line:
            self.blank = False
        lead = " " * min(self.indent, INDENT)
        if self.mark and line:
            lead = " " * min(self.indent - self.indents[-1], INDENT) + self.mark
            self.mark = ""
        self.lines.append((lead + line).rstrip())

    def end_line(self, always: bool = False) -> None:
        self._line(always)

    def gap(self) -> None:
        self._line()
        self.blank = True

    def put(self, lines: list[str]) -> None:
        """Finished lines of a table, as they are."""
        self._line()
        for line in lines:
            self.now = [line]
            self._line(always=True)

    def done(self) -> list[str]:
        self._line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        first = next((i for i, line in enumerate(lines) if line), 0)
        return lines[first:] if first else lines


def _span(value: str | None) -> int:
    return min(max(int(value), 1), 1000) if value and value.strip().isdigit() and len(value) < 9 else 1


def _integer(value: str | None, default: int) -> int:
    m = _INTEGER.match(value or "")
    return int(m[1]) if m else default


class Grid:
    """Rows of a table; a cell is (column, number of columns, lines)."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken: list[tuple[int, int, int]] = []  # from, to: columns that a cell from above covers; up to which row
        self.column = 0
        self.at = 0  # of those in ``taken``, the first one not left of the column

    def row(self) -> None:
        self.taken = sorted(t for t in self.taken if t[2] > len(self.rows))
        self.rows.append([])
        self.column = self.at = 0

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        while self.at < len(self.taken) and self.taken[self.at][0] <= self.column:
            self.column = max(self.column, self.taken[self.at][1])
            self.at += 1
        self.rows[-1].append((self.column, columns, lines))
        if rows > 1:
            self.taken.insert(self.at, (self.column, self.column + columns, len(self.rows) - 1 + rows))
            self.at += 1
        self.column += columns

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for column, columns, lines in row:
                longest = max(map(len, lines), default=0) if columns == 1 else 0
                width[column] = max(width.get(column, 0), min(longest, PAD))
        start, at = {}, 0
        for column in sorted(width):
            start[column] = at
            at += width[column] + 2
        out = []
        for row in self.rows:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                line, size = [], 0
                for column, _, lines in row:
                    piece = lines[i] if i < len(lines) else ""
                    if piece:
                        gap = min(max(start.get(column, 0) - size, 2 if line else 0), GAP)
                        line += [" " * gap, piece]
                        size += gap + len(piece)
                out.append("".join(line).rstrip())
        return [x for x in out if x]


class Element:
    __slots__ = ("tag", "shown", "seen", "kept", "canvas", "grid", "number", "spans", "closed", "names", "lasting", "direct")

    def __init__(self, tag: str, shown: bool, seen: bool, kept: bool):
        self.tag, self.shown, self.seen, self.kept = tag, shown, seen, kept  # shown: has a box; seen: its text is visible
        self.canvas: Canvas | None = None  # of the element outside, while a cell or caption has its own
        self.grid: Grid | None = None
        self.number: int | None = None
        self.spans = (1, 1)
        self.closed = False  # a details element of which only the summary is seen
        self.names: frozenset[str] = frozenset()
        # selectors met in part: (rule, compounds met), for all that is inside and for what is directly below
        self.lasting: frozenset[tuple[Rule, int]] = frozenset()
        self.direct: list[tuple[Rule, int]] = []


class Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.canvas = Canvas()
        self.stack: list[Element] = []
        self.open: dict[str, list[int]] = {}  # places in the stack
        self.grids: list[Grid | None] = []
        self.starts: dict[str, list[Rule]] = {}  # rules by a name of their first compound
        self.selectors: dict[str, Rule | None] = {}
        self.order = 0
        self.media = ""
        self.sheet: list[str] = []

    # what never ends; the whole page is given at once

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        end = super().parse_pi(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        end = super().parse_html_declaration(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        if end < 0:
            self.handle_data(self.rawdata[i:])
            return len(self.rawdata)
        return end

    # the tree

    def _last(self, tags) -> int:
        """Place of the nearest open element of these."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(reversed(attrs))
        if tag in BLOCKS and self.open.get("p"):
            self._close_nearest(frozenset({"p"}), _SCOPE)
        if tag in IMPLIED:
            self._close_nearest(*IMPLIED[tag])
        if tag in HEADINGS and self.stack and self.stack[-1].tag in HEADINGS:
            self._pop()
        if tag in CELLS and self.open.get("table") and self._last(("tr",)) < self._last(("table",)):
            self._push("tr", {})
        if tag in VOID:
            self._void(tag, given)
        else:
            self._push(tag, given)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash of a non-void element means nothing, but in svg and math
        if (self.open.get("svg") or self.open.get("math")) and self.stack[-1].tag == tag:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.open.get("p"):
            self.canvas.gap()
        elif tag == "br":
            self._void("br", {})
        elif tag not in ("html", "body"):
            if tag not in BLOCKS:
                limit = BLOCKS  # an inline end tag closes no block
            elif tag in (*PARTS, "tr", *CELLS):
                limit = frozenset({"table"})
            else:
                limit = frozenset() if tag == "table" else frozenset({"table", *CELLS})
            self._close_nearest(frozenset({tag}), limit)

    def _close_nearest(self, tags: frozenset, limit: frozenset) -> None:
        at = self._last(tags)
        if at >= 0 and at >= self._last(limit):
            while len(self.stack) > at:
                self._pop()

    def _met(self, names: frozenset[str], above: Element | None) -> tuple[list[Rule], frozenset, list]:
        """(rules that apply to an element, rules met in part for all inside it, for what is directly below)."""
        begun = [(rule, 0) for name in (*names, "") for rule in self.starts.get(name, ())]
        inherited = [*above.lasting, *above.direct] if above is not None else []
        whole, lasting, direct = [], [], []
        for rule, n in begun + inherited:
            if rule.compounds[n] <= names:
                if n + 1 == len(rule.compounds):
                    whole.append(rule)
                else:
                    (direct if rule.below[n + 1] else lasting).append((rule, n + 1))
        before = above.lasting if above is not None else frozenset()
        return whole, before if before.issuperset(lasting) else before | frozenset(lasting), direct

    def _look(self, tag: str, given: dict) -> Element:
        """An element that opens here."""
        above = self.stack[-1] if self.stack else None
        e = Element(tag, False, False, tag in ("pre", "textarea") or above is not None and above.kept)
        shown, visible = (above.shown, above.seen) if above is not None else (True, True)
        counts: dict[str, tuple[bool, tuple[int, int, int], int, str]] = {}
        e.names = bears(tag, given)
        if self.starts:
            whole, e.lasting, e.direct = self._met(e.names, above)
            for rule in whole:
                for what, declared in rule.declared.items():
                    counts[what] = max(counts.get(what, declared), declared)
        if above is not None and above.closed:
            if tag != "summary":
                return e
            visible = True
        if not shown or tag in UNSEEN or tag in UNDRAWN and (self.open.get("svg") or self.open.get("math")):
            return e
        style = given.get("style")
        for i, found in enumerate(map(_set, _QUIET.sub(" ", style).split(";") if style else ())):
            if found:
                declared = (found[2], (1 << 30, 0, 0), i, found[1])
                counts[found[0]] = max(counts.get(found[0], declared), declared)
        usual = "hidden" not in given and (tag != "dialog" or "open" in given)
        e.shown = counts["display"][3] != "none" if "display" in counts else usual
        value = counts["visibility"][3] if "visibility" in counts else ""
        visible = value not in ("hidden", "collapse") if value in ("hidden", "collapse", "visible", "initial") else visible
        e.seen = e.shown and visible
        if tag == "details" and "open" not in given and e.seen:
            e.closed, e.seen = True, False
        return e

    def _push(self, tag: str, given: dict) -> None:
        e = self._look(tag, given)
        if tag == "style":
            self.media = given.get("media") or ""
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(e)
        if e.shown:
            self._enter(e, given)

    def _pop(self) -> None:
        e = self.stack.pop()
        self.open[e.tag].pop()
        if e.tag == "style":
            self._read_sheet()
        if e.shown:
            self._leave(e)

    # the layout

    def handle_data(self, data: str) -> None:
        if self.stack and not self.stack[-1].seen:
            if self.stack[-1].tag == "style":
                self.sheet.append(data)
            return
        self.canvas.text(data, bool(self.stack) and self.stack[-1].kept)

    def _read_sheet(self) -> None:
        further = False
        for selectors, declarations in sheet_rules("".join(self.sheet)) if on_screen(self.media) else ():
            for name in (" ".join(n.split()) for n in selectors.split(",")):
                if name not in self.selectors:
                    rule = self.selectors[name] = selector(name)
                    if rule is not None:
                        further |= len(rule.compounds) > 1
                        first = max(rule.compounds[0], key=lambda n: (n[0] in "#", n[0] in ".[", n), default="")
                        self.starts.setdefault(first, []).append(rule)
                rule = self.selectors[name]
                for what, value, important in declarations if rule is not None else ():
                    self.order += 1
                    declared = (important, rule.weight, self.order, value)
                    rule.declared[what] = max(rule.declared.get(what, declared), declared)
        self.sheet = []
        if further:  # what is open already can be the first part of the new ones
            for above, e in zip([None, *self.stack], self.stack):
                _, e.lasting, e.direct = self._met(e.names, above)

    def _void(self, tag: str, given: dict) -> None:
        if not self._look(tag, given).seen:
            return
        if tag == "br":
            self.canvas.end_line(always=True)
        elif tag == "hr":
            self.canvas.gap()
            self.canvas.text("----", True)
            self.canvas.gap()
        elif tag == "input" and (given.get("type") or "text").lower() not in ("hidden", "checkbox", "radio", "password", "file"):
            self.canvas.text(given.get("value") or "", False)

    def _grid(self) -> Grid | None:
        return self.grids[-1] if self.grids else None

    def _enter(self, e: Element, given: dict) -> None:
        canvas, tag = self.canvas, e.tag
        if tag in CELLS and self._grid():
            e.canvas, self.canvas = canvas, Canvas()
            e.spans = _span(given.get("colspan")), _span(given.get("rowspan"))
        elif tag == "tr" and self._grid():
            self._grid().row()
        elif tag == "li":
            canvas.end_line()
            at = self._last(_LISTS)
            owner = self.stack[at] if at >= 0 else None
            if owner is not None and owner.number is not None:
                owner.number = _integer(given.get("value"), owner.number)
                canvas.mark = f"{owner.number}. "
                owner.number += 1
            else:
                canvas.mark = "- "
            canvas.enter(len(canvas.mark))
        elif tag == "dd":
            canvas.end_line()
            canvas.enter(2)
        elif tag in _LISTS:
            if self.open.get("li"):
                canvas.end_line()
            else:
                canvas.gap()
            e.number = _integer(given.get("start"), 1) if tag == "ol" else None
        elif tag == "table":
            canvas.gap()
            e.grid = Grid() if sum(g is not None for g in self.grids[:NEST]) < NEST else None
            self.grids.append(e.grid)
        elif tag in APART:
            canvas.gap()
            if tag == "blockquote":
                canvas.enter(2)
        elif tag in BLOCKS:
            canvas.end_line()
        elif tag == "text" and self.open.get("svg"):
            canvas.text(" ", False)

    def _leave(self, e: Element) -> None:
        tag = e.tag
        if e.canvas is not None:
            lines, self.canvas = self.canvas.done(), e.canvas
            self._grid().cell(lines, *e.spans)
            return
        canvas = self.canvas
        if tag in ("li", "dd", "blockquote"):
            canvas.end_line()
            canvas.mark = ""
            canvas.leave()
        if tag == "table":
            self.grids.pop()
        if e.grid is not None:
            canvas.put(e.grid.lines())
        if tag in APART and not (tag in ("ul", "ol") and self.open.get("li")):
            canvas.gap()
        elif tag in BLOCKS and not (tag == "tr" and self._grid()):
            canvas.end_line()
        elif tag == "text" and self.open.get("svg"):
            canvas.text(" ", False)

    def rendered(self) -> str:
        self.close()
        while self.stack:
            self._pop()
        return "\n".join(self.canvas.done())


def render(html: str | None) -> str:
    """Visible text of one page."""
    if not html:
        return ""
    page = Page()
    page.feed(html)
    return page.rendered()


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines for every page."""

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(h) for h in batch["html"].to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], pa.array(texts, pa.string()), pa.array(lines, pa.int64())], ["page_id", "text", "n_lines"]
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"))
    return rows.mapInArrow(rendered, "page_id long, text string, n_lines long")
