"""Text of web pages, laid out as a browser shows it.

A tokenizer and a tree builder with implied end tags turn the page into a
tree; visibility rules mark what is not shown: elements that never are, the
``hidden`` attribute, inline styles, and rules of style sheets whose selectors
are made of tags, classes and ids, alone, joined (``p.a#b``), or as descendants
and children of others.  What is under ``display: none`` is gone with all in it;
``visibility: hidden`` veils text until a ``visibility: visible`` inside.  A
renderer then emits all text that is shown.  Blocks stand on lines of their own,
paragraphs and headings are set off by a blank line, list items have bullets or
numbers and are indented by depth, white space is collapsed except in
preformatted text, and table cells are set in aligned columns, with room left
where one spans rows or columns.  Nothing is dropped as boilerplate.

The work is linear in the page's length and uses no recursion, so depth and
length of a page are not limited.

Defined cases: a null or empty page gives an empty text; text outside any tag
is shown; an unclosed comment or tag ends at the end of the page; a quote that
never closes is part of the tag up to the next ``>``; a rule that hides is not
undone by a later rule of a sheet; repeated rows are rendered each; an empty
table gives no row; columns other than the id and the page are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.plans.naming import col


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# Names of elements by their role in HTML.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes noscript")
NEVER = _set("head title script style template noscript iframe noembed noframes audio video canvas datalist rp desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient")
HEAD = _set("base basefont bgsound link meta noframes noscript script style template title")
BLOCK = _set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table text ul")
SPACED = _set("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre figure table fieldset")
CLOSES_P = BLOCK - _set("body caption html optgroup legend text") | _set("hr xmp plaintext")
CELL = _set("td th")
ROW_GROUP = _set("thead tbody tfoot")
LISTS = _set("ul ol menu dir")
#: Elements of drawings whose own text is not drawn.
BARE = _set("svg g")
#: Elements that end when the key begins, and those up to which one looks for them.
IMPLIED = {
    "li": (_set("li"), LISTS | CELL | _set("table")),
    "dt": (_set("dt dd"), _set("dl table") | CELL),
    "dd": (_set("dt dd"), _set("dl table") | CELL),
    "option": (_set("option"), _set("select optgroup datalist")),
    "optgroup": (_set("option optgroup"), _set("select")),
    "rt": (_set("rt rp"), _set("ruby")),
    "rp": (_set("rt rp"), _set("ruby")),
    "tr": (_set("tr td th caption colgroup"), _set("table thead tbody tfoot")),
    "td": (_set("td th caption colgroup"), _set("table tr")),
    "th": (_set("td th caption colgroup"), _set("table tr")),
    **{g: (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")) for g in ("thead", "tbody", "tfoot", "caption", "colgroup")},
}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([a-z-]+)(?:\s+[a-z-]+)*\s*(!\s*important)?", re.I)
_VEIL = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)\s*(!\s*important)?", re.I)
_PIECE = re.compile(r"([^{}]*)([{}])")
_SCREEN = re.compile(r"@layer\b|@media\s*(?:[^,]*,)*\s*(?:(?:only\s+)?(?:screen|all)\s*)?(?:,|$)", re.I)
_SELECTOR = re.compile(r"(?:\*|[a-zA-Z][\w-]*)?(?:[.#][a-zA-Z_-][\w-]*)*(?:\s*[> ]\s*(?:\*|[a-zA-Z][\w-]*)?(?:[.#][a-zA-Z_-][\w-]*)*)*$")
_STEP = re.compile(r"(>?)\s*([^\s>]+)")
_WHITE = re.compile(r"[ \t\n\r\f]+")
_ODD = re.compile(r"[\t\n\r\f]|  ")
#: Widest column that narrower cells are padded to.
WIDEST = 60


class Node:
    __slots__ = ("tag", "attrs", "children", "hidden", "veiled", "met")

    def __init__(self, tag: str, attrs: dict[str, str], hidden: bool, veiled: bool = False):
        self.tag, self.attrs, self.hidden, self.veiled = tag, attrs, hidden, veiled
        self.children: list[Node | str] = []
        #: Steps of longer selectors that this element, and those around it, meet.
        self.met: tuple[frozenset, frozenset] = (frozenset(), frozenset())


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw) if raw.strip() else ():
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def style_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of rules; within at-rules, if these hold on any screen."""
    held: list[str] = []  # what stands before each open brace
    skipped = 0  # open at-rules that need not hold
    for before, brace in _PIECE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
        if brace == "{":
            held.append(before.rpartition(";")[2].strip())
            skipped += _conditional(held[-1])
        elif held:
            selectors = held.pop()
            if not skipped:
                yield from ((s.strip(), before) for s in selectors.split(","))
            skipped -= _conditional(selectors)


def _last(found: list[tuple[str, str]]) -> tuple[bool, str] | None:
    """Whether the declaration that counts in one style is important, and its value."""
    weighty = [v for v, important in found if important]
    return (bool(weighty), (weighty or [v for v, _ in found])[-1].lower()) if found else None


def _hides(style: str) -> bool:
    display, veil = _last(_DISPLAY.findall(style)), _last(_VEIL.findall(style))
    return bool(display and display[1] == "none" or veil and veil[1] != "visible")


def hiding_selectors(sheet: str) -> set[str]:
    """Selectors of rules that take elements, or their text, from view."""
    return {s for s, what in style_rules(sheet) if s and _SELECTOR.match(s) and _hides(what)}


def _strength(parts: list[frozenset[str]]) -> tuple[int, int, int]:
    """How many ids, classes and tags a selector names."""
    names = [x for part in parts for x in part if x != "*"]
    ids, classes = sum(x[0] == "#" for x in names), sum(x[0] == "." for x in names)
    return ids, classes, len(names) - ids - classes


class Rules:
    """Rules that set whether elements are shown.

    Those of one step are found by its rarest part, an id, a class or a tag;
    of longer ones every element keeps the steps met so far.
    """

    def __init__(self) -> None:
        self.single: dict[str, list[tuple[frozenset[str], tuple, str]]] = {}
        self.chains: list[tuple[list[tuple[bool, frozenset[str]]], tuple, str]] = []
        self.n = 0

    def add(self, sheet: str) -> None:
        for selector, what in style_rules(sheet):
            if selector and _SELECTOR.match(selector) and (_DISPLAY.search(what) or _VEIL.search(what)):
                steps = [(bool(child), frozenset(x if x[0] in ".#" else x.lower() for x in re.findall(r"[.#]?[\w-]+", part))) for child, part in _STEP.findall(selector)]
                self.n += 1
                rank = (*_strength([s for _, s in steps]), self.n)
                if len(steps) > 1:
                    self.chains.append((steps, rank, what))
                else:
                    key = max(steps[0][1], key=lambda x: ("#" in x, "." in x), default="*")
                    self.single.setdefault(key, []).append((steps[0][1], rank, what))

    def found(self, node: Node, around: Node) -> list[str]:
        """Declarations of the rules that a new element meets, the strongest last."""
        names = {node.tag, "*", *("." + c for c in node.attrs.get("class", "").split())}
        if "id" in node.attrs:
            names.add("#" + node.attrs["id"])
        met: list[tuple[tuple, str]] = []
        for key in names & self.single.keys():
            met += [(rank, what) for needed, rank, what in self.single[key] if needed <= names]
        if self.chains:
            own, above = set(), around.met[0] | around.met[1]
            for r, (steps, rank, what) in enumerate(self.chains):
                for k, (child, needed) in enumerate(steps):
                    if needed <= names and (k == 0 or (r, k - 1) in (around.met[0] if child else above)):
                        own.add((r, k))
                        if k == len(steps) - 1:
                            met.append((rank, what))
            node.met = frozenset(own), above
        return [what for _, what in sorted(met)]


def _conditional(before: str) -> bool:
    return before.startswith("@") and not _SCREEN.match(before)


class Builder:
    """The tree of a page, with implied end tags."""

    def __init__(self, page: str):
        self.root = Node("#root", {}, False)
        self.open = [self.root]
        self.rules = Rules()
        self._read(page)

    def _shown(self, node: Node, around: Node) -> None:
        """Set whether an element, and the text in it, is shown."""
        tag, attrs, node.veiled = node.tag, node.attrs, around.veiled
        node.hidden = "hidden" in attrs or (tag == "dialog" and "open" not in attrs)
        bound = [False, False]  # whether display and visibility are set by an important declaration
        for what in (*self.rules.found(node, around), attrs.get("style", "")):
            if what:
                for k, found in enumerate((_last(_DISPLAY.findall(what)), _last(_VEIL.findall(what)))):
                    if found and (found[0] or not bound[k]):
                        bound[k] = found[0]
                        if k == 0:
                            node.hidden = found[1] == "none"
                        else:
                            node.veiled = found[1] != "visible"
        node.hidden |= tag in NEVER

    def _text(self, s: str) -> None:
        if s:
            self.open[-1].children.append(html.unescape(s) if "&" in s else s)

    def _pop_to(self, names: frozenset[str], stop: frozenset[str]) -> bool:
        """Close up to and with the outermost of the named elements before a stop."""
        found = 0
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in names:
                found = k
            elif tag in stop:
                break
        if found:
            del self.open[found:]
        return bool(found)

    def _start(self, tag: str, raw: str) -> None:
        if len(self.open) > 1 and self.open[-1].tag == "head" and tag not in HEAD:
            self.open.pop()
        if tag in CLOSES_P:
            self._pop_to(frozenset(("p",)), CELL | {"table", "button", "object", "caption"})
        if tag in IMPLIED:
            self._pop_to(*IMPLIED[tag])
        if tag in ("html", "body", "head") and any(n.tag == tag for n in self.open):
            return
        node = Node(tag, attributes(raw), False)
        self._shown(node, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._start("br", "")
        elif tag in VOID:
            return
        else:
            stop = frozenset() if tag in ("table", "body", "html") else frozenset(("table",)) if tag in CELL | ROW_GROUP | {"tr", "caption"} else CELL | {"table", "caption"}
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    del self.open[k:]
                    return
                if self.open[k].tag in stop:
                    break
            if tag == "p":
                self._start("p", "")
                self.open.pop()

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        lower = None
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self._text(page[at:])
                return
            m = _TAG.match(page, lt)
            if m:
                self._text(page[at:lt])
                at = m.end()
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                    continue
                self._start(tag, m[3])
                if tag in RAW:
                    lower = page.lower() if lower is None else lower
                    end = lower.find("</" + tag, at)
                    end = n if end < 0 else end
                    body = page[at:end]
                    if tag == "style":
                        self.rules.add(body)
                    elif tag in ("textarea", "title"):
                        self._text(body)
                    if self.open[-1].tag == tag:
                        self.open.pop()
                    at = page.find(">", end) + 1 or n
                continue
            following = page[lt + 1 : lt + 2]
            if following in ("!", "?") or (following == "/" and page[lt + 2 : lt + 3]):
                self._text(page[at:lt])
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
            elif following.isascii() and following.isalpha():
                self._text(page[at:lt])  # a tag that never ends
                return
            else:
                self._text(page[at : lt + 1])
                at = lt + 1


class Flow:
    """Lines of a block of text; inline text gathers until the line ends."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent = ""
        self.bullet = ""
        self.blank = False
        self.space = False

    def text(self, s: str) -> None:
        if not s:
            return
        if _ODD.search(s):
            s = _WHITE.sub(" ", s)
        if s[0] == " ":
            self.space = True
        words = s.strip(" ")
        if words:
            if self.space and self.now and not self.now[-1].endswith("\n"):
                self.now.append(" ")
            self.now.append(words)
            self.space = s[-1] == " "

    def plain(self, s: str) -> None:
        self.now.append(s)
        self.space = False

    def line(self) -> None:
        """End the current line, if it has anything."""
        if self.now:
            whole = "".join(self.now).replace("\xa0", " ").removesuffix("\n")
            self.now = []
            for k, s in enumerate(whole.split("\n")):
                if self.blank and self.lines:
                    self.lines.append("")
                self.blank = False
                first = self.bullet if k == 0 else ""
                self.lines.append((self.indent[: len(self.indent) - len(first)] + first + s).rstrip())
                if k == 0:
                    self.bullet = ""
        self.space = False

    def gap(self) -> None:
        self.line()
        self.blank = True

    def done(self) -> list[str]:
        self.line()
        return self.lines


class Table:
    """Rows of cells, each with its column; cells that span rows keep their columns from the next ones."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str], int]]] = []
        self.taken: dict[int, int] = {}  # the row up to which a column is taken
        self.next = 0

    def row(self) -> None:
        self.rows.append([])
        self.next = 0

    def group(self) -> None:
        """A new group of rows, into which no cell reaches."""
        self.taken.clear()

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        at = len(self.rows) - 1
        while self.taken.get(self.next, -1) >= at:
            self.next += 1
        self.rows[-1].append((self.next, lines, columns))
        if rows != 1:
            self.taken |= dict.fromkeys(range(self.next, self.next + columns), at + rows - 1 if rows else 1 << 30)
        self.next += columns

    def lines(self) -> list[str]:
        """Rows with their cells in aligned columns, two spaces apart."""
        width: dict[int, int] = {}
        for row in self.rows:
            for c, cell, span in row:
                if span == 1:
                    width[c] = max(width.get(c, 0), *(len(s) for s in cell if len(s) <= WIDEST), 0)
        columns = sorted(width)
        before = [0, *accumulate(width[c] for c in columns)]
        out = []
        for row in self.rows:
            start = [before[bisect_left(columns, c)] + 2 * c for c, _, _ in row]
            for k in range(max((len(cell) for _, cell, _ in row), default=0)):
                line = ""
                for (_, cell, _), at in zip(row, start, strict=True):
                    if k < len(cell) and cell[k]:
                        line = line.ljust(at) if len(line) + 2 <= at or not line else line + "  "
                        line += cell[k]
                out.append(line.rstrip())
        return out


def _number(s: str | None, default: int) -> int:
    return int(s) if s and re.fullmatch(r"-?\d{1,6}", s.strip()) else default


def render(page: str | None) -> str:
    """The text of a page as it is shown."""
    if not page:
        return ""
    flow = Flow()
    flows: list[Flow] = [flow]
    tables: list[Table] = []
    lists: list[list] = []  # kind, next number
    pre = 0
    todo: list[tuple] = [(c, None) for c in reversed(Builder(page).root.children)]
    while todo:
        node, undo = todo.pop()
        if undo:
            tag, saved = undo
            if tag == "#cell":
                cell = flow.done()
                flows.pop()
                flow = flows[-1]
                tables[-1].cell(cell, *saved)
            elif tag == "table":
                flow.line()  # text of the table that is in no cell
                for s in tables.pop().lines():
                    flow.plain(s)
                    flow.line()
                flow.gap()
            else:
                if tag in LISTS:
                    lists.pop()
                if tag == "pre":
                    pre -= 1
                if tag in SPACED and not (tag in LISTS and lists):
                    flow.gap()
                else:
                    flow.line()
                if saved is not None:
                    flow.indent, flow.bullet = saved, ""
            continue
        if isinstance(node, str):
            flow.plain(node) if pre else flow.text(node)
            continue
        if node.hidden:
            continue
        tag = node.tag
        if tag == "br":
            flow.now.append("\n") if flow.now and not pre else flow.line() if not pre else flow.plain("\n")
            flow.space = False
            continue
        if tag == "hr":
            flow.gap()
            continue
        if tag == "input":
            if not node.veiled and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                flow.text(node.attrs.get("value", ""))
            continue
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        if tag in CELL and tables:
            flow = Flow()
            flows.append(flow)
            spans = max(1, min(1000, _number(node.attrs.get("colspan"), 1))), max(0, min(65534, _number(node.attrs.get("rowspan"), 1)))
            todo.append((node, ("#cell", spans)))
        elif tag == "table":
            flow.gap()
            tables.append(Table())
            todo.append((node, (tag, None)))
        elif tag == "tr" and tables:
            tables[-1].row()
        elif tag in ROW_GROUP and tables:
            tables[-1].group()
        elif tag in BLOCK or tag in CELL:
            saved = None
            if tag in SPACED and not (tag in LISTS and lists):
                flow.gap()
            else:
                flow.line()
            if tag in LISTS:
                lists.append([tag, _number(node.attrs.get("start"), 1)])
            elif tag == "li":
                saved = flow.indent
                kind = lists[-1] if lists else ["ul", 1]
                bullet = "- "
                if kind[0] == "ol":
                    kind[1] = _number(node.attrs.get("value"), kind[1])
                    bullet = f"{kind[1]}. "
                    kind[1] += 1
                flow.indent += " " * len(bullet)
                flow.bullet = "" if node.veiled else bullet
            elif tag in ("dd", "blockquote"):
                saved = flow.indent
                flow.indent += "    " if tag == "dd" else "  "
            elif tag == "pre":
                pre += 1
                if children and isinstance(children[0], str) and children[0][:1] == "\n":
                    children = [children[0][1:], *children[1:]]
            todo.append((node, (tag, saved)))
        elif tag == "option":
            flow.space = True
        todo.extend((c, None) for c in reversed(children) if not ((node.veiled or tag in BARE) and isinstance(c, str)))
    return "\n".join(flow.done())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text, n_chars and n_lines of each page; no shuffle."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                got = [render(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in got], pa.int64())], names=["id", "text", "n_chars", "n_lines"])

    rows = pages.select(col(id_col).alias("id"), col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {kind}, text string, n_chars long, n_lines long").withColumnRenamed("id", id_col)
