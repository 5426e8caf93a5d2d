"""Layout-aware text of HTML pages.

A tolerant tree builder supplies the tags that authors leave out, visibility rules decide what a reader would see, and
a renderer lays the rest out as plain text: blank lines around blocks, list markers with indents, line breaks, kept
white space in ``pre``, and tables with their columns aligned. All visible text is emitted; nothing is scored away.
Style sheets are not applied, only attributes of the elements themselves.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes "
                   "audio video canvas param source track area map annotation annotation-xml".split())
# parts of a drawing that are not drawn where they stand; of the rest only texts are
UNDRAWN = frozenset("title desc metadata defs symbol clippath mask pattern marker filter lineargradient radialgradient style script".split())
DRAWN = frozenset(["text", "foreignobject"])
# HTML inside drawings and formulas: below these it is at home, elsewhere the other kinds end the drawing or formula
AT_HOME = frozenset("foreignobject annotation-xml desc mi mo mn ms mtext".split())
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
                   "ruby s small span strong strike sub sup table tt u ul var".split())
# inputs without a value that can be read; all others, unknown kinds too, show theirs
NO_VALUE = frozenset("hidden password checkbox radio range color file image".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset form address menu".split())
BLOCK = MARGIN | frozenset("html body div section article aside header footer nav main li dt dd tr caption legend figcaption "
                           "details summary dialog center search hgroup thead tbody tfoot td th optgroup option".split())
SPANS = {"colspan": 1000, "rowspan": 65534}
# an opening tag (left) ends an open element of these kinds, unless one of the barriers is met first
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
        "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select", "datalist"}),
        "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
        "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
        "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"})}
ENDS["tbody"] = ENDS["tfoot"] = ENDS["thead"]
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SCOPE = frozenset("table td th caption template button html object".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
# what follows a tag's name, up to the first > that is not quoted; no part is ever given back, so time is linear
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*+>|[^<]++|<", re.S)
REST = re.compile(r"<!--.*|[^<]++|<", re.S)       # the same where no > is left
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(text: str) -> dict:
    return {m[1].lower(): unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in ATTRIBUTE.finditer(text)} if text else {}


def parse(page: str) -> Node:
    """The element tree; leaves are strings.

    A tag whose quotes swallow all that follows ends at its first ``>``, and quotes count no more from there on; an opening
    bracket after the last ``>`` of the page begins no tag and is text."""
    root = Node("#root", {})
    stack, at = [root], 0
    places: defaultdict[str, list[int]] = defaultdict(list)     # of the open elements of each kind in the stack

    def push(node: Node) -> None:
        places[node.tag].append(len(stack))
        stack.append(node)

    def end(kinds: set, barriers, every: bool = False) -> None:
        """Close the innermost open element of ``kinds``, or every one up to a barrier, and all inside."""
        last = max((places[k][-1] for k in kinds if places[k]), default=0)
        barrier = max((places[k][-1] for k in barriers if k not in kinds and places[k]), default=0)
        if last <= barrier:
            return
        if every:
            last = min(places[k][i] for k in kinds if (i := bisect_right(places[k], barrier)) < len(places[k]))
        while len(stack) > last:
            places[stack.pop().tag].pop()

    last, quotes = page.rfind(">"), True
    while at < len(page):
        m = TAG.match(page, at) if at < last else None
        if m is None:
            m = (OTHER if at < last else REST).match(page, at)
            at = m.end()
            if m[0][0] != "<" or m[0] == "<":
                stack[-1].children.append(unescape(m[0]))
            continue
        stop = INSIDE.match(page, m.end()).end() if quotes else len(page)
        if stop == len(page):
            quotes, stop = False, page.find(">", m.end())
        inside, at = page[m.end():stop], stop + 1
        closed = inside.endswith("/")
        inside, tag = inside[:-1] if closed else inside, m[2]
        tag = tag.lower()
        foreign = max((places[k][-1] for k in ("svg", "math") if places[k]), default=0)
        if foreign and foreign < max((places[k][-1] for k in AT_HOME if places[k]), default=0):
            foreign = 0
        if foreign and not m[1] and tag in LEAVES:
            end({"svg", "math"}, AT_HOME, every=True)
            foreign = 0
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not places["p"]:
                stack[-1].children.append(Node("p", {}))
            elif tag not in VOID:
                end({tag}, () if tag in ("table", "html", "body") else SCOPE - {tag})
            continue
        if tag in CLOSES_P:
            end({"p"}, SCOPE)
        if tag in ENDS:
            end(*ENDS[tag], every=True)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, attributes_of(inside))
        stack[-1].children.append(node)
        if closed and (foreign or tag in ("svg", "math")):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            text = page[at:close.start() if close else len(page)]
            node.children.append(text if tag != "textarea" else unescape(text))
            at = close.end() if close else len(page)
        elif tag not in VOID:
            push(node)
    return root


class Lines:
    """Text under layout: words flow into a line, blocks end it, margins ask for a blank line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False      # white space seen since the last word of the line
        self.gap = False        # a blank line is due before the next one

    def words(self, text: str) -> None:
        for i, word in enumerate(BLANKS.split(text)):
            if i:
                self.space = True
            if word:
                if self.space and self.line:
                    self.line.append(" ")
                self.line.append(word)
                self.space = False

    def kept(self, text: str) -> None:
        for i, piece in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.end(True)
            if piece:
                self.line.append(piece)

    def end(self, even_empty: bool = False) -> None:
        if self.line or even_empty:
            self.put(["".join(self.line)])
        self.line, self.space = [], False

    def margin(self) -> None:
        self.end()
        self.gap = bool(self.lines)

    def put(self, lines: list[str]) -> None:
        if self.gap:
            self.lines.append("")
        self.gap = False
        self.lines += lines

    def done(self) -> list[str]:
        self.end()
        return self.lines


def shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether the element has a box at all, and whether text in it is visible."""
    a, tag = node.attributes, node.tag
    if tag in UNSEEN or "hidden" in a or tag == "dialog" and "open" not in a or tag == "input" and a.get("type", "").lower() == "hidden":
        return False, False
    style = a.get("style")
    if style:
        if HIDING.search(style):
            return False, False
        if v := VISIBILITY.search(style):
            visible = v[1].lower() not in ("hidden", "collapse")
    return True, visible


def options(node: Node, visible: bool) -> Iterator[str]:
    """The labels that a ``select`` shows: of a drop-down list the chosen one, of an open list all with the names of their groups."""
    a = node.attributes
    size = a.get("size", "")
    open_list = "multiple" in a or size.isdecimal() and int(size) > 1
    found, stack = [], [(child, visible, True, False) for child in reversed(node.children) if isinstance(child, Node)]
    while stack:
        item, seen, box, off = stack.pop()
        has_box, seen = shown(item, seen)
        box, off = box and has_box, off or "disabled" in item.attributes
        if item.tag in ("option", "optgroup"):
            found.append((item, box and seen, off))
        if item.tag != "option":
            stack += [(child, seen, box, off) for child in reversed(item.children) if isinstance(child, Node)]
    if not open_list:
        found = [f for f in found if f[0].tag == "option"]
        chosen = [f for f in found if "selected" in f[0].attributes][-1:] or [f for f in found if not f[2]][:1]
        found = [(f[0], visible, False) for f in chosen]
    for item, seen, _ in found:
        label = item.attributes.get("label") or ("".join(texts(item)) if item.tag == "option" else "")
        if seen and label:
            yield label


def texts(node: Node) -> Iterator[str]:
    stack = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
        elif item.tag not in ("script", "style"):
            stack += reversed(item.children)


def laid_out(step: Generator):
    """Run a step and the steps that it yields one inside the other, on a stack of their own: pages nest as deep as they like."""
    stack, got = [step], None
    while stack:
        try:
            inner = stack[-1].send(got)
        except StopIteration as over:
            stack.pop()
            got = over.value
        else:
            stack.append(inner)
            got = None
    return got


def flow(node: Node, out: Lines, visible: bool, kept: bool = False, depth: int = 0, svg: bool = False) -> Generator:
    """``svg``: inside a drawing, but not in one of its texts."""
    closed = node.tag == "details" and "open" not in node.attributes
    number = node.attributes.get("start", "1")
    number = int(number) if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", number) else 1
    for child in node.children:
        if isinstance(child, str):
            if visible and not closed and not svg:
                (out.kept if kept else out.words)(child)
            continue
        tag = child.tag
        box, seen = shown(child, visible)
        if not box or closed and tag != "summary":
            continue
        if svg or tag == "svg":
            # texts of a drawing stand apart from each other
            if tag not in UNDRAWN:
                out.space = True
                yield flow(child, out, seen, kept, depth, tag not in DRAWN)
                out.space = True
        elif node.tag in ("text", "tspan", "textpath") and tag in UNDRAWN:
            continue
        elif tag == "select":
            lines = list(options(child, seen))
            for i, label in enumerate(lines):
                if i:
                    out.end()
                out.words(label)
        elif tag == "br":
            out.end(True)
        elif tag == "img":
            if seen and child.attributes.get("alt"):
                out.words(child.attributes["alt"])
        elif tag == "input":
            kind = child.attributes.get("type", "text").strip().lower()
            label = child.attributes.get("alt" if kind == "image" else "value")
            if seen and label and (kind == "image" or kind not in NO_VALUE):
                out.words(label)
        elif tag == "table":
            out.margin()
            rows = yield table(child, seen)
            if rows:
                out.put(rows)
                out.margin()
        elif tag == "li":
            out.end()
            inner = Lines()
            yield flow(child, inner, seen, kept, depth + 1)
            lines = inner.done()
            mark = f"{number}. " if node.tag == "ol" else "- "
            if lines:
                out.put([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])])
            number += 1
        elif tag in ("dd", "blockquote"):
            (out.margin if tag in MARGIN else out.end)()
            inner = Lines()
            yield flow(child, inner, seen, kept, depth + 1)
            lines = inner.done()
            if lines:
                out.put(["  " + x if x else "" for x in lines])
            (out.margin if tag in MARGIN else out.end)()
        elif tag in BLOCK:
            # a list inside a list has no margin of its own
            wide = tag in MARGIN and not (tag in ("ul", "ol", "menu") and depth)
            (out.margin if wide else out.end)()
            yield flow(child, out, seen, kept or tag == "pre", depth)
            (out.margin if wide else out.end)()
        else:
            yield flow(child, out, seen, kept, depth)


def table(node: Node, visible: bool) -> Generator:
    """The rows of a table with aligned columns; a caption comes first. Cells of several lines are laid side by side."""
    caption, rows = [], []

    def collect(part: Node, visible: bool) -> Generator:
        for child in part.children:
            if isinstance(child, str):
                if visible and child.strip():
                    caption.extend(x for x in [" ".join(child.split())] if x)      # stray text is shown before the table
                continue
            box, seen = shown(child, visible)
            if not box:
                continue
            if child.tag in ("thead", "tbody", "tfoot"):
                yield collect(child, seen)
            elif child.tag == "tr":
                rows.append((child, seen))
            else:
                inner, holder = Lines(), Node("div", {})
                holder.children.append(child)
                yield flow(holder, inner, visible)
                caption.extend(inner.done())

    yield collect(node, visible)
    grid: list[dict[int, list[str]]] = []
    until: dict[int, int] = {}      # the first row of each column that no cell from above reaches
    for r, (row, seen) in enumerate(rows):
        cells, c = {}, 0
        for child in row.children:
            if isinstance(child, str):
                if not (seen and child.strip()):
                    continue
                loose = Node("td", {})
                loose.children.append(child)
                child = loose
            box, visible_cell = shown(child, seen)
            if not box:
                continue
            while until.get(c, 0) > r:
                c += 1
            inner = Lines()
            holder = child if child.tag in ("td", "th") else Node("td", {})
            if holder is not child:
                holder.children.append(child)
            yield flow(holder, inner, visible_cell)
            cells[c] = inner.done()
            across, down = (span(child, k) for k in ("colspan", "rowspan"))
            if down > 1:
                until.update((c + j, max(until.get(c + j, 0), r + down)) for j in range(across))
            c += across
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for c, lines in cells.items():
            widths[c] = max([widths.get(c, 0), *map(len, lines)])
    columns = sorted(c for c, w in widths.items() if w)
    out = list(caption)
    for cells in grid:
        for i in range(max((len(v) for v in cells.values()), default=0)):
            line = "  ".join((cells[c][i] if c in cells and i < len(cells[c]) else "").ljust(widths[c]) for c in columns)
            out.append(line.rstrip())
    return out


def span(cell: Node, kind: str) -> int:
    """Rows or columns of a cell, up to the limits that browsers keep."""
    value = cell.attributes.get(kind, "1").strip()
    return max(1, min(SPANS[kind], int(value[:9]))) if re.fullmatch(r"[0-9]+", value) else 1


def render(page: str | None) -> str:
    """All visible text of a page; an absent or empty page gives an empty text."""
    out = Lines()
    if page:
        laid_out(flow(parse(page), out, True))
    lines = [x.rstrip() for x in out.done()]
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``html_col`` replaced by the rendered text in ``text_col``; other columns and rows are kept.

    A null page gives an empty text. An existing column ``text_col`` is replaced.
    """
    at = pages.columns.index(html_col)
    kept = [i for i, c in enumerate(pages.columns) if c not in (html_col, text_col)]
    schema = pages.drop(html_col, text_col).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([render(page) for page in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), texts], [*(batch.schema.names[i] for i in kept), text_col])

    return pages.mapInArrow(run, schema)
