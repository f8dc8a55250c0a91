"""Operator 9: layout-aware text of HTML pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object svg canvas audio video datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table"
    " caption thead tbody tfoot tr td th ul".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li option optgroup summary legend caption thead tbody tfoot tr td th".split()) | {"hr"}
# An opening tag on the left ends the open elements on the right, up to the nearest boundary.
IMPLIED_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("td", "th", "tr", "caption", "colgroup"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"), "thead": ("td", "th", "tr", "tbody", "caption", "colgroup"), "tfoot": ("td", "th", "tr", "thead", "tbody", "caption", "colgroup"),
}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)} | dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",))

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_UNQUOTED = re.compile(r"<[^>]*>?")
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
_INTEGER = re.compile(r"-?[0-9]{1,9}\Z")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Open:
    """The open elements, and where those of each name stand, so that no step looks through all of them."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of one of ``tags``; 0, the root's, for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, place: int) -> None:
        for node in self.stack[place:]:
            self.at[node.tag].pop()
        del self.stack[place:]

    def end(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """An implied end: of the innermost of ``tags``, unless an element of ``scope`` stands within it, and of those around."""
        place = self.last(tags)
        if place > self.last(scope):
            while place > 1 and self.stack[place - 1].tag in tags:
                place -= 1
            self.cut(place)


def parse(source: str) -> Node:
    """The element tree: void and raw-text elements, implied end tags, implied ``tr`` and ``tbody``-less tables.

    Every tag costs the same however deep it stands.
    """
    root = Node("#root", {})
    is_open, at, n = _Open(root), 0, len(source)
    while at < n:
        m = _PIECE.match(source, at)
        if m is None:  # a tag whose quote never ends
            m = _UNQUOTED.match(source, at)
        at = m.end()
        piece = m.group()
        if piece[0] != "<" or piece == "<":
            is_open.top().children.append(html.unescape(piece))
        elif m.re is _PIECE and m.group(1):
            tag = m.group(1).lower()
            place = is_open.last((tag,))
            if tag == "br" or (tag == "p" and not place):
                is_open.top().children.append(Node(tag, {}))
            elif place and (tag in ("table", "tr", "tbody", "thead", "tfoot") or is_open.last(("table", "td", "th")) <= place):
                is_open.cut(place)
        elif m.re is _PIECE and m.group(2):
            tag, inside = m.group(2).lower(), m.group(3)
            attrs = {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(inside)} if inside.strip(" /\n\t") else {}
            if tag in IMPLIED_END:
                is_open.end(IMPLIED_END[tag], SCOPE[tag])
            if tag in CLOSES_P:
                is_open.end(("p",), ("table", "td", "th", "button", "caption"))
            if tag in ("td", "th") and is_open.top().tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr", {})
                is_open.top().children.append(row)
                is_open.push(row)
            node = Node(tag, attrs)
            is_open.top().children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                text = source[at : end.start() if end else n]
                if text:
                    node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
                at = end.end() if end else n
            elif tag not in VOID and not (inside.endswith("/") and tag in ("svg", "path")):
                is_open.push(node)
    return root


def displayed(node: Node) -> bool:
    """Whether an element has a box at all; what stands in one without is not seen."""
    a = node.attrs
    if node.tag in UNSEEN or (a and ("hidden" in a or _NO_DISPLAY.search(a.get("style", "")))):
        return False
    return node.tag != "input" or a.get("type", "").lower() in ("button", "submit", "reset")


def shows(node: Node, inherited: bool) -> bool:
    """Whether an element's own text is seen: its last word on visibility, else what it inherits."""
    found = _VISIBILITY.findall(node.attrs.get("style", "")) if node.attrs else ()
    return found[-1].lower() == "visible" if found else inherited


def _integer(text: str | None) -> int | None:
    return int(text) if text and _INTEGER.match(text.strip()) else None


class _Lines:
    """Text lines under construction: collapses white space, keeps at most one blank line between blocks."""

    def __init__(self):
        self.lines, self.now, self.space, self.gap, self.prefix, self.mark = [], [], False, False, "", ""

    def text(self, s: str, keep: bool = False) -> None:
        if keep:
            first, *rest = s.split("\n")
            self._add(first)
            for x in rest:
                self.newline(True)
                self._add(x)
            return
        words = _SPACE.sub(" ", s)
        if words == " ":
            self.space = self.space or bool(self.now)
            return
        lead, words = words[0] == " ", words.strip(" ")
        if not words:
            return
        self._add(" " * ((self.space or lead) and bool(self.now)) + words)
        self.space = s[-1] in " \t\n\r\f"

    def _add(self, s: str) -> None:
        if s:
            self.now.append(s)
            self.space = False

    def newline(self, force: bool = False) -> None:
        if self.now or self.mark or force:
            line = "".join(self.now).rstrip(" ")
            if self.gap and self.lines and (line or self.mark):
                self.lines.append("")
            self.gap = self.gap and not (line or self.mark)
            self.lines.append(f"{self.prefix[: len(self.prefix) - len(self.mark)]}{self.mark}{line}".rstrip(" "))
            self.now, self.mark = [], ""
        self.space = False

    def block(self, spaced: bool) -> None:
        if self.now:
            self.newline()
        self.space = False
        self.gap = self.gap or (spaced and bool(self.lines))

    def done(self) -> str:
        self.newline()
        return "\n".join(self.lines).strip("\n")


def render(root: Node, widest: int = 40, depth: int = 0, shown: bool = True) -> str:
    """All visible text: blocks on their own lines, list items marked and indented, table cells in aligned columns.

    ``widest`` bounds the padding of a column, not its text.  The walk keeps its own stack, so nesting has no limit; tables
    within tables are laid out to a depth of 8, below that their cells are blocks.
    """
    out = _Lines()
    work: list = [(root, None, shown)]
    lists: list[list] = []
    pre = 0
    while work:
        node, leave, seen = work.pop()
        if leave is not None:
            leave()
            continue
        if isinstance(node, str):
            if seen:
                out.text(node, pre > 0)
            continue
        if not displayed(node):
            continue
        tag, seen = node.tag, shows(node, seen)
        if tag == "br":
            out.newline(True)
        elif tag == "hr":
            out.block(True)
        elif tag == "img":
            if seen and node.attrs.get("alt"):
                out.text(node.attrs["alt"])
        elif tag == "input":
            out.text(node.attrs.get("value", "") if seen else "")
        elif tag == "table" and depth < 8:
            out.block(True)
            for line in table_lines(node, widest, depth, seen):
                out.text(line, True)
                out.newline(True)
            out.gap = True
        else:
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag in BLOCK:
                out.block(tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")))
                before = out.prefix
                if tag in ("ul", "ol", "menu", "dir"):
                    start = _integer(node.attrs.get("start"))
                    lists.append([1 if start is None else start] if tag == "ol" else [])
                elif tag == "li":
                    own = lists[-1] if lists else []
                    if own and (value := _integer(node.attrs.get("value"))) is not None:
                        own[0] = value
                    mark = f"{own[0]}. " if own else "- "
                    if own:
                        own[0] += 1
                    out.prefix, out.mark = before + " " * len(mark), mark if seen else ""
                elif tag in ("blockquote", "dd"):
                    out.prefix = before + "  "
                pre += tag == "pre"

                def leave(tag=tag, before=before, spaced=tag in SPACED):
                    nonlocal pre
                    if out.mark and not out.now:
                        out.mark = ""
                    if tag in ("ul", "ol", "menu", "dir"):
                        lists.pop()
                        spaced = not lists
                    pre -= tag == "pre"
                    out.block(spaced)
                    out.prefix = before

                work.append((None, leave, seen))
            work.extend((c, None, seen) for c in reversed(children))
    return out.done()


def table_lines(table: Node, widest: int, depth: int, shown: bool = True) -> Iterator[str]:
    """A table's rows, cells padded to their columns' widths; ``colspan`` leaves empty columns, ``rowspan`` empty cells."""
    rows: list[list[list[str]]] = []
    captions: list[str] = []
    spans: dict[int, int] = {}
    work = [(c, shown) for c in reversed(table.children)]
    while work:
        node, seen = work.pop()
        if isinstance(node, str):
            if seen and node.strip():
                captions.append(_SPACE.sub(" ", node).strip())
            continue
        if not displayed(node):
            continue
        inherited, seen = seen, shows(node, seen)
        if node.tag in ("thead", "tbody", "tfoot", "form"):
            work.extend((c, seen) for c in reversed(node.children))
        elif node.tag == "tr":
            row: list[list[str]] = []
            for cell in node.children:
                while spans.get(len(row), 0):
                    spans[len(row)] -= 1
                    row.append([])
                if isinstance(cell, str):
                    if seen and cell.strip():
                        row.append([_SPACE.sub(" ", cell).strip()])
                elif displayed(cell):
                    inner, own = Node("#cell", {}), cell.tag in ("td", "th")
                    inner.children = cell.children if own else [cell]
                    text = render(inner, widest, depth + 1, shows(cell, seen) if own else seen).split("\n")
                    wide, tall = (min(int(v), 1000) if (v := cell.attrs.get(k, "")).isascii() and v.isdigit() and len(v) < 6 else 1 for k in ("colspan", "rowspan"))
                    for i in range(max(1, wide)):
                        spans[len(row)] = max(0, tall - 1)
                        row.append([] if i else text)
            rows.append(row)
        else:
            captions.append(render(node, widest, depth + 1, inherited))
    yield from (x for c in captions if c for x in c.split("\n"))
    widths: dict[int, int] = {}
    for row in rows:
        for i, cell in enumerate(row):
            widths[i] = max(widths.get(i, 0), max((min(len(x), widest) for x in cell), default=0))
    for row in rows:
        for k in range(max((len(c) for c in row), default=0)):
            yield "  ".join((c[k] if k < len(c) else "").ljust(widths[i]) for i, c in enumerate(row)).rstrip()


def page_text(source: str | None) -> str:
    return render(parse(source)) if source else ""


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, the columns in ``keep``, ``text`` (all visible text with its layout), ``n_chars`` and ``n_lines`` of every page.

    A null or empty page gives an empty text with no lines.  Unclosed, crossed or unknown tags never fail: the tree builder
    follows the standard's implied end tags and closes what is left open at the end.  Rows with null or repeated ids are
    kept as they are; columns other than those named are ignored; one of the result's own names in ``keep`` is an error.  A
    map over rows: no shuffle, one batch in memory.
    """
    if clash := {"id", "text", "n_chars", "n_lines", "_html"} & set(keep):
        raise ValueError(f"columns to keep clash with the result's: {sorted(clash)}")
    rows = pages.select(F.col(id_col).alias("id"), *keep, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string, n_chars long, n_lines long"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(x) for x in batch.column("_html").to_pylist()]
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            counts = [pa.array([len(x) for x in texts], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), *counts], [*batch.schema.names[:-1], "text", "n_chars", "n_lines"])

    return rows.mapInArrow(extract, schema)
