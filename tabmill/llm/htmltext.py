"""Text of web pages as a reader sees it: a tree with implied tags, visibility rules, and a layout in lines.

The tree builder closes what HTML leaves open (paragraphs, list items, table parts), makes missing table bodies and rows, and
ignores end tags that match nothing. Hidden are the head, scripts and the like, elements with the hidden attribute, closed
dialogs and details, and what inline styles or simple rules of the page's own style sheets (tag, .class, #id) don't display.
Such rules override each other as in a browser (importance, inline, selector, order); those under a condition count if it holds
on a screen of 1280 by 800 pixels. Text in svg and math is text of its line.
Blocks stand in lines of their own, paragraphs and the like apart by an empty line; list items get a dash or their number and
an indent by depth; a table's cells are padded to columns, a cell that spans rows or columns keeps its place, and a cell's own
blocks and breaks stay lines of it, beside the other cells'; preformatted text keeps its spaces. What is displayed but
invisible writes nothing, and what is visible again inside it does.

Cases: null and empty pages give an empty text. Repeated rows and null ids are pages of their own. An empty table gives no
rows. Very long and very deep pages are read whole, in linear time; nothing recurses. Other columns pass through extract()
untouched, but those named page_text or n_lines give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tabmill.llm.text import others

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link base param source track area".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset form hr address".split())
BLOCK = APART | frozenset("html body div section article aside header footer nav main li dt dd tr caption figcaption legend details summary center menu dir hgroup search option optgroup".split())
#: What a start tag closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
#: Start tags that close an open paragraph.
ENDS_P = (APART | {"div", "section", "article", "aside", "header", "footer", "nav", "main", "li", "dt", "dd", "details", "summary", "center", "menu", "figcaption"}) - {"table"}
SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "template", "html"})
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>?", re.S)
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: What svg and math hold but don't show.
FOREIGN_UNSEEN = frozenset("defs symbol desc metadata clippath mask marker pattern lineargradient radialgradient annotation annotation-xml".split())
CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*+(?:\"|\n|\Z)|'(?:[^'\\\n]|\\.)*+(?:'|\n|\Z)|[{};]", re.S)
DECLARED = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*\Z", re.I)
DISPLAY = re.compile(r"(?:none|contents|block|inline|run-in|flow|flow-root|flex|grid|list-item|ruby|table|inline-(?:block|flex|grid|table)|table-[a-z-]+|ruby-[a-z-]+|-webkit-[a-z-]+|initial|inherit|unset|revert)\Z")
SCREEN = {"width": 1280.0, "height": 800.0}
LENGTH = r"([0-9.]+)(px|em|rem)?"
SIZE = re.compile(rf"(min-|max-)?(?:device-)?(width|height)\s*:\s*{LENGTH}")
RANGE = re.compile(rf"(?:{LENGTH}\s*(<=?)\s*)?(width|height)\s*(?:([<>]=?|=)\s*{LENGTH})?")
#: Conditions that hold on such a screen.
HOLD = re.compile(r"orientation\s*:\s*landscape|prefers-color-scheme\s*:\s*light|prefers-reduced-motion\s*:\s*no-preference|(?:any-)?hover(?:\s*:\s*hover)?|(?:any-)?pointer(?:\s*:\s*fine)?|color|scripting\s*:\s*enabled")
SIMPLE = re.compile(r"[.#]?[A-Za-z_][\w-]*\Z")
#: Bytes of pages that are rendered at once.
RUN = 8_000_000
SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("children", "hidden", "rows", "start", "tag", "visible")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1, rows: int = 1, visible: bool | None = None):
        """hidden: not displayed, with all inside; visible: None as its parent; start: a list's first number, or a cell's columns."""
        self.tag, self.hidden, self.start, self.rows, self.visible, self.children = tag, hidden, start, rows, visible, []


def _pixels(number: str, unit: str | None) -> float:
    try:
        return float(number) * (16 if unit in ("em", "rem") else 1)
    except ValueError:
        return float("nan")


def _holds(condition: str) -> bool:
    """One part of a media query."""
    if condition in ("", "all", "screen"):
        return True
    inner = condition.strip("() \t\n")
    if m := SIZE.fullmatch(inner):
        have, want = SCREEN[m.group(2)], _pixels(m.group(3), m.group(4))
        return have >= want if m.group(1) == "min-" else have <= want if m.group(1) == "max-" else have == want
    if m := RANGE.fullmatch(inner):
        have, ok = SCREEN[m.group(4)], True
        if m.group(1):
            low = _pixels(m.group(1), m.group(2))
            ok = low <= have if m.group(3) == "<=" else low < have
        if m.group(5):
            want = _pixels(m.group(6), m.group(7))
            ok = ok and {"<": have < want, "<=": have <= want, ">": have > want, ">=": have >= want, "=": have == want}[m.group(5)]
        return ok
    return condition[:1] == "(" and bool(HOLD.fullmatch(inner))


def on_screen(media: str) -> bool:
    """True if a list of media queries holds on a screen."""
    for q in media.lower().split(","):
        q = q.strip()
        turned = q.startswith("not ")
        q = re.sub(r"^(?:not|only)\s+", "", q)
        if any(all(_holds(c.strip()) for c in re.split(r"\band\b", part)) for part in re.split(r"\bor\b", q)) != turned:
            return True
    return False


def _applies(rule: str) -> bool:
    """True if what an at-rule encloses are rules that apply."""
    name, rest = re.match(r"@([\w-]*)\s*(.*)", rule, re.S).groups()
    if name.lower() == "media":
        return on_screen(rest)
    return name.lower() == "layer" or (name.lower() == "supports" and not rest.lower().startswith("not"))


def declared(text: str) -> tuple[str, str, bool] | None:
    """display or visibility, its value, and whether it's important; None for any other declaration."""
    m = DECLARED.match(text)
    if not m or (m.group(1).lower() == "display" and not all(map(DISPLAY.match, m.group(2).lower().split()))):
        return None
    return m.group(1).lower(), m.group(2).lower(), bool(m.group(3))


def style_rules(css: str, rules: dict[str, dict[str, tuple]] | None = None) -> dict[str, dict[str, tuple]]:
    """What a style sheet declares about simple selectors' display and visibility, added to earlier sheets' rules: by selector and
    property (important, rank of the selector, order, value)."""
    rules = {} if rules is None else rules
    css = re.sub(r"<!--|-->", "", re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S))
    order = sum(map(len, rules.values()))
    within: list[list[str] | None] = []  # selectors of each open block; none for groups of rules, None if it doesn't apply
    at = 0

    def take(text: str) -> None:
        nonlocal order
        if within and within[-1] and (d := declared(text)):
            for n in within[-1]:
                order += 1
                new = (d[2], {"#": 2, ".": 1}.get(n[0], 0), order, d[1])
                own = rules.setdefault(n, {})
                own[d[0]] = max(own.get(d[0], new), new)

    order += max((v[2] for r in rules.values() for v in r.values()), default=0)
    for m in CSS.finditer(css):
        if (c := m.group()) not in "{};":
            continue
        text, at = css[at : m.start()].strip(), m.end()
        if c == "{":
            above = within[-1] if within else []
            if above is None:
                within.append(None)
            elif text.startswith("@"):
                within.append(above if _applies(text) else None)
            else:
                names = [n.strip().lower() for n in text.split(",") if SIMPLE.match(n.strip())]
                within.append(None if above else names or None)
            continue
        take(text)
        if c == "}" and within:
            within.pop()
    take(css[at:])
    return rules


def display(tag: str, attrs: dict[str, str], rules: dict[str, dict[str, tuple]]) -> tuple[bool, bool | None]:
    """Whether an element isn't displayed, and whether it's visible (None: as its parent)."""
    if tag in UNSEEN or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
        return True, None
    found: dict[str, tuple] = {}
    if rules:
        for n in {tag, f"#{attrs.get('id', '').lower()}", *(f".{c}" for c in attrs.get("class", "").lower().split())}:
            for k, v in rules.get(n, {}).items():
                found[k] = max(found.get(k, v), v)
    if "style" in attrs:
        for j, text in enumerate(attrs["style"].split(";")):
            if d := declared(text):
                found[d[0]] = max(found.get(d[0], (False,)), (d[2], 3, j, d[1]))
    seen = found["visibility"][3] if "visibility" in found else "inherit"
    visible = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(seen)
    if "display" not in found and ("hidden" in attrs or (tag == "dialog" and "open" not in attrs)):
        return True, visible
    return "display" in found and found["display"][3] == "none", visible


def _number(attrs: dict[str, str], name: str) -> int:
    value = attrs.get(name, "1").strip()
    return int(value) if re.fullmatch(r"[0-9]{1,3}", value) else 1


def parse(html: str) -> Node:
    """The page's tree."""
    rules: dict[str, dict[str, tuple]] = {}
    for raw, css in re.findall(r"<style\b([^>]*)>(.*?)(?:</style|\Z)", html, re.S | re.I) if re.search("<style", html, re.I) else []:
        if on_screen({k.lower(): unescape(a or b or c or "") for k, a, b, c in ATTR.findall(raw)}.get("media", "")):
            style_rules(css, rules)
    root = Node("html")
    stack, opened = [root], {"html": 1}

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    def push(tag: str, hidden: bool = False, start: int = 1, rows: int = 1, visible: bool | None = None) -> None:
        node = Node(tag, hidden, start, rows, visible)
        stack[-1].children.append(node)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1

    def close(tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> bool:
        """Ends the nearest of the tags, and what is open inside it, if it's nearer than `until`."""
        if not any(opened.get(t) for t in tags):
            return False
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    pop()
                return True
            if stack[k].tag in until:
                return False
        return False

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(unescape(s) if "&" in s else s)

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        if m.group(1) or m.group(4):
            if tag in ("p", "br") and not opened.get(tag):
                push(tag)
                pop()
            elif tag not in ("html", "body", *VOID) and opened.get(tag):
                close({tag}, {"table"} if tag not in ("table",) and opened.get("table") and tag not in CLOSES and tag not in ("caption",) else set())
            continue
        raw = m.group(3) or m.group(6) or ""
        attrs = {k.lower(): unescape(a or b or c or "") for k, a, b, c in ATTR.findall(raw)} if raw.strip(" /\n\t") else {}
        if tag == "html":
            continue
        if tag in ENDS_P and opened.get("p"):
            close({"p"}, SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif opened.get("head") and tag not in UNSEEN and stack[-1].tag == "head":
            pop()  # the body begins
        if tag in ("td", "th", "tr") and opened.get("table"):
            if stack[-1].tag == "table":
                push("tbody")
            if tag != "tr" and stack[-1].tag in ("tbody", "thead", "tfoot"):
                push("tr")
        foreign = opened.get("svg") or opened.get("math")
        hidden, visible = display(tag, attrs, rules)
        hidden = hidden or bool(foreign and tag in FOREIGN_UNSEEN)
        if (foreign or tag in ("svg", "math")) and raw.endswith("/") and tag not in VOID:
            continue  # such an element is empty
        if foreign and tag == "text":
            text(" ")  # texts of a drawing stand apart
        if tag == "details" and "open" not in attrs:
            push("details", hidden, -1, visible=visible)
            continue
        start, down = (_number(attrs, "start" if tag == "ol" else "colspan"), _number(attrs, "rowspan")) if attrs else (1, 1)
        push(tag, hidden, start, down, visible)
        if tag in VOID:
            pop()
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            if tag in ("textarea", "title"):
                text(html[at : end.start() if end else n])
            at = html.find(">", end.start()) + 1 or n if end else n
            pop()
    return root


class Page:
    """Lines that a block writes, with the spaces and empty lines between them."""

    def __init__(self, indent: str = ""):
        self.lines: list[str] = []
        self.part: list[str] = []
        self.gap, self.indent, self.mark, self.raw = False, indent, "", False

    def flush(self, apart: bool = False) -> None:
        line = "".join(self.part)
        self.part = []
        if line.strip(" \t\n"):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            first, *rest = (line.rstrip(" ") if self.raw else line.strip(" ")).removesuffix("\n").split("\n")  # a break at a block's end makes no line
            self.lines.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark + first)
            self.lines += [(self.indent + x) if x else x for x in rest]
            self.mark = ""
        self.raw = False
        self.gap = self.gap or apart

    def add(self, s: str, keep: bool) -> None:
        self.raw = self.raw or keep
        if not keep:
            s = SPACES.sub(" ", s)
            if s[:1] == " " and (not self.part or self.part[-1][-1:] in (" ", "\n")):
                s = s[1:]
        if s:
            self.part.append(s)


def align(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table whose rows hold (lines, columns, rows); each column as wide as its widest line in cells of one column.
    A row has as many lines as its highest cell; a cell of several rows stands in the first one and leaves its place free below."""
    placed, held = [], {}
    for r in rows:
        own, c = [], 0
        for lines, span, down in r:
            while held.get(c):
                c += 1
            own.append((c, lines, span))
            for j in range(c, c + span):
                held[j] = down or len(rows)
            c += span
        held = {c: n - 1 for c, n in held.items() if n > 1}
        placed.append(own)
    width: dict[int, int] = {}
    for own in placed:
        for c, lines, span in own:
            if span == 1:
                width[c] = max(width.get(c, 0), *map(len, lines), 0)
    edge, at = {0: 0}, 0
    for c in range(max((c + span for own in placed for c, _, span in own), default=0)):
        at += width.get(c, 0) + 3
        edge[c + 1] = at
    out = []
    for own in placed:
        for k in range(max((len(lines) for _, lines, _ in own), default=0)):
            line, last = "", max(j for j, (_, lines, _) in enumerate(own) if k < len(lines)) if k else len(own)
            for j, (c, lines, _) in enumerate(own):
                if c and j <= last:
                    line = line.ljust(edge[c] - 3) + " | "
                line += lines[k] if k < len(lines) else ""
            out.append(line.rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    pages, tables, lists, pre, shown = [Page()], [], [], 0, [True]
    todo: list[tuple[str, object]] = [("in", root)]
    while todo:
        what, x = todo.pop()
        page = pages[-1]
        if isinstance(x, str):
            if shown[-1]:
                page.add(x, pre > 0)
            continue
        tag = x.tag
        if what == "in":
            if x.hidden:
                continue
            if tag == "br":
                if shown[-1]:
                    page.part.append("\n")
                continue
            if tag in ("hr", "img", "input"):
                if tag == "hr":
                    page.flush(True)
                continue
            if tag in BLOCK:
                page.flush(tag in APART and not (tag in ("ul", "ol") and lists))
            todo.append(("out", x))
            shown.append(shown[-1] if x.visible is None else x.visible)
            kids = x.children
            if x.start == -1 and tag == "details":
                kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
            if tag == "table":
                tables.append([])
                kids = [k for k in kids if isinstance(k, Node) or k.strip()]
            elif tag == "tr" and tables:
                tables[-1].append([])
                kids = [k for k in kids if isinstance(k, Node) or k.strip()]
            elif tag in ("td", "th") and tables:
                pages.append(Page())
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag, x.start])
            elif tag == "li":
                mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                if lists:
                    lists[-1][1] += 1
                page.indent, page.mark = page.indent + " " * len(mark), mark
                x.start = len(mark)
            elif tag == "dd":
                page.indent += "  "
            elif tag == "blockquote":
                page.indent += "  "
            elif tag == "pre":
                pre += 1
                if kids and isinstance(kids[0], str) and kids[0][:1] == "\n":
                    kids = [kids[0][1:], *kids[1:]]
            todo += [("in", k) for k in reversed(kids)]
            continue
        shown.pop()
        if tag in ("td", "th") and tables:
            page.flush()
            pages.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((page.lines, max(1, x.start), x.rows))
            continue
        if tag == "table":
            page.flush(True)
            rows = align([r for r in tables.pop() if r])
            if any(rows):
                if page.gap and page.lines:
                    page.lines.append("")
                page.lines += [page.indent[: len(page.indent) - len(page.mark)] + page.mark + rows[0], *(page.indent + r if r else "" for r in rows[1:])]
                page.mark = ""
            page.gap = True
            continue
        if tag in BLOCK:
            page.flush(tag in APART and not (tag in ("ul", "ol") and len(lists) > 1))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            page.indent, page.mark = page.indent[: len(page.indent) - x.start], ""
        elif tag in ("dd", "blockquote"):
            page.indent = page.indent[:-2]
        elif tag == "pre":
            pre -= 1
    pages[0].flush()
    return "\n".join(line.rstrip(" ") for line in pages[0].lines)


def page_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns but html, with page_text and n_lines (those that aren't empty)."""
    rest = others(pages, html, "page_text", "n_lines")
    kinds = dict(pages.dtypes)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows of about RUN bytes, so that memory doesn't follow a batch's rows."""
        for b in batches:
            size, first = np.cumsum(pc.fill_null(pc.binary_length(b.column(html)), 0).to_numpy(zero_copy_only=False)), 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + RUN)))
                yield b.slice(first, last - first)
                first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [page_text(x.as_py()) for x in b.column(html)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(got, pa.string()), pa.array([sum(1 for x in g.split("\n") if x) for g in got], pa.int64())], names=[*rest, "page_text", "n_lines"])

    return pages.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "page_text string, n_lines long"]))
