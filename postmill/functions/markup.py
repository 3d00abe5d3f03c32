"""HTML to Markdown: elements are opened and closed as the parser meets them, each written when it closes.

A closed element is one piece of its parent, so a page needs one walk and the memory of its open elements. Marks are put around
a text without copying it, so elements that are left open by the thousand cost no more than others. Runs in Arrow
batches; null stays null, and no markup, however broken, ends a job.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS = ("ul", "ol")
CELLS = ("td", "th")
#: Elements whose edges take no white space, neither inside nor beside them.
BLOCKS = {*HEADINGS, *LISTS, *CELLS, "p", "blockquote", "article", "div", "section", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
VERBATIM = {"pre", "code", "kbd", "samp"}
MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}
#: Elements that write something before each line within, so that lines grow with their depth: below MOST_DEPTH of them such
#: elements are not opened, their text belongs to the element at it. All others are opened at any depth.
INDENTED = {"blockquote", "li", "dd"}
MOST_DEPTH = 200
MOST_COLUMNS = 1000


class _Text:
    """A closed element's text in parts: what is done at its ends costs nothing by its length."""

    def __init__(self, text: str = "") -> None:
        self.parts: deque[str] = deque([text] if text else ())

    def __bool__(self) -> bool:
        return bool(self.parts)

    def __str__(self) -> str:
        return "".join(self.parts)

    def put(self, before: str, after: str) -> _Text:
        if before:
            self.parts.appendleft(before)
        if after:
            self.parts.append(after)
        return self

    def take(self, other: _Text) -> None:
        """The other's parts follow; the fewer parts are moved."""
        if len(other.parts) > len(self.parts):
            other.parts.extendleft(reversed(self.parts))
            self.parts = other.parts
        else:
            self.parts.extend(other.parts)

    def cut_left(self, chars: str | None = None) -> int:
        """Strips the left end; how many characters are gone."""
        gone = 0
        while self.parts:
            first = self.parts.popleft()
            left = first.lstrip(chars)
            gone += len(first) - len(left)
            if left:
                self.parts.appendleft(left)
                break
        return gone

    def cut_right(self, chars: str | None = None) -> int:
        gone = 0
        while self.parts:
            last = self.parts.pop()
            left = last.rstrip(chars)
            gone += len(last) - len(left)
            if left:
                self.parts.append(left)
                break
        return gone

    def strip(self, chars: str | None = None) -> _Text:
        self.cut_left(chars)
        self.cut_right(chars)
        return self

    def blank(self) -> bool:
        return not any(x.strip() for x in self.parts)

    def is_body(self, text: str) -> bool:
        """True if that is the text without white space at its ends; read no farther than they agree."""
        at = 0
        for x in self.parts:
            x = x if at else x.lstrip()
            if not text.startswith(x, at):
                return text.startswith(x.rstrip(), at) and str(self).strip() == text
            at += len(x)
        return at == len(text)


class _Element:
    """An open element: the pieces of its closed children, and what its place among the open ones asks for."""

    def __init__(self, tag: str, attrs: dict, parent: _Element | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.pieces: list[_Text] = []
        self.last: str | None = None  # what the last child was: a tag, "text" or "comment"
        self.items = self.columns = self.rows = 0
        self.headed = True  # a row of header cells only
        above = parent or self
        up = (lambda name: getattr(above, name)) if parent else (lambda name: False)
        self.one_line = up("one_line") or bool(parent and parent.tag in (*HEADINGS, *CELLS))
        self.verbatim = up("verbatim") or bool(parent and parent.tag in VERBATIM)
        self.kept = up("kept") or tag == "pre"  # white space is kept
        self.in_item = up("in_item") or bool(parent and parent.tag == "li")

    def ends(self, beside: bool) -> None:
        """The last text ends here: its white space goes at the edge of a block."""
        if beside and self.last == "text" and not self.kept:
            self.pieces[-1].cut_right(" \t\r\n")

    def text(self) -> _Text:
        """The pieces in one; where two meet, their line ends count as the longer of both, two at most."""
        out = _Text()
        open_lines = 0
        for x in self.pieces:
            if self.kept:
                out.take(x)
                continue
            before = x.cut_left("\n")
            if out and open_lines and before:
                before = min(2, max(open_lines, before))
            else:
                before += open_lines
            open_lines = x.cut_right("\n") if x else before
            if x:
                out.put("", "\n" * before)
                out.take(x)
        return out.put("", "\n" * open_lines)


def _around(text: _Text, left: str, right: str) -> _Text:
    """Marks around the text's body; one blank on either side stays outside."""
    if text.blank():
        return _Text()
    first, last = text.parts[0].startswith(" "), text.parts[-1].endswith(" ")
    return text.strip().put(" " * first + left, right + " " * last)


def _shifted(text: str, first: str, other: str) -> str:
    """Lines after the first prefix and the other ones; blank lines stay bare."""
    lines = text.split("\n")
    return "\n".join([first + lines[0], *((other + x) if x else other.rstrip() for x in lines[1:])])


def _block(e: _Element, text: _Text) -> _Text:
    text.strip(" \t\r\n")
    side = " " if e.one_line else "\n\n" if text else ""
    return text.put(side, side)


def _heading(e: _Element, text: str) -> str:
    return text if e.one_line else f"\n\n{'#' * int(e.tag[1])} {' '.join(text.split())}".rstrip() + "\n\n"


def _quote(e: _Element, text: str) -> str:
    body = text.strip(" \t\r\n")
    return f" {body} " if e.one_line else body and f"\n\n{_shifted(body, '> ', '> ')}\n\n"


def _list(e: _Element, text: _Text) -> _Text:
    if e.in_item:
        text.cut_right()
    return text.put("\n" if e.in_item else "\n\n", "")


def _item(e: _Element, text: str) -> str:
    body = text.strip()
    mark = "* "
    if e.parent and e.parent.tag == "ol":
        start = e.parent.attrs.get("start") or ""
        mark = f"{(int(start) if re.fullmatch('[0-9]{1,9}', start) else 1) + e.parent.items}. "
    return _shifted(body, mark, " " * len(mark)) + "\n" if body else "\n"


def _link(e: _Element, text: _Text) -> _Text:
    href, title = e.attrs.get("href"), (e.attrs.get("title") or "").replace('"', r"\"")
    if e.verbatim or not href:
        return text if e.verbatim or not text.blank() else _Text()
    if not title and text.is_body(href):
        return _around(text, "<", ">")
    return _around(text, "[", f"]({href}" + (f' "{title}")' if title else ")"))


def _image(e: _Element, text: str) -> str:
    alt, src, title = (e.attrs.get(k) or "" for k in ("alt", "src", "title"))
    name = title.replace('"', r"\"")
    return alt if e.one_line else f"![{alt}]({src}" + (f' "{name}")' if name else ")")


def _marked(e: _Element, text: _Text) -> _Text:
    return text if e.verbatim else _around(text, MARKS[e.tag], MARKS[e.tag])


def _code(e: _Element, text: _Text) -> _Text:
    if e.verbatim:
        return text
    ticks = max(map(len, re.findall("`+", str(text))), default=0)
    pad = " " if ticks else ""
    return _around(text, "`" * (ticks + 1) + pad, pad + "`" * (ticks + 1))


def _pre(e: _Element, text: _Text) -> _Text:
    return text.strip("\r\n").put("\n\n```\n", "\n```\n\n") if text else text


def _cell(e: _Element, text: str) -> str:
    return f" {' '.join(text.split(chr(10))).strip()} |" + " |" * (_span(e) - 1)


def _span(e: _Element) -> int:
    span = e.attrs.get("colspan") or ""
    return min(max(int(span), 1), MOST_COLUMNS) if re.fullmatch("[0-9]{1,9}", span) else 1


def _table_of(e: _Element) -> _Element | None:
    above = e.parent
    while above and above.tag != "table":
        above = above.parent
    return above


def _row(e: _Element, text: str) -> str:
    """A row; a table's first one gets a line of dashes, below itself if it is a header and else below an empty one."""
    table, row, dashes = _table_of(e), f"|{text}\n", "| " + " | ".join(["---"] * e.columns) + " |\n"
    if table is None or table.rows or not e.columns:
        return row
    if e.headed or e.parent.tag == "thead":
        return row + dashes
    return "| " + " | ".join([""] * e.columns) + " |\n" + dashes + row


def _table(e: _Element, text: str) -> str:
    return f"\n\n{text.strip()}\n\n"


def _definition(e: _Element, text: str) -> str:
    body = text.strip()
    return f" {body} " if e.one_line else body and _shifted(body, ":   ", "    ") + "\n"


def _term(e: _Element, text: str) -> str:
    body = " ".join(text.split())
    return f" {body} " if e.one_line else body and f"\n\n{body}\n"


def _nothing(e: _Element, text: str) -> str:
    return ""


#: What an element writes; rules of ENDS touch only the ends of a text.
RULES = {
    **dict.fromkeys(HEADINGS, _heading), **dict.fromkeys(CELLS, _cell), **dict.fromkeys(("script", "style"), _nothing), "blockquote": _quote, "li": _item, "img": _image,
    "tr": _row, "table": _table, "dt": _term, "dd": _definition, "br": lambda e, text: " " if e.one_line else "  \n", "hr": lambda e, text: "\n\n---\n\n",
}
ENDS = {
    **dict.fromkeys(("p", "div", "article", "section", "dl", "figcaption", "caption"), _block), **dict.fromkeys(LISTS, _list), **dict.fromkeys(MARKS, _marked), **dict.fromkeys(("code", "kbd", "samp"), _code),
    "a": _link, "pre": _pre, "q": lambda e, text: text.put('"', '"'),
}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.root = _Element("", {}, None)
        self.indents = 0
        self.opened: Counter[str] = Counter()
        self.too_deep: Counter[str] = Counter()
        self.data: list[str] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # as browsers do; the parser's own way raises on unknown sections

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def _text(self) -> None:
        """What was read since the last tag is one text."""
        text, e = "".join(self.data), self.top
        self.data = []
        if not text:
            return
        if e.last in LISTS and text.strip():
            e.pieces[-1].put("", "\n")
        if not e.kept:
            text = re.sub(r"[\t ]+", " ", re.sub(r"[\t \r\n]*[\r\n][\t \r\n]*", "\n", text))
            if e.last in BLOCKS or e.last == "pre" or e.last is None and e.tag in BLOCKS:
                text = text.lstrip(" \n")
        e.pieces.append(_Text(text))
        e.last = "text"

    def handle_comment(self, data: str) -> None:
        self._text()
        self.top.last = "comment"

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._text()
        e = self.top
        if self.indents >= MOST_DEPTH and tag in INDENTED:
            self.too_deep[tag] += 1
            return
        e.ends(tag in BLOCKS or tag == "pre")
        if e.last in LISTS and tag not in LISTS:
            e.pieces[-1].put("", "\n")
        self.top = _Element(tag, dict(attrs), e)
        self.indents += tag in INDENTED
        self.opened[tag] += 1
        if tag in VOID:
            self._close()

    def handle_endtag(self, tag: str) -> None:
        self._text()
        if self.too_deep[tag]:
            self.too_deep[tag] -= 1
        elif self.opened[tag]:
            while self.top.tag != tag:
                self._close()
            self._close()

    def _close(self) -> None:
        e = self.top
        up = e.parent
        e.ends(e.tag in BLOCKS)
        text = e.text()
        up.pieces.append(_Text(RULES[e.tag](e, str(text))) if e.tag in RULES else ENDS[e.tag](e, text) if e.tag in ENDS else text)
        up.last = e.tag
        if e.tag == "li":
            up.items += 1
        elif e.tag in CELLS:
            up.columns += _span(e)
            up.headed = up.headed and e.tag == "th"
        elif e.tag == "tr":
            table = _table_of(e)
            if table:
                table.rows += 1
        self.top = up
        self.indents -= e.tag in INDENTED
        self.opened[e.tag] -= 1

    def written(self) -> str:
        self.close()
        self._text()
        while self.top is not self.root:
            self._close()
        return str(self.root.text())


def _convert(x: str | None) -> str | None:
    if x is None:
        return None
    writer = _Writer()
    writer.feed(x)
    return writer.written().strip()


@F.pandas_udf(StringType())
def markdown(html: pd.Series) -> pd.Series:
    """Markdown of a page or fragment: headings by #, items by * or numbers, emphasis by *, nothing escaped, no blanks at its ends."""
    return html.map(_convert)


@F.pandas_udf(ArrayType(StringType()))
def markdown_all(parts: pd.Series) -> pd.Series:
    """markdown() of each element."""
    return parts.map(lambda xs: None if xs is None else [_convert(x) for x in xs])


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references resolved once."""
    return text.map(lambda x: None if x is None else unescape(x))
