"""Text of pages whose tags do not nest: one pass over the tags with the stack of open elements.

``text.html_clean`` reads well-nested pages with expressions of the JVM. Which element a closing tag ends, and where
an element that is never closed ends, needs the open elements, whose number has no bound; such pages come here.
"""

from __future__ import annotations

import html.entities
import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python workers get these functions with the plan and need not find the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements whose text is not shown, and elements that have no content.
HIDDEN = frozenset(("script", "style", "nav", "footer", "header", "template", "rt", "rp"))
EMPTY = frozenset(
    (
        "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex",
        "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
    )
)

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>)", re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])([^\s"'/=<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_END = {name: re.compile(rf"</{name}[^>]*>", re.I) for name in ("script", "style")}
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")


def _decoded(match: re.Match) -> str:
    """A reference as its character; an unknown name is text, without the semicolon."""
    whole = match[0]
    if whole[1] == "#" or whole.endswith(";") and whole[1:] in html.entities.html5 or f"{whole[1:]};" in html.entities.html5:
        return html.unescape(whole if whole.endswith(";") else f"{whole};")
    return whole.removesuffix(";")


def _attribute(rest: str, name: str) -> str | None:
    for found in _ATTRIBUTE.finditer(rest):
        if found[1].lower() == name:
            return html.unescape(next(v for v in found.groups()[1:] if v is not None))
    return None


def _date(script: str) -> str | None:
    try:
        data = json.loads(script)
    except ValueError:
        return None
    value = data.get("datePosted") if isinstance(data, dict) else None
    return f"datePosted: {value if isinstance(value, str) else json.dumps(value)}" if value else None


class Element:
    """What a listing is read from: where an element hangs, what it looks like, and which text nodes stand in it."""

    __slots__ = ("parent", "look", "first", "last", "href", "link", "heading")

    def __init__(self, parent: int, look: tuple[str, str], first: int):
        self.parent, self.look, self.first, self.last = parent, look, first, first
        self.href = self.link = self.heading = None


def _fold(page: str, elements: list[Element] | None = None) -> list[str]:
    """Visible text nodes of a page; ``elements`` gets the elements that are not hidden, in page order.

    A closing tag ends its element and all that are open inside of it; one without an open element means nothing. A
    comment, script or style that is not closed takes the rest of the page.
    """
    nodes: list[str] = []
    part: list[str] = []
    stack: list[str] = []
    open_: list[int] = []  # of each open element its number in ``elements``
    count: dict[str, int] = {}
    hidden = 0  # number of open elements with the outermost hidden one, 0 outside of any
    at, end = 0, page.rfind(">") + 1  # behind the last tag's end there is only text

    def flush() -> None:
        if part:
            if text := "".join(part).strip():
                nodes.append(text)
            part.clear()

    def show(begin: int, stop: int) -> None:
        if begin < stop and not hidden:
            part.append(_REFERENCE.sub(_decoded, page[begin:stop]))

    def opened(name: str, rest: str) -> None:
        element = Element(open_[-1] if open_ else -1, (name, _attribute(rest, "class") or ""), len(nodes))
        elements.append(element)
        open_.append(len(elements) - 1)
        if name == "a":
            element.href = _attribute(rest, "href")

    def closed(name: str) -> None:
        number = open_.pop()
        element = elements[number]
        element.last = len(nodes)
        heading = len(name) == 2 and name[0] == "h" and name[1] in "123456"
        above = elements[element.parent] if element.parent >= 0 else None
        if element.href is not None and name == "a":
            element.link = (element.first, element.last)
        if heading:
            element.heading = (element.first, element.last)
        if above is not None:  # the first of each kind counts
            if above.href is None:
                above.href, above.link = element.href, element.link
            above.heading = above.heading or element.heading

    while True:
        start = page.find("<", at, end)
        found = _TAG.search(page, start, end) if start >= 0 else None
        if found is None and page.find("<!--", at) >= 0:
            show(at, page.find("<!--", at))
            break
        show(at, found.start() if found else len(page))
        if found is None:
            break
        at = found.end()
        flush()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["close"]:
            if count.get(name):
                while True:
                    last = stack.pop()
                    count[last] -= 1
                    if elements is not None and len(open_) > len(stack):
                        closed(last)
                    if last == name:
                        break
                if len(stack) < hidden:
                    hidden = 0
            continue
        if name in _END:
            close = _END[name].search(page, at)
            body = page[at : close.start() if close else len(page)]
            if name == "script" and not hidden and (_attribute(found["rest"], "type") or "").lower() == "application/ld+json":
                if date := _date(body):
                    part.append(date)
                    flush()
            if close is None:
                break
            at = close.end()
            continue
        if name in EMPTY or found["rest"].endswith("/"):
            continue
        stack.append(name)
        count[name] = count.get(name, 0) + 1
        if not hidden:
            shown = _attribute(found["rest"], "datetime") if name == "time" else None
            if shown is not None:
                part.append(shown)
                flush()
            if shown is not None or name in HIDDEN:
                hidden = len(stack)
            elif elements is not None:
                opened(name, found["rest"])
    flush()
    while open_:
        closed(stack[len(open_) - 1])
    return nodes


def page_text(page: str) -> str:
    """Visible text of a page, one stripped text node a line."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(_fold(page)))


LEAST_ITEMS = 3


def page_items(page: str) -> list[dict[str, str]]:
    """Items of a listing (href, title, text): children of one element that look alike, each with a link of its own.

    Of several such groups the one with the most text counts, of equal ones the first. The title is the item's first heading,
    else the text of its first link, else its first line. A page without a group of ``LEAST_ITEMS`` has none.
    """
    elements: list[Element] = []
    nodes = _fold(page, elements)
    groups: dict[tuple, list[Element]] = {}
    for element in elements:
        if element.href is not None and element.parent >= 0:
            groups.setdefault((element.parent, element.look), []).append(element)
    length = [0]
    for node in nodes:
        length.append(length[-1] + len(node))
    best = max(
        (own for own in groups.values() if len(own) >= LEAST_ITEMS), default=[],
        key=lambda own: sum(length[e.last] - length[e.first] for e in own),
    )

    def item(element: Element) -> dict[str, str]:
        own = nodes[element.first : element.last]
        title = next((" ".join(nodes[a:b]) for a, b in filter(None, (element.heading, element.link)) if a < b), own[0] if own else "")
        return {"href": element.href, "title": title, "text": "\n".join(own)}

    return [item(e) for e in best]


@F.pandas_udf(T.StringType())
def folded_text(pages: pd.Series) -> pd.Series:
    """``page_text`` of each page; missing ones stay missing."""
    return pages.map(page_text, na_action="ignore")


_ITEMS = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("href", "title", "text")]))


@F.pandas_udf(_ITEMS)
def listed_items(pages: pd.Series) -> pd.Series:
    """``page_items`` of each page; missing ones have none."""
    return pages.map(lambda page: page_items(page) if page else [])
