"""Elements of HTML by a tokeniser: tags, attributes, raw text, comments and references, with parents and inherited hiding."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENT = "struct<pos: int, parent: int, name: string, attrs: map<string, string>, text: string, hidden: boolean>"
# Groups of elements as the HTML standard names them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe noembed noframes noscript xmp".split())  # markup inside is text, and none that is shown
TEXT_ONLY = set("title textarea".split())  # tags inside are text, references are not
UNSHOWN = RAW | {"template", "head", "title"}
BLOCKS = set(
    "address article aside blockquote br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Start tags that end an open element, up to the element that bounds the search.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "a": ({"a"}, {"table", "td"}),
    "button": ({"button"}, {"table", "td"}),
}
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot"}

_MARKUP = re.compile(r"<(?:!--|[!?/]|(?=[a-zA-Z]))")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s>]*)))?)""")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b|(?:^|;)\s*visibility\s*:\s*hidden\b", re.IGNORECASE)


class _Open:
    """An element whose end has not come yet."""

    __slots__ = ("name", "pos", "hidden", "texts")

    def __init__(self, name: str, pos: int, hidden: bool, texts: list | None):
        self.name, self.pos, self.hidden, self.texts = name, pos, hidden, texts


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, the first of a name, and the place after the tag."""
    found: dict[str, str] = {}
    while match := _ATTRIBUTE.match(html, at):
        at = match.end()
        if match[1]:
            return found, at
        value = next((v for v in match.group(3, 4, 5) if v is not None), "")
        found.setdefault(match[2].lower(), unescape(value) if "&" in value else value)
    return found, len(html)  # the text ends inside the tag


def _hides(name: str, attrs: dict[str, str]) -> bool:
    return name in UNSHOWN or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(attrs.get("style", "")))


def parse(html: str, wanted: Callable[[str, dict[str, str]], bool]) -> list[tuple]:
    """(pos, parent, name, attributes, text, hidden) of the elements that ``wanted`` picks, in document order.

    ``pos`` numbers all elements, ``parent`` is the number of the element around, -1 outside. Text is that of the element
    and all inside it that is not raw text; the edges of blocks part words. An element is hidden if it or one around it is.
    """
    out: list[list] = []
    stack: list[_Open] = []
    collecting: list[list[str]] = []  # texts of the open wanted elements
    count = at = 0

    def put(text: str) -> None:
        for texts in collecting:
            texts.append(text)

    def close(depth: int) -> None:
        for element in stack[depth:]:
            if element.texts is not None:
                collecting.remove(element.texts)
        if any(e.name in BLOCKS for e in stack[depth:]):
            put(" ")
        del stack[depth:]

    def find(names: set[str], bounds: set[str]) -> int | None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].name in names:
                return depth
            if stack[depth].name in bounds:
                return None
        return None

    while at < len(html):
        match = _MARKUP.search(html, at)
        end = match.start() if match else len(html)
        if collecting and end > at:
            put(unescape(html[at:end]))
        if not match:
            break
        if match[0] == "<!--":
            stop = html.find("-->", match.end() - 2 if html.startswith("<!-->", match.start()) else match.end())
            at = len(html) if stop < 0 else stop + 3
            continue
        name_match = _NAME.match(html, match.end())
        if match[0] in ("<!", "<?") or name_match is None:
            stop = html.find(">", match.end())
            at = len(html) if stop < 0 else stop + 1
            continue
        name = name_match[0].lower()
        attrs, at = _attributes(html, name_match.end())
        if match[0] == "</":
            if name == "br":
                put(" ")
            elif (depth := find({name}, set())) is not None:
                close(depth)
            continue
        if name in ENDS and (depth := find(*ENDS[name])) is not None:
            close(depth)
        elif name in CLOSES_P and (depth := find({"p"}, {"button", "table", "td", "th"})) is not None:
            close(depth)
        if name in BLOCKS:
            put(" ")
        hidden = bool(stack and stack[-1].hidden) or _hides(name, attrs)
        pos, count = count, count + 1
        texts = None
        if wanted(name, attrs):
            texts = []
            out.append([pos, stack[-1].pos if stack else -1, name, attrs, texts, hidden])
        if name in RAW or name in TEXT_ONLY:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(html, at)
            inside = html[at : stop.start() if stop else len(html)]
            if name in TEXT_ONLY and texts is not None:
                texts.append(unescape(inside))
            at = html.find(">", stop.start()) + 1 if stop else len(html)
            at = at or len(html)
        elif name not in VOID:
            stack.append(_Open(name, pos, hidden, texts))
            if texts is not None:
                collecting.append(texts)
    return [(pos, parent, name, attrs, "".join(texts), hidden) for pos, parent, name, attrs, texts, hidden in out]


def _columns(rows: list[list[tuple]]) -> pa.Array:
    kind = pa.list_(
        pa.struct([("pos", pa.int32()), ("parent", pa.int32()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("hidden", pa.bool_())])
    )
    keys = ("pos", "parent", "name", "attrs", "text", "hidden")
    return pa.array([[dict(zip(keys, (*e[:3], list(e[3].items()), *e[4:]), strict=True)) for e in row] for row in rows], kind)


def elements(html: Column, names: list[str], roles: list[str] | None = None) -> Column:
    """array of ``ELEMENT``: the elements with these names, or with one of these roles, in document order; one pass over the text."""
    chosen, by_role = set(names), set(roles or [])

    def wanted(name: str, attrs: dict[str, str]) -> bool:
        return name in chosen or bool(by_role) and attrs.get("role", "").lower() in by_role

    @F.arrow_udf(f"array<{ELEMENT}>")
    def read(texts: pa.Array) -> pa.Array:
        return _columns([parse(t or "", wanted) for t in texts.to_pylist()])

    return read(html)
