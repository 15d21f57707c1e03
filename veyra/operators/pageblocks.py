"""Visible text of HTML as blocks with their element paths (plain Python, one pass, no dependencies).

Visible text is the text outside head, script, style, noscript, template, svg and comments, entities decoded. A block is a run
of it that no block-level tag, br or hr breaks; inline tags neither break it nor add a space. White space is collapsed.
"""

from __future__ import annotations

import html as _html
import re
from typing import NamedTuple

HIDDEN = frozenset("head script style noscript template svg".split())
RAW = frozenset("script style".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LISTS = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "tr": frozenset(("table",))}
_SIBLINGS = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "tr": frozenset(("tr",))}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>", re.S)
_ATTR = re.compile(r"""\b(id|class|href|alt|name|content|property|title|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WS = re.compile(r"\s+")


class Block(NamedTuple):
    text: str  # white space collapsed, not empty
    path: tuple[str, ...]  # block-level ancestors, outermost first: tag, #id and .classes as far as there are any
    link: int  # characters within links
    bold: int  # characters within b, strong or font
    code: int  # characters within code, pre, kbd or samp
    raw: str  # as parsed, white space kept
    ids: tuple[int, ...] = ()  # running numbers of the elements in path


def collapse(s: str) -> str:
    return _WS.sub(" ", s).strip()


def unescape(s: str) -> str:
    return _html.unescape(s) if "&" in s else s


def _label(tag: str, attrs: str) -> str:
    if not attrs:
        return tag
    a = {m[1].lower(): m[2].strip("\"'").lower() for m in _ATTR.finditer(attrs) if m[1].lower() in ("id", "class")}
    ident = f"#{a['id']}" if a.get("id") else ""
    return tag + ident + "".join("." + c for c in sorted(a.get("class", "").split()))


def blocks(html: str | None, hidden_tags: frozenset[str] = HIDDEN) -> list[Block]:
    """The blocks of a page in order; [] for null, blank or text-free html. The text of hidden_tags does not count."""
    out: list[Block] = []
    if not html:
        return out
    stack: list[tuple[str, str, int]] = []  # open block-level elements
    count = 0
    inline: list[str] = []
    parts: list[str] = []
    link = bold = code = 0
    hidden: list[str] = []
    at = 0

    def flush() -> None:
        nonlocal parts, link, bold, code
        if parts:
            raw = "".join(parts)
            text = collapse(raw)
            if text:
                out.append(Block(text, tuple(x[1] for x in stack), link, bold, code, raw, tuple(x[2] for x in stack)))
            parts, link, bold, code = [], 0, 0, 0

    def text(s: str) -> None:
        nonlocal link, bold, code
        if s and not hidden:
            s = unescape(s)
            parts.append(s)
            if inline or stack:
                n = len(s.strip())
                if "a" in inline:
                    link += n
                if "b" in inline or "strong" in inline or "font" in inline:
                    bold += n
                if "code" in inline or "kbd" in inline or "samp" in inline or any(x[0] == "pre" for x in stack):
                    code += n

    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if tag in hidden_tags:
            if closing:
                if tag in hidden:
                    while hidden.pop() != tag:
                        pass
            elif not m[3].endswith("/"):
                if tag in RAW:
                    stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    at = stop.end() if stop else end
                else:
                    hidden.append(tag)
            continue
        if hidden:
            if hidden[0] == "head" and tag == "body" and not closing:
                hidden.clear()
            else:
                continue
        if tag in BLOCK:
            flush()
            if tag in VOID:
                continue
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                inline.clear()
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in _SIBLINGS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _LISTS[tag]:
                        break
                    if stack[i][0] in _SIBLINGS[tag]:
                        del stack[i:]
                        break
            count += 1
            stack.append((tag, _label(tag, m[3]), count))
        elif tag not in VOID:
            if closing:
                if tag in inline:
                    while inline.pop() != tag:
                        pass
            elif not m[3].endswith("/"):
                inline.append(tag)
    flush()
    return out


def visible_text(html: str | None, sep: str = "\n") -> str:
    return sep.join(b.text for b in blocks(html))


def title(html: str | None) -> str:
    m = re.search(r"<title[^>]*>(.*?)</title>", html or "", re.I | re.S)
    return collapse(unescape(m[1])) if m else ""
