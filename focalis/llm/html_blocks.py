"""Cutting HTML into leaf blocks of text, each with the path of the elements around it.

Only what is no text of the page by the language itself is left out here: comments, and the
content of scripts, styles, frames, input areas and the title. All else, what stands in for missing
features or is hidden by the page itself included, becomes a block or part of one; a hidden element
has the part ``.hidden`` on its path.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Elements whose start or end bounds a block of text; all others are inline.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW_TAGS = ("script", "style", "iframe", "textarea", "title")
#: Of these, the ones that go on to the end of a page without their end tag; of the others only the tag is left out then.
ENDLESS = frozenset(("script", "style", "textarea", "title"))
#: Elements that a slash closes.
FOREIGN = frozenset("svg math path circle rect line g use polygon mspace".split())
#: An opening tag that ends an open element of the listed kinds, unless one of ``BARRIERS`` lies between.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BARRIERS = frozenset("ul ol dl table select menu body".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*[^>]*>", re.I) for tag in RAW_TAGS}
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"(?<![\w\-])display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]  # of the elements around it, outermost first: tag names, and parts of class and id names after a dot
    linked: int  # characters inside links


def _parts(rest: str) -> tuple[str, ...]:
    out = []
    for m in _NAMES.finditer(rest):
        out += ["." + p.lower() for p in _PART.findall(m[2] or m[3] or m[4] or "") if not p.isdigit()]
    return tuple(dict.fromkeys(out))


def _hidden(rest: str) -> bool:
    """Whether the attributes have ``hidden`` or a style that shows nothing."""
    if not _MAY_HIDE.search(rest):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        name = m[1].lower()
        if name == "hidden" or (name == "style" and _NOT_SHOWN.search(m[2] or m[3] or m[4] or "")):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order: character references decoded, white space runs turned into one blank, trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, tuple(x for e in stack if e[0] in BLOCK_TAGS or e[1] for x in (e[0], *e[1])), linked))
            held.clear()
        linked = 0

    def close() -> None:
        nonlocal links
        links -= stack.pop()[0] == "a"

    def text(s: str) -> None:
        nonlocal linked
        held.append(s)
        if links:
            linked += len(s)

    at = 0
    unclosed: set[str] = set()  # raw elements without an end tag from here on
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            if m["raw"] is None and m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            elif m["raw"]:
                raw = m["raw"].lower()
                end = None if raw in unclosed else _RAW_ENDS[raw].search(page, at)
                if end:
                    at = end.end()
                elif raw in ENDLESS:
                    at = len(page)
                else:
                    unclosed.add(raw)
            continue
        tag = m["tag"].lower()
        if tag == "br":
            held.append("\n")
            continue
        if m["end"]:
            if any(e[0] == tag for e in stack):
                if tag in BLOCK_TAGS or any(e[0] in BLOCK_TAGS for e in stack[max(i for i, e in enumerate(stack) if e[0] == tag) :]):
                    flush()
                while stack[-1][0] != tag:
                    close()
                close()
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            if any(e[0] == "p" for e in stack):  # any block ends a paragraph
                while any(e[0] == "p" for e in stack):
                    close()
            if tag in IMPLIED:
                i = len(stack) - 1
                last = len(stack)
                while i >= 0 and stack[i][0] not in BARRIERS:
                    if stack[i][0] in IMPLIED[tag]:
                        last = i
                    i -= 1
                while len(stack) > last:
                    close()
        if tag not in VOID_TAGS and not (tag in FOREIGN and m[0].endswith("/>")):
            parts = _parts(m["rest"]) if m["rest"] else ()
            stack.append((tag, (*parts, ".hidden") if _hidden(m["rest"]) else parts))
            links += tag == "a"
    if at < len(page):
        text(page[at:])
    flush()
    return out
