"""A page as a flat tree of block elements and text blocks, in page order."""

from __future__ import annotations

import html
import re

# Element names of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Elements whose content is plain characters up to their end tag.
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
# Elements whose text no reader of the page sees as text.
UNSEEN_TAGS = frozenset("audio button canvas datalist head map noscript object option optgroup select svg template video".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noscript script style template title".split())
CLOSES_P = BLOCK_TAGS - {"caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
# An open element of the first kind ends before one of the second begins, unless one of the third lies between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
SCOPE_ENDS = frozenset({"td", "th", "caption", "table"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW_TAGS}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TOLD_BY = frozenset({"class", "id", "role", "itemprop", "itemtype", "aria-label", "data-role", "data-component", "data-testid"})

ROOT, TEXT = "#root", "#text"


class Page:
    """Nodes in page order: element or text block, its parent, the end of its subtree, and counts of its own text.

    ``words`` are the lower-case words of an element's telling attributes, with ``!hidden`` if it is not shown.
    """

    __slots__ = ("tags", "parents", "ends", "depths", "words", "texts", "linked", "inline")

    def __init__(self) -> None:
        self.tags, self.parents, self.ends, self.depths, self.words = [ROOT], [-1], [0], [0], [()]
        self.texts, self.linked, self.inline = [""], [0], [0]

    def add(self, tag: str, parent: int, words: tuple, text: str = "", linked: int = 0, inline: int = 0) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.ends.append(len(self.tags))
        self.depths.append(self.depths[parent] + 1)
        self.words.append(words)
        self.texts.append(text)
        self.linked.append(linked)
        self.inline.append(inline)
        return len(self.tags) - 1


def attribute_words(raw: str) -> tuple:
    found = []
    for name, a, b, c in ATTR.findall(raw):
        name, value = name.lower(), a or b or c
        if name in TOLD_BY:
            found += [w.lower() for w in WORD.findall(html.unescape(value))]
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            found.append("!hidden")
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found.append("!hidden")
    return tuple(found)


def parse(source: str) -> Page:
    """The tree of a page of any length in one pass; what is cut off, unclosed or stray is read as browsers do."""
    page = Page()
    stack, names = [0], [ROOT]
    pieces, linked, inline = [], 0, 0
    link = 0  # depth of the element that the open link stands in, + 1
    unseen = []  # the open unseen element and what is open inside it

    def flush() -> None:
        nonlocal linked, inline
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add(TEXT, stack[-1], (), text, min(linked, len(text)), inline)
            pieces.clear()
            linked = inline = 0

    def leave(depth: int) -> None:
        """Close all elements from this depth of the stack on."""
        nonlocal link
        end = len(page.tags)
        for node in stack[depth:]:
            page.ends[node] = end
        del stack[depth:], names[depth:]
        if link > depth:
            link = 0

    def open_at(wanted, stops) -> int:
        for depth in range(len(names) - 1, 0, -1):
            if names[depth] in wanted:
                return depth
            if names[depth] in stops:
                break
        return 0

    at, size = 0, len(source)
    while at < size:
        match = TOKEN.search(source, at)
        start = match.start() if match else size
        if start > at and not unseen:
            piece = source[at:start]
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if link:
                linked += len(piece.strip())
        if match is None:
            break
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if source[at - 1] != ">":
            break  # a tag that the end of the page cuts off
        block = name in BLOCK_TAGS or "-" in name
        if name in RAW_TAGS:
            if not match["end"]:
                end = RAW_END[name].search(source, at)
                at = end.end() if end else size
            continue
        if name == "body" or (unseen == ["head"] and not match["end"] and name not in HEAD_TAGS):
            unseen.clear()  # a head without its end tag
        if unseen:
            if match["end"]:
                if name in unseen:
                    del unseen[len(unseen) - 1 - unseen[::-1].index(name) :]
                    continue
                if not (block and name in names):
                    continue
                unseen.clear()  # an outer element ends, and with it what was left open inside
            else:
                if (block or name in UNSEEN_TAGS) and not match["attrs"].endswith("/"):
                    unseen.append(name)
                continue
        elif name in UNSEEN_TAGS:
            if not (match["end"] or match["attrs"].endswith("/")):
                unseen.append(name)
            continue
        if block:
            if match["end"]:
                depth = open_at(HEADINGS if name in HEADINGS else {name}, () if name in SCOPE_ENDS else SCOPE_ENDS - {name})
                if depth or name == "p":
                    flush()
                if depth:
                    leave(depth)
                continue
            flush()
            if name in CLOSES_P and (depth := open_at({"p"}, SCOPE_ENDS)):
                leave(depth)
            if name in SIBLINGS and (depth := open_at(*SIBLINGS[name])):
                leave(depth)
            stack.append(page.add(name, stack[-1], attribute_words(match["attrs"])))
            names.append(name)
        elif name == "hr":
            flush()
        elif name == "br":
            pieces.append(" ")
        elif name == "a":
            link = 0 if match["end"] else len(stack)
            inline += 1
        elif not match["end"]:
            inline += 1
    flush()
    leave(0)
    return page
