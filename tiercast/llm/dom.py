"""A page as a tree of blocks: elements that hold blocks, and leaves that hold text.

Pages are read leniently: unknown and unclosed tags, stray end tags and
unfinished comments or scripts never fail. Nodes are in page order, a parent
before its children, so a subtree is a run of nodes.
"""

from __future__ import annotations

import html
import re

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
#: Of these an unclosed one takes the rest of the page; other raw elements without an end tag hold nothing.
CODE = frozenset(["script", "style"])
FOREIGN = frozenset(["svg", "math"])
#: Without any text they do not part the text around them.
EMPTY = frozenset("svg noscript object select template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt "
    "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends an open element of the second set, up to one of the third.
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
LEAF = "#text"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*')*+|[^<>]*+)>",
    re.S,
)
_TEXTLESS = {
    t: re.compile(rf"(?:\s++|<title\b[^<>]*+>[^<]*+</title\s*+>|<(?!/?(?:{t}|title|script|style|iframe|textarea)\b)[/a-z][^<>]*+>)*+</{t}\s*+>", re.I)
    for t in EMPTY
}
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MARK = re.compile(r"\bdata-kept\b")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Lists with one entry a node."""

    __slots__ = ("tag", "parent", "end", "depth", "names", "text", "link", "kept")

    def __init__(self):
        self.tag, self.parent, self.end, self.depth, self.names = ["html"], [-1], [0], [0], [()]
        self.text, self.link, self.kept = [""], [0], [False]

    def add(self, tag: str, parent: int, names: tuple = (), text: str = "", link: int = 0, kept: bool = False) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.end.append(0)
        self.depth.append(self.depth[parent] + 1)
        self.names.append(names)
        self.text.append(text)
        self.link.append(link)
        self.kept.append(kept)
        return len(self.tag) - 1


def names_of(attributes: str) -> tuple:
    """Lower-case words of the class, id and role."""
    found = []
    for _, a, b, c in _NAMED.findall(attributes):
        found += [w.lower() for w in _PARTS.findall(a or b or c)]
    return tuple(found)


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]  # inline elements carry the node of their block
    open_at: dict[str, list[int]] = {}  # places on the stack of the open elements of each tag
    blocks: list[int] = [0]  # and of all that are not inline
    run: list[str] = []
    linked, links, kept = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                page.add(LEAF, stack[-1][1], (), text, min(linked, len(text)), kept)
            run.clear()
        linked = 0

    def pop(to: int) -> None:
        """Close all elements from place ``to`` of the stack."""
        nonlocal links, kept
        while len(stack) > to:
            tag, node = stack[-1]
            if tag not in INLINE:
                flush()
            stack.pop()
            open_at[tag].pop()
            links -= tag == "a"
            if tag not in INLINE:
                blocks.pop()
                page.end[node] = len(page.tag)
                kept = page.kept[stack[-1][1]]

    def close(tags: frozenset, until: frozenset) -> None:
        found = max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)
        if found and found >= max((open_at[t][-1] for t in until if open_at.get(t)), default=0):
            flush()
            pop(found)

    at, size = 0, len(source)
    unended: set[str] = set()
    closes_p, barrier = frozenset(["p"]), CLOSES_P - {"p"}
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            piece = source[at:]
            run.append(piece)
            linked += len(piece) if links else 0
            break
        if m.start() > at:
            piece = source[at : m.start()]
            run.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # end tag
            if tag in ("html", "body"):
                continue
            if tag == "br":
                run.append(" ")
            elif open_at.get(tag):
                if tag not in INLINE:
                    flush()
                place = open_at[tag][-1]
                if tag in INLINE and blocks[-1] > place:
                    continue  # an inline end tag does not close blocks
                pop(place)
            continue
        if m[3].endswith("/") and (tag in FOREIGN or any(open_at.get(t) for t in FOREIGN)):
            run.append(" ")  # self-closed, as nothing is outside of svg and math
            continue
        if tag in RAW:
            ended = None
            if tag not in unended:
                ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            if ended:
                at = ended.end()
            elif tag in CODE:
                at = size
            else:
                unended.add(tag)
            run.append(" ")
            continue
        textless = _TEXTLESS[tag].match(source, at) if tag in EMPTY else None
        if textless:
            at = textless.end()
            run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                run.append(" ")
            continue
        if tag in ("html", "body", "head"):
            flush()
            if tag == "body":
                page.names[0] = names_of(m[3])
                kept = page.kept[0] = bool(_MARK.search(m[3]))
            continue
        if tag in CLOSES_P:
            close(closes_p, barrier)
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        open_at.setdefault(tag, []).append(len(stack))
        if tag in INLINE:
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
        else:
            flush()
            kept = kept or bool(_MARK.search(m[3]))
            blocks.append(len(stack))
            stack.append((tag, page.add(tag, stack[-1][1], names_of(m[3]) if m[3] else (), kept=kept)))
    flush()
    pop(1)
    n = len(page.tag)
    page.end = [e or (i + 1 if page.tag[i] == LEAF else n) for i, e in enumerate(page.end)]
    return page
