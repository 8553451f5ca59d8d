"""A page as a tree of blocks, read in one pass over its tags.

Inline tags are part of the block around them. Siblings that carry text and look alike (paragraphs, list items,
cells, headings) are one node, so a tree has the size of the layout, not of the text. Broken markup is read the way browsers do: a new
paragraph, item or cell closes the open one, an end tag without a start is ignored, one for an outer block closes all inside it, and
whatever is open at the end is closed there. Blocks nested deeper than `DEEP` belong to the last one above, text and all.
"""

from __future__ import annotations

import html
import re

# fixed values of HTML
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub"
    " sup time tt u var".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
NOT_TEXT = frozenset(
    "head nav header footer aside form noscript template object svg canvas button select datalist dialog menu audio video map".split()
)
SIBLINGS = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption br hr caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
#: a start tag closes these open tags, but none outside of the bounds
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}

# words of class, id and role that name what is no part of an article: always, or only where no article is inside
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsored sponsor sponsors promo promos promoted comment comments"
    " disqus reply replies respond related recommended recommendations share sharing social cookie cookies consent gdpr newsletter"
    " subscribe subscription popup modal overlay signup login".split()
)
LAYOUT = frozenset(
    "nav navbar navigation menu menus menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets toolbar"
    " pagination pager notice notices notification alert banner complementary contentinfo search dialog".split()
)

DEEP = 200

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}

Piece = tuple[int, str, int]


class Page:
    """Nodes (`parents`, `labels`, `away`) and the pieces of text: (node, text, characters within links), in page order."""

    __slots__ = ("away", "index", "labels", "parents", "pieces")

    def __init__(self) -> None:
        self.parents, self.labels, self.away = [-1], ["body"], [False]
        self.index: dict[tuple[int, str], int] = {}
        self.pieces: list[Piece] = []

    def node(self, parent: int, tag: str, label: str, away: bool) -> int:
        key = (parent, label)
        if tag in SIBLINGS or tag != label:
            found = self.index.get(key)
            if found is not None:
                return found
        self.parents.append(parent)
        self.labels.append(label)
        self.away.append(away)
        self.index[key] = len(self.labels) - 1
        return len(self.labels) - 1

    def shape(self) -> str:
        """The tree without its text: a line per node."""
        lines = zip(self.parents, self.away, self.labels, strict=True)
        return "\n".join(f"{p} {'-' if gone else '+'} {label}" for p, gone, label in lines)


def _named(attributes: str) -> tuple[str, set[str]]:
    """Class, id and role as a label, and the words in them."""
    label, words = "", set()
    for name, value in _NAMES.findall(attributes):
        value = value.strip("\"'")
        label += f" {name.lower()}={_DIGITS.sub('0', ' '.join(sorted(value.split())))}"
        words.update(w.lower() for w in _WORDS.findall(value))
    return label, words


def _role(tag: str, words: set[str], within: bool) -> str:
    """'' for text, 'aside' for what is never part of an article, 'layout' for what may have one inside."""
    if tag in NOT_TEXT or words & ASIDE:
        return "aside"
    if tag in ("article", "main"):
        return ""
    layout = words & LAYOUT
    if layout and not ((within or tag in HEADINGS) and layout <= {"header"}):
        return "layout"
    return ""


class _Reader:
    def __init__(self) -> None:
        self.page = Page()
        # open blocks: (tag, node, role, within an article, inline)
        self.open: list[tuple[str, int, str, bool, bool]] = [("body", 0, "", False, False)]
        self.parts: list[str] = []
        self.linked = 0
        self.link = 0  # depth at which a link is open

    def block(self) -> int:
        """Depth of the innermost open block."""
        depth = len(self.open) - 1
        while self.open[depth][4]:
            depth -= 1
        return depth

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.page.pieces.append((self.open[self.block()][1], text, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def text(self, chunk: str) -> None:
        if self.open[-1][2] or not chunk:
            return
        if "&" in chunk:
            chunk = html.unescape(chunk)
        self.parts.append(chunk)
        if self.link:
            self.linked += len(" ".join(chunk.split()))

    def close_to(self, depth: int) -> None:
        """Closes all open blocks from `depth` on."""
        if any(not entry[4] for entry in self.open[depth:]):
            self.flush()
        del self.open[depth:]
        if self.link > depth:
            self.link = 0

    def innermost(self, tags, bounds) -> int:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth][0]
            if tag in tags:
                return depth
            if tag in bounds:
                return 0
        return 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in VOID:
            if tag == "br":
                self.text("\n")
            elif tag == "hr":
                self.flush()
            return
        inline = tag in INLINE
        if tag == "a":
            self.link = len(self.open)
        if len(self.open) > DEEP:
            if not inline:
                self.flush()
            return
        label, words = _named(attributes) if attributes and not attributes.isspace() else ("", set())
        above = self.open[-1]
        if inline and not (words & (ASIDE | LAYOUT)):
            return
        if not inline:
            self.flush()
            if tag in CLOSES:
                depth = self.innermost(*CLOSES[tag])
                if depth:
                    self.close_to(depth)
            else:
                depth = self.block()
                if self.open[depth][0] == "p" or (tag in HEADINGS and self.open[depth][0] in HEADINGS):
                    self.close_to(depth)
            above = self.open[-1]
        _, node, role, within, _ = above
        own = _role(tag, words, within)
        if role == "layout" and tag in ("article", "main") and not own:
            role = ""
        elif role:
            own = role
        if not own or own != role:
            node = self.page.node(node, tag, tag + label, bool(own))
        self.open.append((tag, node, own, within or (not own and tag in ("article", "main")), inline))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if tag == "br":
            self.text("\n")
        if tag == "p" and not self.innermost({"p"}, TABLE):
            self.flush()
        depth = self.innermost({tag}, () if tag in TABLE else ("td", "th", "table", "caption"))
        if depth and (tag not in INLINE or self.open[depth][4]):
            self.close_to(depth)


def read(source: str) -> Page:
    """The tree and text of a page; time is in proportion to its length, whatever it holds."""
    reader, at, tags = _Reader(), 0, _TAG
    comments = True
    while True:
        mark = source.find("<", at)
        if mark < 0:
            reader.text(source[at:])
            break
        if mark > at:
            reader.text(source[at:mark])
        follows = source[mark + 1 : mark + 2]
        if follows in ("!", "?") or (follows == "/" and not source[mark + 2 : mark + 3].isalpha()):
            end = source.find("-->", mark + 4) if comments and source.startswith("<!--", mark) else -1
            if end >= 0:
                at = end + 3
            else:
                comments = comments and not source.startswith("<!--", mark)
                end = source.find(">", mark)
                if end < 0:
                    break
                at = end + 1
            continue
        if not (follows.isascii() and (follows.isalpha() or follows == "/")):
            reader.text("<")
            at = mark + 1
            continue
        found = tags.match(source, mark)
        if found is None and tags is _TAG:  # a quote that never ends: from here on a tag ends at the first >
            tags = _PLAIN_TAG
            found = tags.match(source, mark)
        if found is None:  # a tag that never ends
            break
        at = found.end()
        tag = found.group(2).lower()
        if found.group(1):
            reader.end(tag)
        elif tag in RAW:
            closing = _END[tag].search(source, at)
            if closing is None:
                break
            at = closing.end()
        else:
            reader.start(tag, found.group(3))
            if tag in ("svg", "math") and found.group(3).endswith("/"):
                reader.end(tag)
    reader.close_to(1)
    reader.flush()
    return reader.page
