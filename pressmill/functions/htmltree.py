"""A tolerant HTML tree, for the steps that have to walk markup (X1 scoring, X2-X5, X8, S7).

End tags that authors leave out are supplied (a paragraph ends where a block begins, a list item at
the next one, a cell at the next cell, a link at the next link); an end tag that matches nothing
open is ignored, and one inside a table cell cannot close what lies around the table. Whatever the input,
parsing ends with a tree. Nodes are numbered in document order and know where their markup begins
and ends in the source, so inner and outer HTML are slices of it.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph where they begin.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
                   "h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table td th tr ul dd dt".split())
#: An element that begins ends these, back to the nearest of the second list.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "a": (("a",), ("td", "th")),
}
#: An end tag does not reach beyond these, unless it is theirs or a table's part.
WALLS = frozenset(("td", "th", "table"))
_NO_PARAGRAPH = BLOCKS - {"p"} | WALLS
_TABLE_PARTS = frozenset("table tbody thead tfoot tr td th body html".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "number", "begin", "inner_begin", "inner_end", "end")

    def __init__(self, tag, attrs, parent, number, begin, inner_begin):
        self.tag, self.attrs, self.parent, self.number = tag, attrs, parent, number
        self.children: list = []   # nodes and texts
        self.begin, self.inner_begin, self.inner_end, self.end = begin, inner_begin, inner_begin, inner_begin

    def nodes(self):
        """This node and all below, in document order."""
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, waiting = [], [self]
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style") or x is self:
                waiting.extend(reversed(x.children))
        return "".join(out)

    def release(self) -> None:
        """Take the tree apart, so that it goes at once: parents and children hold each other."""
        for node in list(self.nodes()):
            node.parent, node.children = None, []

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        at = source.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = source.find("\n", at + 1)
        self.size = len(source)
        self.root = Node("", {}, None, 0, 0, 0)
        self.open = [self.root]
        self.opened = {"": 1}  # open elements by tag
        self.count = 0

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # any <![...]> is a comment

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _close(self, depth: int, inner_end: int, end: int) -> None:
        """Close everything from ``depth`` on; only the outermost has an end tag."""
        for node in self.open[depth + 1:]:
            node.inner_end = node.end = inner_end
        for node in self.open[depth:]:
            self.opened[node.tag] -= 1
        self.open[depth].inner_end, self.open[depth].end = inner_end, end
        del self.open[depth:]

    def _back_to(self, tags, walls) -> int | None:
        if not any(self.opened.get(t) for t in tags):
            return None
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                return depth
            if self.open[depth].tag in walls:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        at = self._at()
        if tag in BLOCKS:
            depth = self._back_to(("p",), _NO_PARAGRAPH)  # no paragraph is open around a block
            if depth is not None:
                self._close(depth, at, at)
        if tag in IMPLIED:
            ends, walls = IMPLIED[tag]
            while (depth := self._back_to(ends, walls)) is not None:
                self._close(depth, at, at)
        self.count += 1
        parent = self.open[-1]
        inner = at + len(self.get_starttag_text() or "")
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, parent, self.count, at, inner)
        parent.children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.opened[tag] = self.opened.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # <div/> opens a div, as browsers have it

    def handle_endtag(self, tag):
        depth = self._back_to((tag,), () if tag in _TABLE_PARTS else WALLS)
        if depth is not None and tag not in VOID:
            at = self._at()
            self._close(depth, at, self._end_of_tag(at))

    def _end_of_tag(self, at: int) -> int:
        stop = self.rawdata.find(">", at)
        return self.size if stop < 0 else stop + 1

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(source: str) -> Node:
    """The root, a nameless node around the document."""
    b = _Builder(source)
    b.feed(source)
    # what the parser still holds back is an unfinished tag or entity
    b.close()
    b._close(0, b.size, b.size)
    return b.root


# ---------------------------------------------------------------------------
# Content scoring (X1): which part of a page is its article
# ---------------------------------------------------------------------------
#: Tags whose texts are the paragraphs that scores come from.
PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote"))
#: Containers that are a paragraph themselves when they hold no block.
LOOSE = frozenset(("div", "section", "article", "main"))
#: Never part of an article, whatever they say.
SKIPPED = frozenset("script style noscript nav footer header aside form button select textarea iframe template head title".split())
BASE_SCORES = {"article": 10, "main": 10, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3,
               "dl": -3, "li": -3, "form": -3, "th": -5}
#: Words in class and id that speak for or against an element.
LIKELY = frozenset("article body content entry main page post story text".split())
UNLIKELY = frozenset("ad ads advert banner breadcrumb byline comment comments cookie footer header menu meta nav navigation newsletter "
                     "pagination popup promo related share sidebar social sponsor tags widget".split())
WORD_WEIGHT = 25
LEAST_TEXT = 25


def _words(node: Node) -> set[str]:
    marks = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    return set("".join(c if c.isalnum() else " " for c in marks).split())


def passed_over(node: Node) -> bool:
    """Whether an element, with all in it, is no part of an article: by its tag, or by the words of its class and id."""
    words = _words(node)
    return node.tag in SKIPPED or (node.tag not in ("html", "body") and bool(words & UNLIKELY) and not words & LIKELY)


def weight(node: Node) -> float:
    words = _words(node)
    return WORD_WEIGHT * (bool(words & LIKELY) - bool(words & UNLIKELY))


def paragraph_score(size: int, commas: int, least_text: int = LEAST_TEXT) -> float:
    return 1 + commas + min(size / 100, 3) if size >= least_text else 0.0


class Scores:
    """Per node, by number: text and link characters, commas and the score, all from below."""

    def __init__(self, root: Node, least_text: int = LEAST_TEXT):
        order = []
        skipped: set[int] = set()
        for node in root.nodes():
            if (node.parent is not None and node.parent.number in skipped) or passed_over(node):
                skipped.add(node.number)
            else:
                order.append(node)
        self.order = order
        self.size, self.link, self.commas, self.blocks = {}, {}, {}, {}
        raised: dict[int, float] = {}
        for node in reversed(order):
            size = link = commas = 0
            blocks = False
            for c in node.children:
                if isinstance(c, str):
                    shown = " ".join(c.split())
                    size += len(shown)
                    commas += shown.count(",") + shown.count("،") + shown.count("，")
                elif c.number not in skipped:
                    size, link, commas = size + self.size[c.number], link + self.link[c.number], commas + self.commas[c.number]
                    blocks = blocks or c.tag in BLOCKS or self.blocks[c.number]
            self.size[node.number], self.commas[node.number], self.blocks[node.number] = size, commas, blocks
            self.link[node.number] = size if node.tag == "a" else link
            if node.tag in PARAGRAPHS or (node.tag in LOOSE and not blocks):
                worth = paragraph_score(size, commas, least_text)
                if worth and node.tag in LOOSE:  # it holds the text itself
                    raised[node.number] = raised.get(node.number, 0.0) + worth
                for share, above in ((1.0, node.parent), (0.5, node.parent.parent if node.parent is not None else None)):
                    if worth and above is not None and above.parent is not None:
                        raised[above.number] = raised.get(above.number, 0.0) + share * worth
        self.score = {}
        for node in order:
            if node.number in raised:
                self.score[node.number] = (BASE_SCORES.get(node.tag, 0) + weight(node) + raised[node.number]) * (1 - self.density(node))

    def density(self, node: Node) -> float:
        size = self.size[node.number]
        return self.link[node.number] / size if size else 0.0


def content_html(source: str) -> str | None:
    """Inner HTML of the best-scored element, with those of its siblings that belong to it. Where no paragraph has
    ``LEAST_TEXT`` characters any text counts; None for a page without text."""
    root = parse(source)
    try:
        return _content(source, root)
    finally:
        root.release()


def _content(source: str, root: Node) -> str | None:
    scores = Scores(root)
    if not scores.score:
        scores = Scores(root, 1)
    ranked = [n for n in scores.order if n.number in scores.score]
    if not ranked:
        return None
    top = max(ranked, key=lambda n: (scores.score[n.number], -n.number))
    least = max(10.0, 0.2 * scores.score[top.number])
    parts = []
    for node in top.parent.children:
        if node is top:
            parts.append(_kept(source, top, top.inner_begin, top.inner_end))
        elif isinstance(node, Node) and node.number in scores.size:
            size, density = scores.size[node.number], scores.density(node)
            paragraph = node.tag == "p" and (density < 0.25 if size > 80 else size >= LEAST_TEXT and density == 0)
            if paragraph or scores.score.get(node.number, 0.0) >= least:
                parts.append(_kept(source, node, node.begin, node.end))
    return "\n".join(parts)


def _kept(source: str, top: Node, begin: int, end: int) -> str:
    """The source from ``begin`` to ``end`` without the elements below ``top`` that are passed over."""
    out, at = [], begin
    for node in top.nodes():
        if node is not top and node.begin >= at and passed_over(node):
            out.append(source[at:node.begin])
            at = node.end
    return "".join(out) + source[at:end]
