"""Main text of pages by wrapper induction.

Pages of a host are taken in blocks of a bounded number. A block's trees are
aligned with its largest one by simple tree matching. Nodes that hold the same
text on over half of the distinct pages, and do not stand in a run of their like, are
the template; the part of the tree in which most of the varying text lies is the
content. Of the content are left out regions that are no article by their element or
by their whole name, and constant boxes. Constant headings, paragraphs and the like
that stand between varying text stay. Every page of the block is then read with that
wrapper.

Nodes are told apart by shape: their element and names, and the shapes of their
children's runs. Sequences of children are trimmed of what they begin and end with
alike; what is left is aligned by dynamic programming, a row at a time in numpy. Of
long ones some rows are kept, and those between are made again where the path goes, so
memory is linear and the path is the same at every length; time is their product. A
block that is not aligned is not template, so its text stays.

Pages are dealt by host, and hosts with over a thousandth of all pages by host and
a hash, so no task gets a third of the table. A task holds the pages of at most two
blocks at a time: the last two of a host are of equal size, so that no block of a
larger host is a small rest without a template of its own.

Defined results: a null or empty html gives an empty text; pages without a host
(null or odd urls) are one host; a host with one page has no template and is read
by names and links alone; repeated rows are given back as often and count once for
a template; an empty table gives an empty result. Lists of links are left out if
they are template or their names say so, and on pages without both a template and an
article element. Of two nodes that hold equally much the first is gone into. Very long
and very deep pages are read whole: about 400 bytes are held for each element. Cut-off
and badly nested markup is closed where the next block says so.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import HOT_PART, staged, struct_of

#: Pages that are aligned with each other.
BLOCK = 64
#: Distinct pages that must agree before a text counts as template, and the part of a
#: block's distinct pages that must.
AGREEING = 3
TEMPLATE = 0.5
#: Part of the varying text that a node must hold to be gone into, and of a node's
#: text that may be links before it is taken for a list of links.
MOST = 0.6
LINKED = 0.6
#: Part of the content's varying text that a region may hold and be left out for its name.
NAMED = 0.5
#: Pairs of blocks that an alignment keeps in memory at a time, and the rows that it keeps
#: of more; neither has a part in the result.
TABLE = 1_000_000
SPLIT = 16
#: Once the most pairs that an alignment looked at. Nothing reads it: alignments are whole at every size.
CELLS = 200_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_WORD = re.compile(r"[a-z]+")

#: Names of HTML elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title annotation annotation-xml".split())
#: Of these, what has no end tag holds the rest of the page.
TO_THE_END = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder "
    "mover munderover mstyle mspace semantics".split()
)
CLOSED_BY_BLOCK = frozenset(["p"])
#: Controls and drawings: what a block of text stands in by mistake, and so closes.
CONTROLS = frozenset("button select svg".split())
BREAKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre section article aside nav header footer main form hr "
    "body".split()
)
SAME_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("table ul ol dl article section aside nav div body main".split())
#: Elements and words in names that say a region is not the article.
ASIDE_TAGS = frozenset("nav aside footer form menu dialog head button select svg".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie "
    "cookies consent disqus footer form header masthead menu modal nav navbar navigation newsletter notice "
    "pager pagination popup promo promoted related replies share sharing sidebar skip social sponsor "
    "sponsored subscribe tags toolbar widget widgets complementary contentinfo search".split()
)
ARTICLE_TAGS = frozenset(["article", "main"])
#: Words before and beside a word that take its meaning from it, as in
#: ``has-sidebar`` and ``entry-header``.
DENYING = frozenset("has have no not with without".split())
OWN_HEADER = frozenset("article body content entry main page post story title".split())
#: Words that only say what kind of box a name is given to, or where it is.
BOX_WORDS = frozenset(
    "area articles bar block blocks bottom box button buttons col column container count fixed form global group "
    "header icon icons inline inner item items js layout left level link links list mobile module outer overlay "
    "panel posts primary region right row secondary section signup site slot small sticky stories sub tab tabs text "
    "title top trail unit view wrap wrapper".split()
)
#: Words that name what readers wrote, of which there may be more than article.
READERS = frozenset("comment comments disqus replies".split())
#: Elements that hold the article's text itself, whatever they are named.
TEXTUAL = frozenset(
    "h1 h2 h3 h4 h5 h6 p blockquote pre dt dd li figcaption td th caption tr dl figure address summary hgroup".split()
)
#: Of these the names still tell, as of other boxes.
NAMED_TEXT = frozenset(["li", "dl", "figure", "tr"])


class Node:
    """A block of a page: its signature, its own texts and blocks, and its links' length.

    ``aside`` says why a region is not the article: its element ("tag"), its names
    ("names", or "readers" if they are of what readers wrote), or not at all.
    """

    __slots__ = ("sign", "tag", "aside", "inline", "parts", "kids", "links", "size", "shape")

    def __init__(self, tag: str, names: str = "", aside: str = "", inline: bool = False):
        self.tag, self.sign, self.aside, self.inline = tag, (tag, names), aside, inline
        self.parts: list = []
        self.kids: list[Node] = []
        self.links = self.size = 0
        self.shape = -1


def _names(attributes: str) -> tuple[list[str], str]:
    """The words of an element's names, and what a whole name says of it: "names", "readers" or nothing."""
    words: list[str] = []
    aside = ""
    for found in _NAMES.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            parts = _WORD.findall(name)
            words += parts
            telling = ASIDE_WORDS.intersection(parts)
            if not OWN_HEADER.isdisjoint(parts):
                telling -= {"header"}
            # A name with a word of another kind, such as search-methods, is of something else.
            only = all(p in ASIDE_WORDS or p in BOX_WORDS or p in OWN_HEADER or len(p) == 1 for p in parts)
            if telling and only and parts[0] not in DENYING:
                aside = "readers" if aside == "readers" or not READERS.isdisjoint(telling) else "names"
    return words, aside


class _Open:
    """The open elements of a page being read."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node, bool]] = [("", root, False)]
        self.counts: dict[str, int] = {}
        self.linked = 0

    def push(self, tag: str, node: Node, link: bool = False) -> None:
        self.stack.append((tag, node, link))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.linked += link

    def cut(self, depth: int) -> None:
        for tag, _, link in self.stack[depth:]:
            self.counts[tag] -= 1
            self.linked -= link
        del self.stack[depth:]

    def has(self, tags) -> bool:
        return any(self.counts.get(tag) for tag in tags)

    def last(self, tags) -> int:
        """The place of the innermost open element of ``tags``, 0 if there is none."""
        if not self.has(tags):
            return 0
        return next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] in tags)

    def close(self, tag: str) -> None:
        depth = self.last((tag,))
        if depth and not (tag in INLINE and any(t in SCOPES for t, *_ in self.stack[depth + 1 :])):
            self.cut(depth)

    def make_way(self, tag: str) -> None:
        """Close what a block of this kind ends: paragraphs, its own like in a list, controls left open."""
        if tag in BREAKS and self.has(CONTROLS):
            depth = next(i for i, (t, *_) in enumerate(self.stack) if t in CONTROLS)
            self.cut(depth)
        closes = SAME_CLOSES.get(tag, set()) | CLOSED_BY_BLOCK
        if not self.has(closes):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in closes:
                self.cut(i)
                return
            if self.stack[i][0] in SCOPES:
                return


def tree(page: str) -> tuple[Node, str]:
    """The tree of a page's blocks, and its title."""
    root = Node("")
    open_ = _Open(root)
    title, at = "", 0
    while True:
        token = _TOKEN.search(page, at)
        text = page[at : token.start()] if token else page[at:]
        if text:
            node = open_.stack[-1][1]
            node.parts.append(text)
            if not text.isspace():
                node.size += len(text)
                node.links += len(text) * bool(open_.linked)
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            if token[0].startswith("<![CDATA["):
                open_.stack[-1][1].parts.append(entities.escape(token[0][9:].removesuffix("]]>")))
            continue
        tag = token[2].lower()
        if token[1]:
            open_.close(tag)
            continue
        if tag in VOID:
            open_.stack[-1][1].parts.append(" ")
            continue
        if tag in RAW:
            if token[3].endswith("/"):
                continue
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            if end is None and tag not in TO_THE_END:
                continue
            stop = end.start() if end else len(page)
            if tag == "title" and not title:
                title = page[at:stop].strip()
            at = end.end() if end else len(page)
            continue
        inline = tag in INLINE
        names, named = _names(token[3]) if token[3] else ([], "")
        if inline or (tag in TEXTUAL and tag not in NAMED_TEXT):
            named = ""
        aside = "tag" if tag in ASIDE_TAGS else named
        if tag == "header":
            aside = aside if open_.has(ARTICLE_TAGS) else "tag"
        if tag in ("html", "body", "main"):
            aside = ""
        if not inline:
            open_.make_way(tag)
        holder = open_.stack[-1][1]
        if inline:
            # An anchor that leads nowhere is a mark in the text.
            open_.push(tag, holder, tag == "a" and bool(_HREF.search(token[3])))
            continue
        node = Node(tag, " ".join(names), aside, tag in CONTROLS)
        holder.parts.append(node)
        holder.kids.append(node)
        if not (token[3].endswith("/") and tag == "svg"):
            open_.push(tag, node)
    _measure(root)
    return root, title


def _measure(root: Node) -> None:
    order = [root]
    for node in order:
        order.extend(node.kids)
    for node in reversed(order):
        node.size += sum(k.size for k in node.kids)
        node.links += sum(k.links for k in node.kids)


def linking(node: Node) -> bool:
    """Whether a block is a list of links."""
    return node.tag in ("ul", "ol", "table", "div", "section") and node.links > LINKED * max(1, node.size)


def runs(node: Node) -> list[list[Node]]:
    """Children, with neighbours of one signature as one run."""
    found: list[list[Node]] = []
    for kid in node.kids:
        if found and found[-1][0].sign == kid.sign:
            found[-1].append(kid)
        else:
            found.append([kid])
    return found


class Shapes:
    """Nodes by shape, and how shapes match; every answer is kept for a block of pages."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        #: For each shape its signature, its runs' shapes, and its number of nodes, a run as one.
        self.signs: list[tuple] = []
        self.runs: list[tuple[int, ...]] = []
        self.counts: list[int] = []
        self.sizes: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def name(self, root: Node) -> None:
        """Give each node below ``root`` its shape."""
        for node in reversed(order_of(root)):
            inner = tuple(run[0].shape for run in runs(node))
            key = (node.sign, inner)
            shape = self.known.get(key)
            if shape is None:
                shape = self.known[key] = len(self.signs)
                self.signs.append(node.sign)
                self.runs.append(inner)
                self.counts.append(1 + sum(self.counts[kid] for kid in inner))
            node.shape = shape

    def size(self, one: int, two: int) -> int:
        """Simple tree matching: the most nodes that two trees share in order, roots included.

        Trees whose roots have different signatures share nothing.
        """
        asked = [self._sized(one, two)]
        answer = None
        while asked:
            try:
                needed = asked[-1].send(answer)
                answer = self._known(*needed)
                if answer is None:
                    asked.append(self._sized(*needed))
            except StopIteration as done:
                asked.pop()
                answer = done.value
        return answer

    def _known(self, one: int, two: int) -> int | None:
        if self.signs[one] != self.signs[two]:
            return 0
        if one == two:
            return self.counts[one]
        if not self.runs[one] or not self.runs[two]:
            return 1
        return self.sizes.get((one, two))

    def _sized(self, one: int, two: int):
        """Asks for the sizes of pairs of shapes that it needs, and returns that of its own."""
        found = self._known(one, two)
        if found is not None:
            return found
        start, end, left, right = self._trimmed(one, two)
        total = 1
        a, b = self.runs[one], self.runs[two]
        pairs = [(i, i) for i in range(start)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(end)]
        if left and right:
            weights = yield from self._weights(left, right)
            pairs += [(start + i, start + j) for i, j in _alignment(left, right, weights)]
        pairs.sort()
        for i, j in pairs:
            total += yield a[i], b[j]
        self.pairs[one, two] = pairs
        self.sizes[one, two] = total
        return total

    def _trimmed(self, one: int, two: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]]:
        """How many runs two sequences begin and end with alike, and what lies between."""
        a, b = self.runs[one], self.runs[two]
        least = min(len(a), len(b))
        start = next((i for i in range(least) if self.signs[a[i]] != self.signs[b[i]]), least)
        least -= start
        end = next((i for i in range(least) if self.signs[a[-1 - i]] != self.signs[b[-1 - i]]), least)
        return start, end, a[start : len(a) - end], b[start : len(b) - end]

    def _weights(self, left: tuple[int, ...], right: tuple[int, ...]):
        """What each pair of shapes is worth, matched in depth: a table by shape of the left and of the right."""
        rows, columns = list(dict.fromkeys(left)), list(dict.fromkeys(right))
        by_sign: dict[tuple, list[int]] = {}
        for at, shape in enumerate(columns):
            by_sign.setdefault(self.signs[shape], []).append(at)
        table: dict[int, dict[int, int]] = {}
        for shape in rows:
            table[shape] = {}
            for at in by_sign.get(self.signs[shape], ()):
                table[shape][columns[at]] = yield shape, columns[at]
        return table

    def matched(self, one: int, two: int) -> list[tuple[int, int]]:
        """Pairs of places of the runs of two shapes that stand for each other."""
        if self.signs[one] != self.signs[two]:
            return []
        if one == two:
            return [(i, i) for i in range(len(self.runs[one]))]
        if not self.runs[one] or not self.runs[two]:
            return []
        self.size(one, two)
        return self.pairs[one, two]


def _alignment(left: tuple[int, ...], right: tuple[int, ...], weights: dict) -> list[tuple[int, int]]:
    """Pairs of places of two sequences, in order, that are worth most together."""
    places = {shape: at for at, shape in enumerate(dict.fromkeys(right))}
    columns = np.array([places[shape] for shape in right])
    by_shape: dict[int, np.ndarray] = {}
    for shape, worth in weights.items():
        row = np.zeros(len(places), np.int32)
        for other, value in worth.items():
            row[places[other]] = value
        by_shape[shape] = row

    def row(i: int, low: int, high: int) -> np.ndarray:
        return by_shape[left[i]][columns[low:high]]

    def onward(best: np.ndarray, i: int, low: int, high: int) -> np.ndarray:
        """What the rows up to ``i`` reach with each beginning of the columns, from what those before it do."""
        reached = best.copy()
        reached[1:] = np.maximum(best[1:], best[:-1] + row(i, low, high))
        return np.maximum.accumulate(reached)

    found: list[tuple[int, int]] = []
    # Blocks of rows, the last on top, each with what is reached before it; paths end at column ``high``.
    open_ = [(0, len(left), np.zeros(len(right) + 1, np.int64))]
    high = len(right)
    while open_ and high:
        top, bottom, before = open_.pop()
        before = before[: high + 1]
        if bottom - top > 1 and (bottom - top) * high > TABLE:
            step = -(-(bottom - top) // SPLIT)
            kept, best = [], before
            for i in range(top, bottom):
                if (i - top) % step == 0:
                    kept.append((i, min(i + step, bottom), best))
                best = onward(best, i, 0, high)
            open_.extend(kept)
            continue
        table = [before]
        for i in range(top, bottom):
            table.append(onward(table[-1], i, 0, high))
        i = bottom - top
        while i and high:
            if table[i][high] == table[i - 1][high]:
                i -= 1
            elif table[i][high] == table[i][high - 1]:
                high -= 1
            else:
                i, high = i - 1, high - 1
                found.append((top + i, high))
    return found[::-1]


def match(one: Node, two: Node, shapes: Shapes | None = None) -> tuple[int, list[tuple[int, int]]]:
    """The most nodes that two trees share in order, and the places of their roots' runs that match."""
    shapes = shapes or Shapes()
    shapes.name(one)
    shapes.name(two)
    return shapes.size(one.shape, two.shape), shapes.matched(one.shape, two.shape)


def aligned(pattern: Node, page: Node, shapes: Shapes | None = None) -> dict[int, Node]:
    """Nodes of ``page`` by id, with the node of ``pattern`` that they stand for.

    Both are named by ``shapes``; without any they are named here.
    """
    if shapes is None:
        shapes = Shapes()
        shapes.name(pattern)
        shapes.name(page)
    found: dict[int, Node] = {}
    open_ = [(pattern, page)]
    while open_:
        one, two = open_.pop()
        found[id(two)] = one
        left, right = runs(one), runs(two)
        for i, j in shapes.matched(one.shape, two.shape):
            # All of a run stand for the first of its counterpart.
            open_.extend((left[i][0], kid) for kid in right[j])
    return found


def text_of(node: Node, dropped) -> list[str]:
    """The blocks below ``node``, in order, each with single spaces."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    open_: list = [node]
    while open_:
        item = open_.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif not dropped(item):
            if not item.inline:
                flush()
                open_.append(None)
            open_.extend(reversed(item.parts))
    flush()
    return blocks


class Wrapper:
    """What a block of pages has in common: template nodes, and where the content is."""

    def __init__(self, pages: list[tuple[Node, str]]):
        self.pattern = max(pages, key=lambda p: len(runs_below(p[0])))[0]
        shapes = Shapes()
        for page, _ in pages:
            shapes.name(page)
        self.maps = [aligned(self.pattern, page, shapes) for page, _ in pages]
        nodes = runs_below(self.pattern)
        texts: dict[int, dict[str, set]] = {id(n): {} for n in nodes}
        seen: set = set()
        distinct: list[tuple[Node, dict]] = []
        repeated: set[int] = set()
        for (page, _), mapped in zip(pages, self.maps, strict=True):
            content = "\n".join(text_of(page, lambda n: False))
            if content in seen:
                continue
            seen.add(content)
            distinct.append((page, mapped))
            for node in runs_below(page):
                repeated.update(id(mapped.get(id(r[0]))) for r in runs(node) if len(r) > 1)
                stands = mapped.get(id(node))
                if stands is not None:
                    own = self._own(node)
                    if own:
                        texts[id(stands)].setdefault(own, set()).add(len(seen))
        self.alone = len(seen) < AGREEING
        agreeing = max(AGREEING, math.floor(len(seen) * TEMPLATE) + 1)
        self.constant = {
            key: next(iter(held))
            for key, held in texts.items()
            if key not in repeated and len(held) == 1 and len(next(iter(held.values()))) >= agreeing
        }
        self._open_forms([page for page, _ in pages])
        sizes = dict.fromkeys(texts, 0)
        for page, mapped in distinct:
            for node in runs_below(page):
                stands = mapped.get(id(node))
                if stands is not None and not node.aside:
                    sizes[id(stands)] += node.size
        self.content = self._content(sizes)

    @staticmethod
    def _own(node: Node) -> str:
        """The text of a node that can be template as a whole: one without blocks, or a list of links."""
        return "\n".join(text_of(node, lambda n: False)) if not node.kids or linking(node) else ""

    def _constant(self, node: Node, mapped: dict[int, Node]) -> bool:
        stands = mapped.get(id(node))
        return stands is not None and id(stands) in self.constant and self._own(node) == self.constant[id(stands)]

    def _open_forms(self, pages: list[Node]) -> None:
        """A form that holds most of its pages' varying text is their body, not a region of it."""
        forms: dict[int, list[Node]] = {}
        inside: dict[int, int] = {}
        around: dict[int, int] = {}
        for page, mapped in zip(pages, self.maps, strict=True):
            order = order_of(page)
            if not any(n.tag == "form" for n in order):
                continue
            varying: dict[int, int] = {}
            for node in reversed(order):
                own = node.size - sum(k.size for k in node.kids)
                left_out = (node.aside and node.tag != "form") or self._constant(node, mapped)
                varying[id(node)] = 0 if left_out else own + sum(varying[id(k)] for k in node.kids)
            for node in order:
                if node.tag == "form":
                    place = id(mapped.get(id(node), node))
                    forms.setdefault(place, []).append(node)
                    inside[place] = inside.get(place, 0) + varying[id(node)]
                    around[place] = around.get(place, 0) + varying[id(page)]
        for place, nodes in forms.items():
            if inside[place] > MOST * max(1, around[place]):
                for node in nodes:
                    node.aside = ""

    def _content(self, sizes: dict[int, int]) -> set[int]:
        """Ids of the pattern's nodes that are the content: one, or several articles."""
        nodes = [n for n in runs_below(self.pattern) if not n.aside]
        articles = [n for n in nodes if n.tag in ARTICLE_TAGS and sizes.get(id(n), 0)]
        if articles:
            most = max(sizes[id(n)] for n in articles)
            own = [n for n in articles if n.tag == "article" and sizes[id(n)] > MOST * most]
            return {id(max(own or articles, key=lambda n: sizes[id(n)]))}
        at = self.pattern
        while True:
            inner = [
                k for k in at.kids
                if not k.aside and k.kids and id(k) not in self.constant
                and sizes.get(id(k), 0) > MOST * max(1, sizes.get(id(at), 0))
            ]
            if not inner:
                return {id(at)}
            at = max(inner, key=lambda k: sizes[id(k)])

    def _kept(self, root: Node, mapped: dict[int, Node]) -> set[int]:
        """Ids of constant nodes of the article's text that stand between varying text."""
        order = order_of(root)
        varying, textual = [], []
        for at, node in enumerate(order):
            if self._constant(node, mapped):
                if node.tag in TEXTUAL:
                    textual.append((at, node))
            elif not node.aside and node.size > sum(k.size for k in node.kids) and node is not root:
                varying.append(at)
        if not varying:
            return set()
        return {id(node) for at, node in textual if varying[0] < at < varying[-1]}

    def read(self, page: Node, mapped: dict[int, Node]) -> list[str]:
        def dropped(node: Node, top: Node, kept: set[int]) -> bool:
            if node.aside in ("tag", "readers"):
                return True
            if node.aside and node.size <= NAMED * top.size:
                return True
            if self._constant(node, mapped):
                return id(node) not in kept
            # Where no pages agree, only names and links tell what is not the article.
            return self.alone and top.tag not in ARTICLE_TAGS and linking(node)

        roots = [n for n in order_of(page) if (s := mapped.get(id(n))) is not None and id(s) in self.content]
        if not roots:
            roots = [n for n in order_of(page) if n.tag in ARTICLE_TAGS and not n.aside][:1] or [page]
        held: set = set()
        found: list[str] = []
        for root in roots:
            if id(root) not in held:
                held.update(id(n) for n in order_of(root))
                kept = self._kept(root, mapped)
                found.extend(text_of(root, lambda n, top=root, kept=kept: n is not top and dropped(n, top, kept)))
        # Names that rule out all of a page say nothing about it.
        return found or text_of(page, lambda n: n.aside == "tag")


def order_of(node: Node) -> list[Node]:
    found, open_ = [], [node]
    while open_:
        node = open_.pop()
        found.append(node)
        open_.extend(reversed(node.kids))
    return found


def runs_below(node: Node) -> list[Node]:
    """The nodes at and below ``node``; of a run, the first only."""
    found, open_ = [], [node]
    while open_:
        node = open_.pop()
        found.append(node)
        open_.extend(run[0] for run in reversed(runs(node)))
    return found


def extract(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    held = {page for page in pages if page}
    if not held:
        return ["" for _ in pages]
    order = sorted(held)
    trees = [tree(page) for page in order]
    wrapper = Wrapper(trees)
    found = {
        page: "\n".join(wrapper.read(root, mapped))
        for page, (root, _), mapped in zip(order, trees, wrapper.maps, strict=True)
    }
    return [found.get(page, "") for page in pages]


def main_text(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per page: ``page_id``, ``url``, ``text``, ``n_chars``."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    hosts = staged(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("n")).first()["n"]
    share = max(block, total // HOT_PART)
    # At most a thousand hosts have more than a thousandth of the pages.
    hot = hosts.where(F.col("pages") > share).select("host", F.ceil(F.col("pages") / share).alias("parts"))
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))
    dealt = (
        rows.join(F.broadcast(hot), "host", "left")
        .withColumn("part", part)
        .select("host", "part", "page_id", "url", "html")
        .repartition("host", "part")
        .sortWithinPartitions("host", "part", "page_id", "url")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def out(pages: int) -> pa.RecordBatch:
            ids, urls, htmls = zip(*held[:pages], strict=True)
            texts = extract(list(htmls))
            del held[:pages]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(urls, pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

        def rest() -> Iterator[pa.RecordBatch]:
            if len(held) > block:
                yield out(-(-len(held) // 2))
            if held:
                yield out(len(held))

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for name, number, page, url, html in zip(*columns, strict=True):
                key = (name.as_py(), number.as_py())
                if key != last:
                    yield from rest()
                elif len(held) >= 2 * block:
                    yield out(block)
                last = key
                held.append((page.as_py(), url.as_py(), html.as_py()))
        yield from rest()

    return dealt.mapInArrow(run, struct_of("page_id bigint, url string, text string, n_chars bigint"))
