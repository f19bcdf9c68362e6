"""Main text of web pages by wrapper induction.

Pages of a host meet in blocks of bounded size (a hot host has many blocks). In a block, each page's DOM tree is aligned
with the block's wrapper tree by simple tree matching: the largest set of node pairs that keeps order and parents, of
equal tag and class; nodes that no wrapper node matches are added to the wrapper. A wrapper node whose text is the same on
nearly all distinct pages of the block that have it is template; one whose text varies, or is on few pages, is a slot. Content is what stands in slots of the main
containers, outside regions whose role (tag, class, id, ARIA role) is navigation, advert, form, comment and the like:
such regions vary from page to page too, so variation alone does not make content. The containers are all
outermost article elements, or else main elements, or else the page without what stands beside the way to its heaviest
block and holds nothing but template, noise and links.

Class words tell a region's role outright only where all words of the class do. Inside an article other classes that hold
such a word (ad-hoc, share-price) are noise only if the region stands on half the pages of the block, and headings,
paragraphs, items and cells never are; nor is a single one of these template there, however many pages have it.

Elements below DEPTH are not nested further, as in browsers: their text and the ends of their blocks stay, in order. After a
quote that never closes tags end at the next >.

Null and empty html give an empty text. Pages without url form a host of their own. Repeated rows get equal results: equal pages
count once in a block. Broken markup never raises: unclosed elements end where their parents do. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Pages of a block, about, and the most that a task holds at once in distinct pages and their characters.
BLOCK_PAGES, HELD_PAGES, HELD_CHARS = 48, 96, 8 << 20
#: Hosts of more than one block that are broadcast (a name and a number each).
LISTED_HOSTS = 100_000
#: Elements are nested so deep; deeper ones stand beside their text in the deepest.
DEPTH = 256
#: Distinct pages that must agree on a text inside the container before it counts as template.
TEMPLATE_PAGES = 8
#: Share of the pages with a node that must agree on its text before it counts as template.
TEMPLATE_SHARE = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An open element of the key ends when one of these begins.
ENDED_BY = {
    "p": BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
#: Elements that bound the search for an element to end.
SCOPE = frozenset("html body table td th ul ol dl article main section aside nav header footer div form".split())
NEVER = frozenset("head nav aside footer form script style template noscript iframe button select option textarea dialog svg canvas object menu title input search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that name a region which is no content, and words that may stand beside them.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay comment comments commentlist disqus respond replies share sharing social related recommended newsletter subscribe signup login paywall widget sidebar breadcrumb breadcrumbs pagination pager menu nav navbar navigation toolbar skip masthead topbar footer copyright hidden".split()
)
PLAIN_WORDS = frozenset("site page main header box list container wrapper block unit slot area bar section inner outer button buttons icon icons link links form post posts top bottom left right large small wide sticky fixed mobile desktop primary secondary content row col group a b c the".split())
#: Elements of text: inside an article their class says nothing of their role.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr pre blockquote figcaption caption b i em strong u code q cite sup sub mark br".split())
_WORDS = re.compile(r"[\s_-]+")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("tag", "attrs", "children", "kind", "noise", "doubt", "size", "shape")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children, self.size, self.shape = tag, [], 1, 0
        self.attrs = attributes(attrs) if attrs and not attrs.isspace() else {}
        self.kind = tag if not self.attrs else f"{tag}.{self.attrs.get('class', '')}"
        named = self._named() if self.attrs and tag not in ("body", "html") else 0
        #: noise: a region that is no content; doubt: its class alone, or a part of it, says so.
        self.noise, self.doubt = tag in NEVER or self._hidden() or named > 0, tag not in NEVER and not self._hidden() and named

    def _hidden(self) -> bool:
        a = self.attrs
        if not a or self.tag in ("body", "html"):
            return False
        return a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()

    def _named(self) -> int:
        """0: class and id name no such region; 1: one of their words does; 2: a class or an id says nothing else."""
        found = 0
        for text in (self.attrs.get("class", ""), self.attrs.get("id", "")):
            words = [w for w in _WORDS.split(text.lower()) if w and not w.isdigit()]
            if not NOISE_WORDS.isdisjoint(words):
                found = max(found, 2 if all(w in NOISE_WORDS or w in PLAIN_WORDS for w in words) else 1)
        return found

    def nodes(self) -> list[Node]:
        return [c for c in self.children if c.__class__ is Node]


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, rest, end) of each tag ("<" or "</") and text ("") of a page, in linear time; send(place) goes on there."""
    at, end, quoted = 0, len(page), True
    while at < end:
        if page[at] != "<":
            to = page.find("<", at)
            to = end if to < 0 else to
            at = (yield "", "", page[at:to], to) or to
            continue
        m = _OPEN.match(page, at)
        if m is None:
            other = _OTHER.match(page, at)
            if other:
                at = other.end()
            else:
                at = (yield "", "", "<", at + 1) or at + 1
            continue
        rest = _REST.match(page, m.end()) if quoted else None
        if rest is None:
            # no > outside of quotes from here on: quotes bound nothing any more
            quoted, to = False, page.find(">", m.end())
            if to < 0:
                at = (yield "", "", page[at:], end) or end
                continue
            inner, to = page[m.end() : to], to + 1
        else:
            inner, to = rest[1], rest.end()
        at = (yield "</" if m[1] else "<", m[2].lower(), inner, to) or to


def parse(page: str) -> Node:
    """The tree of a page under a root of its own; text children are strings with references decoded."""
    root = Node("#root")
    stack = [root]
    deep: list[str] = []  # tags that are open below the deepest node
    held: dict[str, int] = {}
    tokens = _tokens(page)
    go = None
    while True:
        try:
            kind, name, rest, at = tokens.send(go)
        except StopIteration:
            return root
        go = None
        if not kind:
            stack[-1].children.append(entities.unescape(rest) if "&" in rest else rest)
            continue
        if kind == "</":
            if name in VOID:
                continue
            if held.get(name):
                while True:
                    tag = deep.pop()
                    held[tag] -= 1
                    if tag in BLOCK:
                        stack[-1].children.append(Node("div"))
                    if tag == name:
                        break
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    deep, held = [], {}
                    break
                if name not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag does not end a block
            continue
        if not deep:
            for k in range(len(stack) - 1, 0, -1):
                if name in ENDED_BY.get(stack[k].tag, ()):
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        node = Node(name, rest)
        stack[-1].children.append(node)
        if name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(page, at)
            node.children.append(page[at : stop.start() if stop else len(page)])
            go = stop.end() if stop else len(page)
        elif name not in VOID and (name in BLOCK or not rest.rstrip().endswith("/")):  # HTML knows no self-closing blocks
            if len(stack) < DEPTH:
                stack.append(node)
            else:
                deep.append(name)
                held[name] = held.get(name, 0) + 1


def _sizes(node: Node) -> int:
    below = node.nodes()
    node.size = 1 + sum([_sizes(c) for c in below])
    node.shape = hash((node.kind, *[c.shape for c in below]))
    return node.size


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]], known: dict | None = None) -> int:
    """Simple tree matching of two trees: the number of matched nodes; appends the matched pairs.

    known keeps the numbers of pairs of shapes, for further calls.
    """
    if a.kind != b.kind:
        return 0
    known = {} if known is None else known
    pairs.append((a, b))
    return 1 + sum([match(p, q, pairs, known) for p, q in _children(a, b, known)])


def _matched(p: Node, q: Node, known: dict) -> int:
    """The number of matched nodes of two trees."""
    if p.kind != q.kind:
        return 0
    if p.shape == q.shape or p.size == 1 or q.size == 1:
        return min(p.size, q.size)
    key = (p.shape, q.shape)
    if key not in known:
        known[key] = 1 + sum([_matched(x, y, known) for x, y in _children(p, q, known)])
    return known[key]


def _children(a: Node, b: Node, known: dict) -> list[tuple[Node, Node]]:
    """The pairs of a best alignment of the children; equal ends match each other in some best one."""
    x, y = a.nodes(), b.nodes()
    lo, n = 0, min(len(x), len(y))
    while lo < n and x[lo].shape == y[lo].shape:
        lo += 1
    hi = 0
    while hi < n - lo and x[-1 - hi].shape == y[-1 - hi].shape:
        hi += 1
    ends = list(zip(x[len(x) - hi :], y[len(y) - hi :], strict=True))
    return list(zip(x[:lo], y[:lo], strict=True)) + _aligned(x[lo : len(x) - hi], y[lo : len(y) - hi], known) + ends


def _aligned(x: list[Node], y: list[Node], known: dict) -> list[tuple[Node, Node]]:
    """The pairs of a best alignment of two lists, in linear space: halves of x meet where their totals are greatest."""
    if not x or not y:
        return []
    if len(x) == 1:
        w = [_matched(x[0], q, known) for q in y]
        j = max(range(len(y)), key=w.__getitem__)
        return [(x[0], y[j])] if w[j] else []
    half = len(x) // 2
    cut = int((_totals(x[:half], y, known) + _totals(x[half:][::-1], y[::-1], known)[::-1]).argmax())
    return _aligned(x[:half], y[:cut], known) + _aligned(x[half:], y[cut:], known)


def _totals(x: list[Node], y: list[Node], known: dict) -> np.ndarray:
    """The nodes that x matches in each prefix of y."""
    shapes: dict[int, int] = {}
    where = np.array([shapes.setdefault(q.shape, len(shapes)) for q in y])
    firsts = list({q.shape: q for q in y}.values())
    rows: dict[int, np.ndarray] = {}
    best = np.zeros(len(y) + 1, np.int64)
    for p in x:
        if p.shape not in rows:
            rows[p.shape] = np.array([_matched(p, q, known) for q in firsts])
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + rows[p.shape][where]))
    return best


def _own(node: Node) -> str:
    """A node's own text, without its child elements."""
    return " ".join(" ".join(c for c in node.children if c.__class__ is str).split())


class Wrapper:
    """The template of a block of pages: the nodes of all its pages, and how often each has which text of its own."""

    def __init__(self):
        self.tree, self.pages, self.texts, self.known = Node("#root"), 0, {}, {}
        _sizes(self.tree)

    def align(self, page: Node) -> dict[int, Node]:
        """Page node id -> wrapper node; nodes that no wrapper node matches become wrapper nodes."""
        pairs: list[tuple[Node, Node]] = []
        match(self.tree, page, pairs, self.known)
        matched = {id(b): a for a, b in pairs}
        grown = False
        for a, b in pairs:
            at = 0
            for c in b.nodes():
                own = matched.get(id(c))
                if own is None:
                    a.children.insert(at, _skeleton(c, matched))
                    at, grown = at + 1, True
                else:
                    at = a.children.index(own, at) + 1
        if grown:
            _sizes(self.tree)
        return matched

    def learn(self, page: Node, matched: dict[int, Node]) -> None:
        self.pages += 1
        for node in _walk(page):
            self.texts.setdefault(id(matched[id(node)]), Counter())[_own(node)] += 1

    def constant(self, node: Node, matched: dict[int, Node], least: int) -> bool:
        """Whether a page node's text is that of nearly all pages that have the node: so many at least, or TEMPLATE_PAGES if some lack it."""
        seen = self.texts.get(id(matched.get(id(node))))
        if not seen:
            return False
        n = seen.total()
        return seen[_own(node)] >= max(least if n == self.pages else TEMPLATE_PAGES, TEMPLATE_SHARE * n)

    def usual(self, node: Node, matched: dict[int, Node]) -> bool:
        """Whether a region stands on half the pages, of four or more."""
        seen = self.texts.get(id(matched.get(id(node))))
        return bool(seen) and seen.total() >= max(4, self.pages / 2)

    def template(self, node: Node, matched: dict[int, Node], least: int) -> bool:
        """Whether all text of a subtree is constant."""
        return all(self.constant(n, matched, least) for n in _walk(node) if not n.noise and _own(n))


def _skeleton(node: Node, matched: dict[int, Node]) -> Node:
    """A copy of a subtree without its texts; each node is matched with its copy."""
    copy = matched[id(node)] = Node(node.tag)
    copy.kind, copy.noise = node.kind, node.noise
    copy.children = [_skeleton(c, matched) for c in node.nodes()]
    return copy


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        if not n.noise:
            todo.extend(n.nodes())


def _weight(node: Node, wrapper: Wrapper | None, matched: dict, inside: dict[int, int], link: bool = False) -> int:
    """Characters of varying text that is no link in each element's subtree."""
    total = 0
    link = link or node.tag == "a"
    if not link and (wrapper is None or not wrapper.constant(node, matched, 2)):
        total += sum(len(c.strip()) for c in node.children if c.__class__ is str)
    for c in node.nodes():
        if not c.noise:
            total += _weight(c, wrapper, matched, inside, link)
    inside[id(node)] = total
    return total


def container(page: Node, wrapper: Wrapper | None, matched: dict) -> tuple[list[Node], set[int], set[int]]:
    """The outermost elements that hold the main text, in order; ids of nodes in them to leave out; ids of those whose own text to leave out.

    Without article or main it is the page, less what stands beside the way to its heaviest block and is template, noise
    or link text only.
    """
    named: dict[str, list[Node]] = {"article": [], "main": []}
    for n in _walk(page):
        if n.noise:
            continue
        if n.tag == "article" or n.attrs.get("itemprop") == "articleBody":
            named["article"].append(n)
        elif n.tag == "main" or n.attrs.get("role") == "main":
            named["main"].append(n)
    for kind in ("article", "main"):
        if named[kind]:
            own = {id(n) for n in named[kind]}
            nested = {id(x) for n in named[kind] for c in n.nodes() for x in _walk(c) if not c.noise and id(x) in own}
            return [n for n in named[kind] if id(n) not in nested][::-1], set(), set()  # _walk takes the last child first
    inside: dict[int, int] = {}
    whole = _weight(page, wrapper, matched, inside)
    at, left, mute = page, set(), set()
    while True:
        below = [c for c in at.nodes() if not c.noise and c.tag in BLOCK and inside.get(id(c), 0) >= 0.7 * whole and c.tag not in ("p", "li", "td", "pre", "blockquote")]
        if not whole or not below:
            for c in at.nodes():  # the innermost block's header holds its title
                c.noise = c.noise and c.tag != "header"
            return [page], left, mute
        if wrapper is not None and wrapper.constant(at, matched, 2):
            mute.add(id(at))
        left.update(id(c) for c in at.nodes() if c is not below[0] and c.tag not in VOID and not inside.get(id(c), 0))
        at = below[0]


def text_of(page: Node, wrapper: Wrapper | None, matched: dict) -> str:
    """The blocks of the containers, joined by empty lines."""
    tops, left, mute = container(page, wrapper, matched)
    heads = {id(n) for n in tops if n.tag != "#root"}
    done: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            text = " ".join("".join(line).split())
            if text:
                done.append(text)
            line.clear()

    def visit(node: Node) -> None:
        for c in node.children:
            if c.__class__ is str:
                line.append(" " if id(node) in mute else c)
            elif id(c) in left or c.noise and not (c.tag == "header" and id(node) in heads):
                line.append(" ") if c.tag not in BLOCK else end()
            elif c.doubt and wrapper is not None and wrapper.usual(c, matched):
                line.append(" ") if c.tag not in BLOCK else end()
            elif c.tag in BLOCK:
                end()
                if wrapper is None or heads and c.tag in TEXTUAL or not wrapper.template(c, matched, TEMPLATE_PAGES):
                    visit(c)
                end()
            elif c.tag in VOID:
                line.append(" ")
            else:
                visit(c)

    for top in tops:
        if top.tag == "header" or not top.noise:
            visit(top)
        end()
    return "\n\n".join(done)


def _roles(page: Node) -> None:
    """What the article around them makes of regions: a header outside is the site's, one inside holds the title; classes inside
    that only partly name such a region, and those of elements of text, leave it open (doubt) or say nothing."""
    todo = [(page, False)]
    while todo:
        n, article = todo.pop()
        if n.doubt and article and n.noise:
            if n.tag in TEXTUAL:
                n.noise = n.doubt = False
            elif n.doubt == 1:
                n.noise = False
        else:
            n.doubt = False
        article = article or n.tag == "article"
        if n.tag == "header" and not article:
            n.noise = True
        todo.extend((c, article) for c in n.nodes())


def extract(pages: list[str]) -> list[str]:
    """Main texts of the pages of one host."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * DEPTH))  # trees are DEPTH deep at most
    trees: dict[str, Node] = {}
    for page in pages:
        if page and page not in trees:
            tree = trees[page] = parse(page)
            _roles(tree)
            _sizes(tree)
    if not trees:
        return [""] * len(pages)
    wrapper = Wrapper()
    matches = {}
    for page, tree in trees.items():
        matches[page] = wrapper.align(tree)
        wrapper.learn(tree, matches[page])
    texts = {page: text_of(tree, wrapper if len(trees) > 1 else None, matches[page]) for page, tree in trees.items()}
    return [texts.get(p, "") for p in pages]


def main_text(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    # only hosts with more pages than a block are listed; the others are one block
    big = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_pages).select("host", F.ceil(F.col("n") / block_pages).cast("int").alias("blocks"))
    # the pages themselves move once, to their blocks: the list is broadcast where its measured size allows it
    big = stored(big, "hosts")
    salted = rows.join(F.broadcast(big) if big.count() <= LISTED_HOSTS else big, "host", "left").select("page_id", "url", "html", "host", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("blocks")), F.lit(0)).alias("block"))

    def run(batches):
        key, held, known, size = None, [], {}, 0

        def done():
            every = dict(zip(known, extract(list(known)), strict=True))
            for i in range(0, len(held), HELD_PAGES):
                yield made(held[i : i + HELD_PAGES], every)

        def made(held, every):
            texts = [every[h] for _, _, h in held]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for page, url, page_html, h, b in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    page_html = page_html or ""
                    if held and ((h, b) != key or page_html not in known and (len(known) >= HELD_PAGES or size > HELD_CHARS)):
                        yield from done()
                        held, known, size = [], {}, 0
                    key = (h, b)
                    if page_html not in known:
                        size += len(page_html)
                    held.append((page, url, known.setdefault(page_html, page_html)))
        if held:
            yield from done()

    placed = salted.repartition("host", "block").sortWithinPartitions("host", "block", "page_id")
    return placed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
