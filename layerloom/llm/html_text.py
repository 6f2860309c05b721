"""HTML extraction: the main text of a page by scoring its tree.

Method. A tolerant reader builds a tree: void and self-ending elements, implied ends of paragraphs and list items,
stray end tags and a page that breaks off are all accepted; scripts, styles and comments never become text. Elements
that are boilerplate by kind (nav, footer, ...) or role are dropped with all they hold. Forms and elements with a
boilerplate word in class or id (menu, sidebar, ad, cookie, comment, ...) are dropped unless they are marked as the
main text or hold most of the page's unlinked text; words after no-, has- or with- don't count, nor does a header's
inside the article. Comments, advertisements and the like stay only where nothing else is left. Each block of text gives
points for its length and its commas to its parent and half of them to its grandparent; a container's points are
discounted by the share of its text that is in links. The best container is kept, and of its siblings those that are
paragraphs of prose or score a fair part of the best. Its blocks are joined in page order.

Within a block every run of white space, line breaks included, becomes one space; character references are decoded.

Defined cases: a null, empty or tagless-and-blank page gives an empty text; a page without any container gives the text
of its blocks; a broken reference or tag at the end of a page that breaks off is text or dropped as browsers do; very
long and very deep pages take time in proportion to their length; repeated rows give repeated results, an empty table none;
other columns are carried along, but for one named as a result, which the result replaces.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm._spark import batched, packed_row
from layerloom.llm._stats import slices

# Element names of HTML and words that mark boilerplate in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style template noscript iframe object embed svg canvas head title nav footer aside button select option input textarea dialog menu audio video map".split())
CLOSES_P = BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div body html td th".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer|foot|header|masthead|cookie\w*|consent|gdpr|notice\w*|"
    r"popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|widget|comments?|commentlist|disqus|replies|reply|respond|pagination|pager|tags|"
    r"toolbar|copyright|legal|disclaimer|search)(?:$|[\s_-])",
    re.I,
)
# Words of elements that have a text of their own, which may be longer than the page's.
FOREIGN = re.compile(r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|cookie\w*|consent|gdpr|newsletter|subscri\w*|related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|copyright|disclaimer)(?:$|[\s_-])", re.I)
MODIFIED = re.compile(r"(?:^|(?<=[\s_-]))(?:no|not|non|has|have|with|without|hide|show)[_-]+[^\s_-]+", re.I)
HEADERS = re.compile(r"(?:^|(?<=[\s_-]))header(?=$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|story|entry|body|text)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|=)*)(>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"[\s​﻿]+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "main", "doubt", "score", "size", "linked", "within", "sums")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, main: bool = False, doubt: str = ""):
        self.tag, self.parent, self.drop, self.main, self.doubt = tag, parent, drop, main, doubt
        self.children: list[Node | str] = []
        self.score, self.size, self.linked = 0.0, 0, 0
        self.within = False
        self.sums = [0, 0, 0]


def _kind(tag: str, raw: str, inside_main: bool) -> tuple[bool, bool, str]:
    """Whether an element is boilerplate, whether it is marked as the main text, and why it may be boilerplate."""
    main, doubt = tag in ("article", "main"), tag if tag == "form" else ""
    if tag in DROPPED or (tag == "header" and not inside_main):
        return True, False, ""
    if "=" in raw or "hidden" in raw:
        named = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)}
        label = " ".join(named.get(k, "") for k in ("class", "id"))
        if (
            named.get("role", "").lower() in ROLES
            or named.get("aria-hidden", "").lower() == "true"
            or _HIDDEN.search(named.get("style", ""))
            or re.search(r"(?:^|\s)hidden(?:$|[\s=])", re.sub(r"\"[^\"]*\"|'[^']*'", "", raw))
        ):
            return True, False, ""
        words = MODIFIED.sub("", label).split()
        if named.get("role", "").lower() == "main":
            return False, True, ""
        bad = [w for w in words if BOILERPLATE.search(HEADERS.sub("", w) if inside_main or MAIN.search(w) else w)]
        marked = any(MAIN.search(w) and not BOILERPLATE.search(w) for w in words)
        if bad and tag not in ("body", "html") and not main and not (marked and not any(BOILERPLATE.fullmatch(w) for w in bad)):
            doubt = " ".join(bad)
        main = main or marked
    return False, main, doubt


class _Open:
    """The open elements, with counts by which a search for one that isn't there is never begun.

    tags counts all of them; in each block, inline counts the inline elements opened since; in each element of SCOPE,
    scoped counts what was opened since. So every step up the tree closes an element for good.
    """

    def __init__(self, root: Node):
        self.here, self.main = root, 0
        self.tags: Counter[str] = Counter([root.tag])
        self.inline, self.scoped, self.scopes = [Counter()], [Counter()], [root]

    def enter(self, node: Node) -> None:
        self.here = node
        self.main += node.main
        self.tags[node.tag] += 1
        if node.tag in BLOCKS:
            self.inline.append(Counter())
        else:
            self.inline[-1][node.tag] += 1
        if node.tag in SCOPE:
            self.scoped.append(Counter())
            self.scopes.append(node)
        else:
            self.scoped[-1][node.tag] += 1

    def leave(self) -> None:
        node = self.here
        self.main -= node.main
        self.tags[node.tag] -= 1
        if node.tag in BLOCKS:
            self.inline.pop()
        else:
            self.inline[-1][node.tag] -= 1
        if node.tag in SCOPE:
            self.scoped.pop()
            self.scopes.pop()
        else:
            self.scoped[-1][node.tag] -= 1
        self.here = node.parent

    def end(self, tag: str) -> bool:
        """Closes the innermost element of a tag and all within it; an inline end tag never closes a block."""
        if tag == "html" or not (self.tags if tag in BLOCKS else self.inline[-1])[tag]:
            return False
        while self.here.tag != tag:
            self.leave()
        self.leave()
        return True

    def make_room(self, tag: str) -> None:
        """Closes what a block's start ends by itself: an open paragraph, and of its own kind what can't hold it."""
        closing = ("p", *CLOSED_BY.get(tag, ())) if tag in CLOSES_P else CLOSED_BY.get(tag, ())
        if any(self.scoped[-1][t] for t in closing):
            while self.here.tag not in closing:
                self.leave()
            self.leave()
        elif self.scopes[-1].tag in closing:  # a cell ends the cell that it starts in
            scope = self.scopes[-1]
            while self.here is not scope:
                self.leave()
            self.leave()


def parse(page: str) -> Node:
    """The tree of a page; text nodes have their references decoded."""
    root = Node("html", None)
    at, n = 0, len(page)
    opened = _Open(root)
    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            opened.here.children.append(entities.unescape(page[at:]))
            break
        if found.start() > at:
            opened.here.children.append(entities.unescape(page[at : found.start()]))
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            if not opened.end(tag) and tag == "br":
                opened.here.children.append(" ")
        elif found[2]:
            tag, raw = found[2].lower(), found[3]
            if not found[4]:
                break  # a tag that the page breaks off in
            opened.make_room(tag)
            if tag == "html" or (tag == "body" and opened.tags["body"]):
                continue
            node = Node(tag, opened.here, *_kind(tag, raw, opened.main > 0))
            opened.here.children.append(node)
            if tag in RAW and not raw.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if tag not in DROPPED:
                    node.children.append(page[at : end.start() if end else n])
                at = end.end() if end else n
            elif tag not in VOID and not (raw.endswith("/") and tag not in BLOCKS):
                opened.enter(node)
    return root


def _in_order(root: Node) -> list[Node]:
    """All elements, parents first, in page order; what is dropped is left out."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    return out


def blocks_of(root: Node) -> list[tuple[Node, str, int]]:
    """(element, text, characters in links) of each block of text that isn't boilerplate, in page order."""
    out: list[tuple[Node, str, int]] = []
    pieces: list[tuple[str, bool]] = []

    def flush(owner: Node) -> None:
        if pieces:
            text = _SPACE.sub(" ", "".join(p for p, _ in pieces)).strip()
            if text:
                out.append((owner, text, sum(len(p.strip()) for p, link in pieces if link)))
            pieces.clear()

    stack: list[tuple[Node, int, Node, bool]] = [(root, 0, root, False)]
    while stack:
        node, k, owner, link = stack.pop()
        if k == 0 and node.tag in BLOCKS:
            flush(stack[-1][2] if stack else owner)
            owner = node
        while k < len(node.children):
            child = node.children[k]
            k += 1
            if isinstance(child, str):
                pieces.append((child, link))
            elif child.tag == "br":
                pieces.append((" ", link))
            elif not child.drop:
                stack.append((node, k, owner, link))
                stack.append((child, 0, owner, link or child.tag == "a"))
                break
            elif child.tag in BLOCKS:
                flush(owner)
        else:
            if node.tag in BLOCKS:
                flush(owner)
    return out


def _sums(root: Node) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The elements and blocks that aren't dropped. Each element's sums, made from the leaves up in one pass: its text
    without links and headings, what of it is marked as main text, and its first headings.
    """
    nodes, blocks = _in_order(root), blocks_of(root)
    marked = {id(root): False}
    for node in nodes:
        node.sums = [0, 0, 0]
        if node.parent is not None:
            node.within = node.parent.within or node.parent.main
            marked[id(node)] = marked[id(node.parent)] or (node.main and not node.doubt)
    for owner, text, linked in blocks:
        size = len(text) - linked if owner.tag not in HEADINGS else 0
        for k, x in enumerate((size, size * marked[id(owner)], int(owner.tag == "h1"))):
            owner.sums[k] += x
    for node in reversed(nodes[1:]):
        for k in range(3):
            node.parent.sums[k] += node.sums[k]
    return nodes, blocks


def settle(root: Node) -> list[tuple[Node, str, int]]:
    """The blocks that are left when elements in doubt are dropped, except those that hold most of the page's text.

    Foreign ones (comments, adverts, ...) are looked at first: they go if there is other text, unless all marked text is
    inside. Of the rest, an element in doubt stays if it has more than half of the page's text and more than four times what is
    marked as main text outside of it, or, within the main text, all headings of the first level.
    """
    nodes, blocks = _sums(root)
    for foreign in (True, False):
        doubted = [x for x in nodes if x.doubt and bool(FOREIGN.search(x.doubt)) == foreign]
        if not doubted:
            continue
        total, left_marked, headings = root.sums
        gone: set[int] = set()
        for node in doubted:
            if id(node.parent) in gone:
                continue
            own, own_marked, own_headings = node.sums
            wrapped = own_marked > 0 and own_marked == left_marked
            if foreign and not wrapped:
                node.drop = own < total or not own
            elif headings and own_headings == headings and node.within:
                continue
            else:
                node.drop = 2 * own <= total or own <= 4 * (left_marked - own_marked)
            if node.drop:
                left_marked -= own_marked
                gone.update(id(x) for x in _in_order(node))
        before = blocks
        nodes, blocks = _sums(root)
        if before and not blocks:  # nothing but elements in doubt
            for node in doubted:
                node.drop = False
            nodes, blocks = _sums(root)
    return blocks


def _containers(owner: Node) -> list[Node]:
    """The containers that a block's points go to: its parent and grandparent, or itself if it is a container."""
    first = owner if owner.tag in ("div", "article", "section", "main", "body", "td", "html", "blockquote") else owner.parent or owner
    return [first, *([first.parent] if first.parent is not None else [])]


def extract(page: str | None) -> str:
    """The main text of a page: its blocks, one a line."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    blocks = settle(root)
    if not blocks:
        return ""
    scored: dict[int, Node] = {}
    for owner, text, linked in blocks:
        heading = owner.tag in HEADINGS
        points = 0.25 if heading else 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        for share, node in zip((1.0, 0.5), _containers(owner), strict=False):
            if id(node) not in scored:
                scored[id(node)] = node
                node.score = 25.0 if node.tag in ("article", "main") else 10.0 if node.main else 0.0
            node.score += share * points
        owner.size += len(text)
        owner.linked += linked
    nodes = _in_order(root)
    for node in reversed(nodes[1:]):
        node.parent.size += node.size
        node.parent.linked += node.linked
    value = {k: node.score * (1 - min(1.0, node.linked / max(1, node.size))) for k, node in scored.items()}
    best = scored[max(value, key=lambda k: value[k])]
    # An article in parts: the container that holds several good ones is better than any of them.
    parent = best.parent
    while parent is not None and parent.tag not in ("body", "html"):
        good = sum(1 for c in parent.children if isinstance(c, Node) and value.get(id(c), 0) >= 0.5 * value[id(best)])
        if good < 2 and not parent.main:
            break
        best, value[id(parent)] = parent, max(value.get(id(parent), 0.0), value[id(best)])
        parent = best.parent
    keep, least = {id(best)}, max(10.0, 0.2 * value[id(best)])
    for sibling in best.parent.children if best.parent is not None else []:
        if isinstance(sibling, Node) and sibling is not best and not sibling.drop and sibling.size:
            density = sibling.linked / sibling.size
            prose = sibling.tag == "p" and density < 0.25 and (sibling.size > 80 or density == 0)
            if value.get(id(sibling), 0.0) >= least or prose:
                keep.add(id(sibling))
    for node in nodes:
        if node.parent is not None and id(node.parent) in keep:
            keep.add(id(node))
    return "\n".join(text for owner, text, _ in blocks if id(owner) in keep)


def html_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages' other columns, text and n_chars (code points)."""
    others = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    rows = pages.select(packed_row(pages, others), F.col(html_col).alias("html"))
    out = batched(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select("row.*", "text").withColumn("n_chars", F.char_length("text").cast("bigint"))
