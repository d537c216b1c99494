"""Block trees of HTML pages, and their alignment by simple tree matching.

``parsed`` reads a page into a tree of block elements; inline elements are part of the text of
their block. ``folded`` turns it into a tree of slots, in which a run of siblings with one label
(paragraphs, list items, rows) is a single slot. ``merge`` aligns two trees of slots: children
are paired in order so that the number of equal nodes below is largest. A merged slot keeps how many
pages have it, how much text and link text, and its commonest texts.
"""

from __future__ import annotations

import functools
import html
import json
import re
import sys
import zlib
from collections.abc import Callable

# recursion goes as deep as a page nests; Python frames live on the heap
DEPTH = 1_000_000

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
# an element of the first kind ends an open one of the second, within the third
ENDS_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = {"table", "td", "th", "caption", "button", "object", "template"}
REPEATED = set("p li dt dd tr td th h2 h3 h4 h5 h6 blockquote pre figure hr".split())

# What pages hold besides their article, by element, role, and words of class and id.
SIDE_TAGS = set(
    "nav footer aside form button select option textarea input label fieldset dialog menu script style noscript template svg math"
    " canvas iframe object embed head title audio video".split()
)
SIDE_ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
SIDE_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement"
    " advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal newsletter"
    " subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond"
    " reply replies pagination pager widget toolbar copyright alert toast overlay".split()
)
MAIN_WORDS = set("article content entry post story main".split())
#: What names add behind the word that counts, and before a part that is only referred to.
BEHIND = set(
    "left right top bottom inner outer wrap wrapper container block box section area list item items link links button buttons bar"
    " slot unit group panel column col row text form".split()
)
BEFORE = set("has with no without is".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Node:
    """A block element: items are texts and nodes in page order."""

    __slots__ = ("tag", "label", "side", "main", "items", "links", "slot")

    def __init__(self, tag: str, label: str, side: bool, main: bool):
        self.tag, self.label, self.side, self.main = tag, label, side, main
        self.items: list = []
        self.links = 0
        self.slot = None


def key_word(name: str) -> tuple[str, list[str]]:
    """The word of a class or id that says what it is, and all its words."""
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]
    if words and words[0] in BEFORE:
        return "", words
    short = list(words)
    while len(short) > 1 and short[-1] in BEHIND:
        short.pop()
    return short[-1] if short else "", words


@functools.lru_cache(maxsize=1 << 14)
def looks(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """label; whether it is a side part, the main part, a header (a side part unless inside of the main part)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)} if attrs else {}
    named = [key_word(name) for name in f"{found.get('class', '')} {found.get('id', '')}".split()]
    keys, words = {k for k, _ in named}, {w for _, all_words in named for w in all_words}
    role = found.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(found.get("style", "")))
    by_name = not SIDE_WORDS.isdisjoint(keys) and MAIN_WORDS.isdisjoint(keys)
    side = tag not in ("html", "body") and (tag in SIDE_TAGS or role in SIDE_ROLES or hidden or by_name)
    header = tag == "header" or "header" in keys and MAIN_WORDS.isdisjoint(words - {"main"}) and tag not in INLINE
    return ".".join([tag, *sorted(words)]), side, main and not side, header and tag not in ("html", "body")


def parsed(text: str) -> Node:
    """The page's block tree. Missing and crossed end tags are mended as browsers do."""
    root = Node("#page", "#page", False, False)
    blocks = [root]
    stack: list[tuple[str, Node | None]] = []  # open elements, and the node of those that are blocks
    open_tags: dict[str, int] = {}
    # beyond the last '>' there is no tag
    at, stop = 0, text.rfind(">") + 1

    def close(keep: int) -> None:
        while len(stack) > keep:
            tag, node = stack.pop()
            open_tags[tag] -= 1
            if node is not None:
                blocks.pop()

    def nearest(tags, bounds) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in bounds:
                return None
        return None

    def add(piece: str) -> None:
        block = blocks[-1]
        if "&" in piece:
            piece = html.unescape(piece)
        block.items.append(piece)
        if open_tags.get("a"):
            block.links += len(piece)

    while at < stop:
        found = TAG.search(text, at, stop)
        if not found:
            break
        if found.start() > at:
            add(text[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            if open_tags.get(tag):
                i = nearest({tag}, ())
                # an inline end tag doesn't end blocks that began inside
                if tag not in INLINE or all(node is None for _, node in stack[i + 1 :]):
                    close(i)
            continue
        if tag in ENDS_PARAGRAPH and open_tags.get("p"):
            i = nearest({"p"}, SCOPE)
            if i is not None:
                close(i)
        if tag in ENDS_SIBLING:
            kinds, bounds = ENDS_SIBLING[tag]
            if any(open_tags.get(kind) for kind in kinds):
                i = nearest(kinds, bounds)
                if i is not None:
                    close(i)
        label, side, main, header = looks(tag, found["attrs"] if tag != "a" else "")
        if header and not side:
            side = not any(b.main for b in blocks)
        node = None
        if tag == "br":
            blocks[-1].items.append(" ")
        elif tag not in INLINE or side:
            node = Node(tag, label, side, main)
            blocks[-1].items.append(node)
        if tag in RAW:
            ended = RAW_END[tag].search(text, at)
            at = ended.start() if ended else len(text)
            stop = max(stop, at)
            continue
        if tag in VOID or found["attrs"].endswith("/") and tag in ("svg", "path"):
            continue
        stack.append((tag, node))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if node is not None:
            blocks.append(node)
    if at < len(text):
        add(text[at:])
    settle(root)
    return root


def settle(root: Node) -> None:
    """A side part that holds the main part, or a form that holds most of the text, is none."""
    order, sizes, mains = [root], {}, {}
    for node in order:
        order.extend(i for i in node.items if isinstance(i, Node))
    for node in reversed(order):
        inner = [i for i in node.items if isinstance(i, Node)]
        sizes[id(node)] = sum(len(i) for i in node.items if isinstance(i, str)) + sum(sizes[id(i)] for i in inner)
        mains[id(node)] = node.main or any(mains[id(i)] for i in inner)
    for node in order:
        if node.side and (mains[id(node)] or node.tag == "form" and 2 * sizes[id(node)] > sizes[id(root)]):
            node.side = False


class Slot:
    """A place in the outline of one page, or of all pages of a host."""

    __slots__ = ("label", "tag", "side", "main", "pages", "chars", "links", "texts", "kids", "nodes", "match")
    KEPT = 4

    def __init__(self, label: str, side: bool, main: bool, pages: int, chars: int, links: int, texts: dict[int, int]):
        self.label, self.tag, self.side, self.main = label, label.split(".", 1)[0], side, main
        self.pages, self.chars, self.links, self.texts = pages, chars, links, texts
        self.kids: list[Slot] = []
        self.nodes: list[Node] = []
        self.match: Slot | None = None

    def constant(self, least_pages: int = 5, share: float = 0.85) -> bool:
        """Whether nearly all pages that have the slot have one text there."""
        return self.chars > 0 and self.pages >= least_pages and max(self.texts.values(), default=0) >= share * self.pages


def folded(root: Node) -> Slot:
    """The page as slots; parts beside the article are slots without inside."""
    own = "".join(i for i in root.items if isinstance(i, str)).strip() if not root.side else ""
    slot = Slot(root.label, root.side, root.main, 1, len(own), min(root.links, len(own)), {zlib.crc32(own.encode("utf-8", "replace")): 1} if own else {})
    slot.nodes.append(root)
    root.slot = slot
    if root.side:
        return slot
    for item in root.items:
        if not isinstance(item, Node):
            continue
        kid = folded(item)
        last = slot.kids[-1] if slot.kids else None
        if last is not None and last.label == kid.label and last.side == kid.side and last.tag in REPEATED:
            fold(last, kid)
        else:
            slot.kids.append(kid)
    return slot


def fold(into: Slot, other: Slot) -> None:
    """Makes two slots of one page a single one, whose text is that of both."""
    into.chars += other.chars
    into.links += other.links
    into.texts = {zlib.crc32(repr((*into.texts, *other.texts)).encode()): 1} if into.texts or other.texts else {}
    joined(into, other, fold)


def matching(a: Slot, b: Slot) -> int:
    """The largest number of equal nodes that two trees share in order: simple tree matching."""
    if a.label != b.label or a.side != b.side:
        return 0
    if same_outline(a.kids, b.kids):
        return 1 + sum([matching(x, y) for x, y in zip(a.kids, b.kids, strict=True)])
    return 1 + sum([w for _, _, w in pairs(a.kids, b.kids)])


def same_outline(left: list[Slot], right: list[Slot]) -> bool:
    """Whether the children can be paired in one best way, place by place."""
    kinds = [(s.label, s.side) for s in left]
    return kinds == [(s.label, s.side) for s in right] and len(set(kinds)) == len(kinds)


def pairs(left: list[Slot], right: list[Slot]) -> list[tuple[int, int, int]]:
    """(place, place, weight) of the children that are paired; 0 where the weight wasn't needed."""
    if same_outline(left, right):
        return [(i, i, 0) for i in range(len(left))]
    weights = [[matching(a, b) for b in right] for a in left]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            w = weights[i][j]
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + w if w else 0)
    found, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        w = weights[i][j]
        if w and best[i][j] == best[i + 1][j + 1] + w:
            found.append((i, j, w))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return found


def merge(into: Slot, other: Slot) -> None:
    """Aligns ``other`` with ``into`` and adds it there; its unmatched nodes become optional ones."""
    into.pages += other.pages
    into.chars += other.chars
    into.links += other.links
    for digest, count in other.texts.items():
        into.texts[digest] = into.texts.get(digest, 0) + count
    if len(into.texts) > Slot.KEPT:
        # a text on most pages outlasts the others, whatever the order of merging
        less = sorted(into.texts.values(), reverse=True)[Slot.KEPT]
        into.texts = {d: c - less for d, c in into.texts.items() if c > less}
    joined(into, other, merge)


def joined(into: Slot, other: Slot, how) -> None:
    """Takes over the other's nodes and children; paired children become one by ``how``."""
    into.main = into.main or other.main
    into.nodes += other.nodes
    for node in other.nodes:
        node.slot = into
    found = pairs(into.kids, other.kids)
    kids, i, j = [], 0, 0
    for a, b, _ in [*found, (len(into.kids), len(other.kids), 0)]:
        kids += into.kids[i:a] + other.kids[j:b]
        if a < len(into.kids):
            how(into.kids[a], other.kids[b])
            kids.append(into.kids[a])
        i, j = a + 1, b + 1
    into.kids = kids


def aligned(page: Slot, wrapper: Slot) -> None:
    """Sets ``match`` of the page's slots to the wrapper's slots."""
    page.match = wrapper
    for i, j, _ in pairs(page.kids, wrapper.kids):
        aligned(page.kids[i], wrapper.kids[j])


def in_order(root: Slot) -> list[Slot]:
    """The slots of a tree from the top, left to right."""
    found, ahead = [], [root]
    while ahead:
        slot = ahead.pop()
        found.append(slot)
        ahead += reversed(slot.kids)
    return found


def sums(slots: list[Slot], own: Callable[[Slot], int]) -> dict[int, int]:
    """``own`` added up over each subtree, by identity; a side part and what it holds give 0."""
    total: dict[int, int] = {}
    for slot in reversed(slots):
        total[id(slot)] = 0 if slot.side else own(slot) + sum([total[id(k)] for k in slot.kids])
    return total


def dumped(slot: Slot) -> str:
    """Slots in page order with their depth."""
    rows: list = []

    def visit(s: Slot, depth: int) -> None:
        rows.append([depth, s.label, int(s.side), int(s.main), s.pages, s.chars, s.links, list(s.texts.items())])
        for kid in s.kids:
            visit(kid, depth + 1)

    visit(slot, 0)
    return json.dumps(rows, separators=(",", ":"))


def loaded(text: str) -> Slot:
    path: list[Slot] = []
    for depth, label, side, main, pages, chars, links, texts in json.loads(text):
        slot = Slot(label, bool(side), bool(main), pages, chars, links, dict(texts))
        del path[depth:]
        if path:
            path[-1].kids.append(slot)
        path.append(slot)
    return path[0]


def deep() -> None:
    sys.setrecursionlimit(DEPTH)
