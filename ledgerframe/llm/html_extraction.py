"""Main text of pages by wrappers that are induced from the pages of a host.

Pages of one host are aligned by simple tree matching (``page_tree``) and merged to one outline of
slots. A slot with one text on nearly all pages is template; slots whose text varies are content.
The content region of a host is its article or main element where it has one; else it is found from
the top, by going on to the child that holds most of the varying text that is not links, as long as
no varying title is left behind. A page is then aligned with its host's wrapper, and the text of the region is taken, less template slots and
side parts (menus, headers, footers, sidebars, notices, adverts, forms, comments) that element,
role or name give away. A page without that region, or of a host of which too few pages are there
to compare, is judged by itself.

Spark does the merging: tasks merge the pages they have per host, then a host's outlines are merged
in groups, and the groups' outlines. So no task sees all pages of a host, and what is shuffled is
outlines, not pages. No slot is ever dropped, so an outline is as large as the pages of its host differ in
their blocks, and rare parts count alike however many others there are. Wrappers are joined to the pages by host.

Defined results: null or empty html gives an empty text. Pages without a host (null url, no
``://``) are judged by themselves. Repeated rows and ids are returned as often as they are there,
and are no reason to call an article template: where what is constant holds most of a region, the
pages are copies of one article and nothing is taken away. Ties between children go to the first.
Very long or deep pages are read whole. An empty table gives an empty result. Columns other than
page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm import page_tree
from ledgerframe.llm.common import column_of
from ledgerframe.llm.page_tree import Node, Slot
from ledgerframe.llm.url_filter import host_of
from ledgerframe.session import materialize

#: Outlines of a host are first merged in so many groups.
GROUPS = 64
#: Slots that a task holds for all its hosts before it hands them on.
HELD_SLOTS = 200_000
#: Share of the varying text that a child must hold to be gone on to.
MOST = 0.75


def outline(page: str) -> Slot:
    return page_tree.folded(page_tree.parsed(page))


def partial_outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One outline per host of the pages of a task; more if it has very many hosts."""
    page_tree.deep()
    held: dict[str, Slot] = {}
    slots = 0

    def handed() -> pa.RecordBatch:
        rows = list(held), [page_tree.dumped(s) for s in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(r, pa.string()) for r in rows], ["host", "outline"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = outline(page.as_py())
            slots += len(page_tree.in_order(found))
            if host in held:
                page_tree.merge(held[host], found)
            else:
                held[host] = found
            forget(held[host])
            if slots > HELD_SLOTS:
                slots = sum(len(page_tree.in_order(s)) for s in held.values())
                if slots > HELD_SLOTS // 2:
                    yield handed()
                    held.clear()
                    slots = 0
    if held:
        yield handed()


def forget(root: Slot) -> None:
    """Lets go of the pages' own nodes."""
    for slot in page_tree.in_order(root):
        slot.nodes = []


def merged(keys: list[str], finish):
    """A grouped function that merges outlines and gives ``finish`` of the outcome."""

    def grouped(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page_tree.deep()
        whole = None
        for batch in batches:
            for text in batch.column(batch.schema.get_field_index("outline")):
                found = page_tree.loaded(text.as_py())
                if whole is None:
                    whole = found
                else:
                    page_tree.merge(whole, found)
        values = [pa.array([k.as_py()], k.type) for k in key]
        yield pa.RecordBatch.from_arrays([*values, pa.array([finish(whole)], pa.string())], [*keys, "outline"])

    return grouped


def varying(slot: Slot) -> int:
    """Text of a slot that is neither constant nor links."""
    return 0 if slot.constant() else slot.chars - slot.links


def marked(slot: Slot) -> list[Slot]:
    """The outermost slots marked as main; articles rather than a main element around them."""
    if slot.side:
        return []
    inner = [m for k in slot.kids for m in marked(k)]
    if not slot.main:
        return inner
    articles = [m for m in inner if m.tag == "article"]
    return articles if slot.tag != "article" and articles else [slot]


def regions(root: Slot) -> list[Slot]:
    """The slots that hold the content."""
    slots = page_tree.in_order(root)
    chars = page_tree.sums(slots, lambda s: s.chars)
    found = [s for s in marked(root) if chars[id(s)]]
    if found and 2 * max(s.pages for s in found) >= root.pages:
        return found
    # few pages mark their article: the others' region is found, and theirs stays one
    return [*found, *unmarked_region(root, slots)]


def unmarked_region(root: Slot, slots: list[Slot]) -> list[Slot]:
    """The slot that is reached from the top by going on to where the varying text is."""
    worth = page_tree.sums(slots, varying)
    titles = page_tree.sums(slots, lambda s: int(s.tag == "h1" and varying(s) > 0))
    slot = root
    while True:
        best = max(slot.kids, key=lambda k: worth[id(k)], default=None)
        if best is None or not worth[id(best)] or worth[id(best)] < MOST * worth[id(slot)] or best.tag in page_tree.REPEATED:
            return [slot]
        if titles[id(best)] < titles[id(slot)]:
            return [slot]  # a title belongs to the text
        slot = best


def wrapper(root: Slot) -> str:
    """The outline as extraction needs it: depth, label, side, region, template."""
    found = regions(root)
    # pages that are copies of one article leave nothing that varies
    slots = page_tree.in_order(root)
    chars = page_tree.sums(slots, lambda s: s.chars)
    fixed = page_tree.sums(slots, lambda s: s.chars if s.constant() else 0)
    copies = {id(s) for s in found if 2 * fixed[id(s)] > chars[id(s)]}
    rows: list = []

    def visit(slot: Slot, depth: int, region: bool, copy: bool) -> None:
        copy = copy or id(slot) in copies
        here = any(slot is s for s in found)
        rows.append([depth, slot.label, int(slot.side), int(here and not region), int((region or here) and not copy and slot.constant())])
        for kid in slot.kids:
            visit(kid, depth + 1, region or here, copy)

    visit(root, 0, False, False)
    return json.dumps(rows, separators=(",", ":"))


def unwrapped(text: str) -> Slot:
    """A wrapper's slots: ``main`` marks regions, ``pages`` 0 marks template."""
    path: list[Slot] = []
    for depth, label, side, region, template in json.loads(text):
        slot = Slot(label, bool(side), bool(region), 0 if template else 1, 0, 0, {})
        del path[depth:]
        if path:
            path[-1].kids.append(slot)
        path.append(slot)
    return path[0]


def text_of(nodes: list[Node]) -> str:
    """The nodes' text without side parts and template slots."""
    pieces: list[str] = []

    def visit(node: Node) -> None:
        if node.tag in page_tree.RAW:
            return  # unseen, so it doesn't part words
        pieces.append(" ")
        if node.side:
            return
        match = node.slot.match
        own = match is None or match.pages > 0
        for item in node.items:
            if isinstance(item, Node):
                visit(item)
            elif own:
                pieces.append(item)
        pieces.append(" ")

    for node in nodes:
        visit(node)
    return " ".join("".join(pieces).split())


def extracted(page: str, wrapped: Slot | None) -> str:
    """The main text of a page by its host's wrapper, else by itself."""
    own = outline(page)
    if wrapped is not None:
        page_tree.aligned(own, wrapped)
        found = text_of([n for s in page_tree.in_order(own) if s.match is not None and s.match.main for n in s.nodes])
        if found:
            return found
    return text_of([n for s in regions(own) for n in s.nodes])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, outline: the wrapper of every host, from all its pages."""
    slim = pages.select(host_of(F.col("url")).alias("host"), "html").filter("host <> '' AND html <> ''")
    partial = slim.mapInArrow(partial_outlines, "host string, outline string")
    dealt = partial.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    some = dealt.groupBy("host", "part").applyInArrow(
        merged(["host", "part"], page_tree.dumped), "host string, part int, outline string"
    )
    return some.groupBy("host").applyInArrow(merged(["host"], wrapper), "host string, outline string")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    induced = materialize(wrappers(pages), "wrappers")
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    # Spark knows the size of what was written, and broadcasts it or splits hot hosts accordingly
    joined = slim.join(induced, "host", "left").select("page_id", "url", "html", "outline")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page_tree.deep()
        known: dict[str, Slot] = {}
        for batch in batches:
            found = []
            for page, outline_text in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if outline_text is not None and outline_text not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[outline_text] = unwrapped(outline_text)
                found.append(extracted(page.as_py(), known.get(outline_text)))
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    schema = f"{column_of(pages, 'page_id')}, {column_of(pages, 'url')}, text string"
    return joined.mapInArrow(texts, schema).withColumn("n_chars", F.length("text").cast("long"))
