"""Fingerprints of documents as invertible Bloom lookup sketches, in DataFrame and SQL
expressions only.

A document is the set of its paragraphs' digests; a paragraph is a line, and a longer one is cut
every ``PARAGRAPH`` characters. A sketch has a fixed number of cells in three equal parts. Every
digest is put in one cell of each part: the cell counts it and takes its digest and a check of it by
exclusive or. Sketches of two versions subtract cell by cell, and what both have vanishes. A cell
that holds one digest shows it, by its check; taken out of its three cells, it uncovers others,
and so on until no cell is left: the digests that only one version has. If cells are left, the
sketch was too small for the difference, and the pair is tried again with a larger one. How many
cells to begin with is estimated from the least digests of both.

As sketches are sums, two sketches and their difference are one aggregation of signed digests.
Cells stay partitioned by document, so a round of peeling needs no shuffle.

Defined results: a null text is empty; empty documents have empty sketches and likeness 1 with each
other. Repeated paragraphs count once. Rows with equal ids are rows of their own, next to each other
in the order. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import keyed, numbered
from ledgerframe.session import materialize

PARAGRAPH = 128
CELLS = 24
ROUNDS = 7
LEAST = 16
PART_DIGESTS = 200_000
#: Rows of a state that hold what was found so far, instead of a cell: digests that only the
#: first, and only the second version has.
FIRST, SECOND = -1, -2


def digests(text: Column, length: int = PARAGRAPH) -> Column:
    """The set of digests of a text's paragraphs."""
    paragraphs = F.regexp_extract_all(text, F.lit(f"([^\\n]{{1,{length}}})"))
    return F.array_distinct(F.transform(paragraphs, lambda p: F.xxhash64(p)))


def _check(digest: str) -> str:
    return f"xxhash64({digest}, 77)"


def _cells(digest: str, size: str, n: str) -> str:
    """The three cells of a digest, as an array of rows of a state."""
    cell = ", ".join(
        f"named_struct('cell', {j} * ({size} div 3) + pmod(xxhash64({digest}, {j}), {size} div 3), 'n', {n}, 'key', {digest}, 'chk', {_check(digest)})"
        for j in range(3)
    )
    return f"array({cell})"


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Cells as sums of their rows; empty ones are left out."""
    sums = rows.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    return sums.filter("n != 0 or key != 0 or chk != 0")


def sketch(units: DataFrame, *keys: str) -> DataFrame:
    """Cells (keys, cell, n, key, chk) from rows of keys, size, digest and sign."""
    return _summed(units.select(*keys, F.inline(F.expr(_cells("digest", "size", "cast(sign as bigint)")))), *keys)


def fingerprint(cells: Column) -> Column:
    """An array of cells as text: number, count, digests and checks, in hexadecimal."""
    one = lambda c: F.concat_ws(":", F.hex(c["cell"]), F.hex(c["n"]), F.hex(c["key"]), F.hex(c["chk"]))
    return F.array_join(F.transform(F.sort_array(cells), one), " ")


def peeled(state: DataFrame, *keys: str) -> DataFrame:
    """One round: all digests that stand alone in a cell are taken out of their cells."""
    alone = f"cell >= 0 and abs(n) = 1 and chk = {_check('key')}"
    same = "named_struct('cell', cell, 'n', n, 'key', key, 'chk', chk, 'out', false)"
    out = "named_struct('cell', cast(0 as bigint), 'n', n, 'key', key, 'chk', chk, 'out', true)"
    shown = state.select(*keys, "size", F.inline(F.expr(f"if({alone}, array({same}, {out}), array({same}))")))
    # a digest may stand alone in several of its cells; cells themselves are unique already
    once = shown.groupBy(*keys, "size", "out", "cell", F.expr("if(out, key, 0L)").alias("of")).agg(
        F.first("n").alias("n"), F.first("key").alias("key"), F.first("chk").alias("chk")
    )
    kept = "named_struct('cell', cell, 'n', n, 'key', key, 'chk', chk)"
    found = f"named_struct('cell', cast(if(n > 0, {FIRST}, {SECOND}) as bigint), 'n', 1L, 'key', 0L, 'chk', 0L)"
    rows = once.select(*keys, "size", F.inline(F.expr(f"if(out, array_append({_cells('key', 'size', '-n')}, {found}), array({kept}))")))
    return _summed(rows, *keys, "size")


def differences(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row, found: for each kind of pair, how many digests only the first and only the second
    version has, and whether cells are left.

    Pairs: row, kind, size, first and second (arrays), partitioned by row.
    """
    keys = ["row", "kind"]
    signed = F.expr("concat(transform(first, d -> named_struct('digest', d, 'sign', 1)), transform(second, d -> named_struct('digest', d, 'sign', -1)))")
    state = sketch(pairs.select(*keys, "size", F.inline(signed)), *keys, "size")
    for _ in range(rounds):
        state = peeled(state, *keys)
    told = state.groupBy(*keys).agg(
        F.sum(F.when(F.col("cell") == FIRST, F.col("n"))).alias("only_first"),
        F.max(F.col("cell") >= 0).alias("left"),
    )
    return told.groupBy("row").agg(F.collect_list(F.struct("kind", "only_first", "left")).alias("found"))


def _begin(cells: int) -> Column:
    """Cells for the difference that the ``LEAST`` least digests of ``first`` and ``second`` let expect."""
    one, two = (F.slice(F.sort_array(c), 1, LEAST) for c in ("first", "second"))
    both = F.slice(F.sort_array(F.array_union(one, two)), 1, LEAST)
    shared = F.size(F.array_intersect(both, F.array_intersect(one, two)))
    total = F.size("first") + F.size("second")
    different = total * (F.size(both) - shared) / F.greatest(F.size(both) + shared, F.lit(1))
    return (3 * F.ceil((cells + 2 * different) / 3)).cast("long")


def likeness(sets: DataFrame, cells: int = CELLS) -> DataFrame:
    """row, kind, likeness (twice the common over all digests) of pairs of digest sets.

    Sets: row, first, and others, an array of kind and second. A pair starts with ``cells`` cells
    and two more for each digest of the estimated difference; those that fail go on with twice as
    many each time. Partitions are made for ``PART_DIGESTS`` digests each.
    """
    held = F.aggregate("others", F.size("first"), lambda n, o: n + F.size("first") + F.size(o["second"]))
    parts = max(1, -(-(sets.agg(F.sum(held)).first()[0] or 0) // PART_DIGESTS))
    done, level = [], 0
    while True:
        spread = sets.repartition(parts, "row")
        pairs = spread.select("row", "first", F.inline("others")).withColumn("size", _begin(cells) * (1 << level))
        both = spread.join(differences(pairs), "row", "left").select("row", "first", "found", F.inline("others"))
        found = F.filter(F.coalesce("found", F.array()), lambda f: f["kind"] == F.col("kind"))
        told = both.withColumn("own", F.try_element_at(found, F.lit(1)))
        left = F.coalesce("own.left", F.lit(False))
        total = F.size("first") + F.size("second")
        common = F.size("first") - F.coalesce("own.only_first", F.lit(0))
        like = F.when(total == 0, 1.0).otherwise(2 * common / F.greatest(total, F.lit(1)))
        # sets are kept for the pairs that failed only
        again = F.when(left, F.struct("first", F.array(F.struct("kind", "second")).alias("others")))
        told = materialize(told.select("row", "kind", left.alias("left"), like.alias("likeness"), again.alias("again")), "peeled")
        done.append(told.filter("not left").select("row", "kind", "likeness"))
        sets = told.filter("left").select("row", "again.*")
        if sets.isEmpty():
            return reduce(DataFrame.unionByName, done)
        level, parts = level + 1, max(1, parts // 4)


def next_rows(rows: DataFrame) -> DataFrame:
    """row, next: the following row by descending doc_id; the first follows the last."""
    placed = numbered(rows.select("row", "ord"), F.desc("ord"), F.desc("row"))
    count = placed.count()
    ahead = placed.select("row", ((F.col("position") + 1) % max(1, count)).alias("position"))
    return ahead.join(placed.select("position", F.col("row").alias("next")), "position").drop("position")


def versions(rows: DataFrame, length: int = PARAGRAPH) -> DataFrame:
    """row, n_chars, edited_sha256 and the digests of every text, of its edited text and of the
    next text. Edited: the last third is replaced by the start of the next text.

    Written once. Texts are shuffled by row, once for both joins, and starts of texts to the row
    in front of them.
    """
    text = rows.select("row", "text")
    sized = rows.select("row", F.length("text").alias("n"))
    ahead = next_rows(rows).join(sized, "row").select(F.col("row").alias("before"), F.col("next"), F.floor(F.col("n") / 3).cast("int").alias("third"))
    heads = text.join(ahead, text["row"] == ahead["next"])
    heads = heads.select(F.col("before").alias("of"), F.expr("left(text, third)").alias("head"), digests(F.col("text"), length).alias("following"))
    both = text.join(heads, text["row"] == heads["of"])
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))"), "head")
    both = both.select("row", "text", "following", F.inline(F.array(F.struct(edited.alias("edited")))))
    told = both.select(
        "row",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digests(F.col("text"), length).alias("own"),
        digests(F.col("edited"), length).alias("changed"),
        "following",
    )
    return materialize(told, "versions")


def fingerprints(docs: DataFrame, cells: int = CELLS, length: int = PARAGRAPH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = keyed(docs)
    told = versions(rows, length)
    others = F.expr("array(named_struct('kind', 0, 'second', changed), named_struct('kind', 1, 'second', following))")
    near = likeness(told.select("row", F.col("own").alias("first"), others.alias("others")), cells)
    near = near.groupBy("row").agg(
        F.max(F.when(F.col("kind") == 0, F.col("likeness"))).alias("near_edited"),
        F.max(F.when(F.col("kind") == 1, F.col("likeness"))).alias("near_next"),
    )
    version = F.inline(F.expr("array(named_struct('version', 0, 'digests', own), named_struct('version', 1, 'digests', changed))"))
    units = told.select("row", "own", "changed").repartition("row").select("row", version)
    units = units.select("row", "version", F.lit(cells).cast("long").alias("size"), F.lit(1).alias("sign"), F.explode("digests").alias("digest"))
    marked = sketch(units, "row", "version").groupBy("row").agg(F.collect_list(F.struct("version", "cell", "n", "key", "chk")).alias("cells"))
    prints = marked.select(
        "row",
        fingerprint(F.filter("cells", lambda c: c["version"] == 0)).alias("fingerprint"),
        fingerprint(F.filter("cells", lambda c: c["version"] == 1)).alias("edited_fingerprint"),
    )
    slim = told.select("row", "n_chars", "edited_sha256").join(rows.select("row", "doc_id"), "row")
    both = slim.join(near, "row").join(prints, "row", "left")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
