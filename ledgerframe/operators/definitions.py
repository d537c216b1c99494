"""Canonical text of object definitions, and its assembly into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.functions import text as T
from ledgerframe.operators.catalog import EXCLUDED_SEQUENCES, artifact_path, index_sort_columns
from ledgerframe.operators.skew import MAX_DOCUMENT_CHARS, PART_ROWS, ordered_text, union_all
from ledgerframe.session import materialize

# Order of the parts of a table definition.
KIND_ORDER = ("base", "indexes", "comments", "sequences", "triggers")
CRLF = "\r\n"

# Characters of a document that have a digest of their own.
STRETCH = 1 << 20


# Every sort column a fragment of a table definition may need.
PLACE_FIELDS = {
    "rank": "int",
    "plain": "int",
    "lead": "string",
    "unnumbered": "boolean",
    "number": "decimal(38,0)",
    "digit_count": "int",
    "digits": "string",
    "label": "string",
}


def _place(**given: Column) -> Column:
    return F.struct(*[given.get(f, F.lit(None)).cast(t).alias(f) for f, t in PLACE_FIELDS.items()])


def _comment_place() -> Column:
    """Place of a comment fragment: table before columns, columns by number-aware name."""
    parts = T.number_aware_parts(F.col("column_name"))
    return _place(
        rank=F.col("rank"),
        lead=parts["letters"],
        digit_count=parts["digit_count"],
        digits=parts["digits"],
        label=F.col("column_name"),
    )


def _with(corpus: DataFrame, rule, *args) -> DataFrame:
    return corpus.withColumn("ddl", rule(F.col("ddl"), *args))


def strip_schema(corpus: DataFrame, owner: str) -> DataFrame:
    return _with(corpus, T.strip_schema, owner)


def strip_editionable(corpus: DataFrame) -> DataFrame:
    return _with(corpus, T.strip_editionable)


def unquote_identifiers(corpus: DataFrame) -> DataFrame:
    return _with(corpus, T.unquote_identifiers)


def sort_constraints(corpus: DataFrame) -> DataFrame:
    return _with(corpus, T.sort_constraints)


def canonical_package(corpus: DataFrame, owner: str) -> DataFrame:
    return _with(corpus, T.canonical_package, owner)


def canonical_table(corpus: DataFrame, owner: str) -> DataFrame:
    return _with(corpus, T.canonical_table, owner)


def canonical_view(corpus: DataFrame, owner: str) -> DataFrame:
    return _with(corpus, T.canonical_view, owner)


canonical_type = canonical_package


def canonical(corpus: DataFrame, owner: str, styled: bool = True) -> DataFrame:
    """Each definition by the rule of its own type, ready to be stored."""
    kind, ddl = F.col("object_type"), F.col("ddl")
    rule = (
        F.when(kind == "TABLE", T.canonical_table(ddl, owner))
        .when(kind == "VIEW", T.canonical_view(ddl, owner))
        .otherwise(T.canonical_package(ddl, owner))
    )
    return corpus.withColumn("ddl", T.code_style(rule) if styled else rule)


def number_aware_order(frame: DataFrame, column: str) -> DataFrame:
    """Add the sort columns under which FK2 comes before FK10."""
    return frame.withColumns(T.number_aware_parts(F.col(column)))


def _opening_breaks(frame: DataFrame, key: str) -> DataFrame:
    """One fragment per key, to be sorted before all others."""
    return frame.select(key).distinct().withColumns({"text": F.lit(CRLF), "chars": F.lit(2)})


def table_comment_fragments(tab_comments: DataFrame, col_comments: DataFrame, one_line: bool = True) -> DataFrame:
    """(table_name, rank, column_name, text, chars): a break, the table comment, the columns.

    Comments of columns lose their line ends if they are to be on one line, as those of
    tables are; comments of tables and of views keep theirs.
    """
    table, column, comment = F.col("table_name"), F.col("column_name"), F.col("comments")
    chars = (F.length(comment) + 2 * F.length(table) + 40).alias("chars")
    tabs = tab_comments.where(comment.isNotNull()).select(
        "table_name",
        chars,
        F.lit(1).alias("rank"),
        F.lit("").alias("column_name"),
        F.concat(F.lit(CRLF), T.comment_statement(table, None, comment)).alias("text"),
    )
    cols = col_comments.where(comment.isNotNull()).select(
        "table_name",
        chars,
        F.lit(2).alias("rank"),
        "column_name",
        F.concat(F.lit(CRLF), T.comment_statement(table, column, comment, one_line)).alias("text"),
    )
    both = tabs.unionByName(cols)
    opening = _opening_breaks(both, "table_name").withColumns(
        {"rank": F.lit(0), "column_name": F.lit("")}
    )
    return both.unionByName(opening)


def table_comment_text(
    tab_comments: DataFrame,
    col_comments: DataFrame,
    max_chars: int = MAX_DOCUMENT_CHARS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Comment statements of each table, its own first, then by number-aware column."""
    fragments = table_comment_fragments(tab_comments, col_comments)
    order = [F.col("rank"), T.number_aware_key(F.col("column_name"))]
    return ordered_text(fragments, ["table_name"], order, "text", max_chars, part_rows, chars="chars")


def index_fragments(indexes: DataFrame, owner: str) -> DataFrame:
    """(table_name, sort columns, text) of hand-made indexes, plus the opening break."""
    own = indexes.where((F.col("generated") == "N") & ~F.col("index_name").like("PK_%"))
    statement = T.index_statement(F.col("ddl"), F.col("compression"), F.col("prefix_length"), owner)
    parts = index_sort_columns()
    rows = own.select(
        "table_name",
        F.length("ddl").alias("chars"),
        F.lit(1).alias("rank"),
        # UNIQUE sorts before NONUNIQUE, so the descending order is a rank.
        F.when(F.col("uniqueness") == "UNIQUE", 0).otherwise(1).alias("plain"),
        parts["lead"].alias("lead"),
        parts["number"].isNull().alias("unnumbered"),
        parts["number"].alias("number"),
        "index_name",
        F.concat(F.lit(CRLF), statement).alias("text"),
    )
    opening = _opening_breaks(rows, "table_name").withColumn("rank", F.lit(0))
    return rows.unionByName(opening, allowMissingColumns=True)


def index_text(
    indexes: DataFrame,
    owner: str,
    max_chars: int = MAX_DOCUMENT_CHARS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Index statements of each table in catalogue order."""
    order = [F.col(c) for c in ("rank", "plain", "lead", "unnumbered", "number", "index_name")]
    fragments = index_fragments(indexes, owner)
    return ordered_text(fragments, ["table_name"], order, "text", max_chars, part_rows, chars="chars")


def sequence_text(
    sequences: DataFrame, owner: str, excluded: tuple[str, ...] = EXCLUDED_SEQUENCES
) -> DataFrame:
    ddl = F.col("ddl")
    kept = sequences
    for name in excluded:
        kept = kept.where(~ddl.contains(name))
    return kept.select("sequence_name", T.sequence_statement(ddl, owner).alias("text"))


def trigger_text(triggers: DataFrame, owner: str) -> DataFrame:
    statement = T.trigger_statement(F.col("ddl"), owner)
    return triggers.select("table_name", "trigger_name", statement.alias("text"))


def assemble_documents(
    fragments: DataFrame,
    kind_order: tuple[str, ...] = KIND_ORDER,
    key: str = "parent_id",
    max_chars: int = MAX_DOCUMENT_CHARS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """One text per object: its fragments by kind, then by position within the kind.

    Kinds outside ``kind_order`` follow the listed ones.
    """
    kinds = F.array(*[F.lit(k) for k in kind_order])
    position = F.array_position(kinds, F.col("kind"))
    rank = F.when(position == 0, F.lit(len(kind_order) + 1)).otherwise(position)
    return ordered_text(fragments, [key], [rank, F.col("kind"), F.col("ord")], "text", max_chars, part_rows)


def styled_parts(cut: DataFrame, keys: list[str]) -> DataFrame:
    """``code_style`` of documents in parts (keys, part, text), as if each were one text.

    A part changes what is open: a literal, a line comment or a block comment. For each of these,
    and for none, it tells what is open at its end. These maps, four short strings a part, are
    put together along the document, and every part then knows where it begins and ends. Parts
    after the first begin on a new line, as fragments do, so no word lies across a border.
    """
    cut = materialize(cut.withColumn("text", T.strip_editionable(F.col("text"))), "parts")
    later = Window.partitionBy(*keys).orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    ends = {"quote": F.col("text").contains("'"), "close": F.col("text").contains("*/")}
    facts = cut.select(*keys, "part", *[c.alias(n) for n, c in ends.items()])
    facts = facts.select(*keys, "part", *[F.coalesce(F.max(n).over(later), F.lit(False)).alias(n) for n in ends])
    # one slim row per part: a document has its size / ``max_chars`` of them
    maps = cut.join(facts, [*keys, "part"]).select(
        *keys,
        "part",
        F.create_map(*[x for s in T.QUOTING for x in (F.lit(s), T.open_quoting(F.col("text"), s, F.col("quote"), F.col("close")))]).alias("to"),
    )
    along = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", F.map_entries("to").alias("to")))).alias("along"))

    def onward(path: Column, step: Column) -> Column:
        before = path["at"]
        after = F.element_at(F.map_from_entries(step["to"]), before)
        here = F.struct(step["part"].alias("part"), before.alias("before"), after.alias("after"))
        return F.struct(after.alias("at"), F.concat(path["seen"], F.array(here)).alias("seen"))

    none = F.array().cast("array<struct<part: bigint, before: string, after: string>>")
    walked = F.aggregate("along", F.struct(F.lit("").alias("at"), none.alias("seen")), onward)
    places = along.select(*keys, F.inline(walked["seen"]))
    styled = T.unquote_inside(F.col("text"), F.col("before"), F.col("after"))
    return cut.join(places, [*keys, "part"]).select(*keys, "part", styled.alias("text"))


def table_documents(
    tables: DataFrame,
    indexes: DataFrame,
    tab_comments: DataFrame,
    col_comments: DataFrame,
    sequences: DataFrame,
    triggers: DataFrame,
    owner: str,
    max_chars: int = MAX_DOCUMENT_CHARS,
    part_rows: int = PART_ROWS,
    excluded_sequences: tuple[str, ...] = EXCLUDED_SEQUENCES,
) -> DataFrame:
    """Whole table definitions: base, indexes, comments, sequences, triggers.

    Inputs carry ``ddl`` text per object; ``sequences`` and ``triggers`` name their
    table. All kinds meet in one shuffle on the table name.
    """
    table, text = F.col("table_name"), F.col("text")

    def fragments(frame: DataFrame, key: Column, kind: str, place: Column, body: Column) -> DataFrame:
        chars = F.col("chars") if "chars" in frame.columns else F.length("ddl")
        rank = F.lit(KIND_ORDER.index(kind))
        return frame.select(
            key.alias("object_name"),
            rank.alias("kind"),
            place.alias("place"),
            body.alias("text"),
            chars.alias("chars"),
        )

    base = fragments(
        tables.where("object_type = 'TABLE'"),
        F.col("object_name"),
        "base",
        _place(),
        T.canonical_table(F.col("ddl"), owner),
    )
    index_place = _place(**{c: F.col(c) for c in ("rank", "plain", "lead", "unnumbered", "number")}, label=F.col("index_name"))
    kept = sequences
    for excluded in excluded_sequences:
        kept = kept.where(~F.col("ddl").contains(excluded))
    own = triggers.where(~F.col("trigger_name").like("Z_%"))
    trigger_place = _place(rank=F.lit(1), lead=F.lower("trigger_name"), label=F.col("trigger_name"))
    everything = union_all(
        [
            base,
            fragments(index_fragments(indexes, owner), table, "indexes", index_place, text),
            fragments(table_comment_fragments(tab_comments, col_comments), table, "comments", _comment_place(), text),
            fragments(kept, table, "sequences", _place(label=F.col("sequence_name")), T.sequence_statement(F.col("ddl"), owner)),
            fragments(_opening_breaks(own, "table_name"), table, "triggers", _place(rank=F.lit(0)), text),
            fragments(own, table, "triggers", trigger_place, T.trigger_statement(F.col("ddl"), owner)),
        ]
    )
    return ordered_text(
        everything,
        ["object_name"],
        [F.col("kind"), F.col("place")],
        max_chars=max_chars,
        part_rows=part_rows,
        opens_with=KIND_ORDER.index("base"),
        chars="chars",
        each=T.code_style,
        parts=styled_parts,
    )


def view_documents(
    views: DataFrame,
    tab_comments: DataFrame,
    col_comments: DataFrame,
    owner: str,
    max_chars: int = MAX_DOCUMENT_CHARS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Whole view definitions: the view, then its comments."""
    base = views.where("object_type = 'VIEW'").select(
        "object_name",
        F.lit(0).alias("kind"),
        _place().alias("place"),
        T.canonical_view(F.col("ddl"), owner).alias("text"),
        F.length("ddl").alias("chars"),
    )
    comments = table_comment_fragments(tab_comments, col_comments, one_line=False).select(
        F.col("table_name").alias("object_name"),
        F.lit(1).alias("kind"),
        _comment_place().alias("place"),
        "text",
        "chars",
    )
    order = [F.col("kind"), F.col("place")]
    fragments = base.unionByName(comments)
    rules = {"each": T.code_style, "parts": styled_parts}
    return ordered_text(fragments, ["object_name"], order, "text", max_chars, part_rows, opens_with=0, chars="chars", **rules)


def stored_definitions(corpus: DataFrame) -> DataFrame:
    """(path, text) of every object that has a stored file."""
    path = artifact_path(F.col("object_name"), F.col("object_type"))
    return corpus.select(path.alias("path"), F.col("ddl").alias("text")).where("path is not null")


def _digest(pieces: Column) -> Column:
    """One digest of the digests of a document's stretches, in order."""
    return F.sha1(F.array_join(pieces, ""))


def _stretches(text: Column, stretch: int, start: Column) -> Column:
    """(stretch, piece) of a text whose first character is the document's ``start``-th, from 0."""
    first = F.floor(start / stretch)
    last = F.greatest(first, F.floor((start + F.length(text) - 1) / stretch))

    def piece(number: Column) -> Column:
        low = F.greatest(number * stretch, start)
        size = (number + 1) * stretch - low
        cut = F.substring(text, (low - start + 1).cast("int"), size.cast("int"))
        return F.struct(number.alias("stretch"), cut.alias("piece"))

    return F.transform(F.sequence(first, last), piece)


def document_digests(documents: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(path, digest): equal for equal texts, whatever parts they are in; line ends count as one kind.

    Every ``stretch`` characters of a document have a digest, and those have one. Documents in
    one row are digested where they are, and only digests are moved. Those in several parts are cut
    at the same places of the document, and the pieces of a stretch are put together first.
    """
    text = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    known = documents.where("text is not null")
    part = F.col("part").cast("bigint") if "part" in documents.columns else F.lit(0).cast("bigint")
    known = known.select("path", part.alias("part"), text.alias("text"))
    hashed = F.transform(_stretches(F.col("text"), stretch, F.lit(0).cast("bigint")), lambda p: F.sha1(p["piece"]))
    if "part" not in documents.columns:
        return known.select("path", _digest(hashed).alias("digest"))

    # slim and written: the paths of which there is more than one part
    several = materialize(known.groupBy("path").agg(F.count("*").alias("parts")).where("parts > 1").select("path"), "several")
    single = known.join(several, "path", "left_anti").select("path", _digest(hashed).alias("digest"))
    cut = materialize(known.join(several, "path", "left_semi"), "parts")
    order = Window.partitionBy("path").orderBy("part")
    slim = cut.select("path", "part", F.length("text").alias("n"), F.left("text", F.lit(1)).alias("first"), F.right("text", F.lit(1)).alias("last"))
    # a line end that lies across a border
    split = ((F.col("last") == "\r") & (F.lead("first").over(order) == "\n")).cast("int")
    slim = slim.withColumn("less", F.coalesce(split, F.lit(0)))
    ahead = F.sum(F.col("n") - F.col("less")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    slim = slim.select("path", "part", "less", F.coalesce(ahead, F.lit(0)).cast("bigint").alias("start"))
    placed = cut.join(slim, ["path", "part"]).withColumn("text", F.left("text", F.length("text") - F.col("less")))
    pieces = placed.select("path", "start", F.inline(_stretches(F.col("text"), stretch, F.col("start"))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"]), "")
    digests = pieces.where("piece <> ''").groupBy("path", "stretch").agg(F.sha1(whole).alias("digest"))
    found = digests.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("stretch", "digest"))).alias("all"))
    # a document of empty parts has the digest of an empty one
    named = several.join(found, "path", "left").select("path", F.coalesce(F.transform("all", lambda p: p["digest"]), F.array(F.sha1(F.lit("").cast("binary")))).alias("all"))
    return single.unionByName(named.select("path", _digest(F.col("all")).alias("digest")))


def corpus_drift(stored: DataFrame, current: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(path, action): what to create, overwrite or delete to bring a stored corpus up to date.

    Either side has one row per path, or one per path and part; the parts need not be the same.
    """
    sides = [
        document_digests(frame, stretch).withColumnRenamed("digest", label)
        for frame, label in ((stored, "stored_hash"), (current, "current_hash"))
    ]
    action = (
        F.when(F.col("stored_hash").isNull(), "create")
        .when(F.col("current_hash").isNull(), "delete")
        .when(F.col("stored_hash") != F.col("current_hash"), "overwrite")
    )
    joined = sides[0].join(sides[1], "path", "full_outer")
    return joined.withColumn("action", action).where("action is not null").select("path", "action")
