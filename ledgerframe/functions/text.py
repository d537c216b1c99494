"""Text rules for scripts and object definitions, as native column expressions.

Patterns avoid lookaround and repeated groups, so they run in constant stack on
texts of any length and mean the same in Java and RE2 engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each object type, the phrases that announce a change, in
# matching order. Longer phrases of an overlapping pair come first.
CHANGE_PHRASES = {
    "PACKAGE_BODY": ["create package body", "replace package body", "drop package body"],
    "PACKAGE_SPEC": ["create package", "replace package", "drop package"],
    "TABLE": ["create table", "alter table", "drop table"],
    "VIEW": [
        "create view",
        "replace view",
        "drop view",
        "create force view",
        "replace force view",
    ],
    "COMMENT": ["comment on table", "comment on column"],
    "INDEX": ["create index", "create unique index", "drop index"],
    "SEQUENCE": ["create sequence", "drop sequence"],
    "TRIGGER": ["create trigger", "replace trigger", "drop trigger", "alter trigger"],
    "TYPE_BODY": ["create type body", "replace type body", "drop type body"],
    "TYPE_SPEC": ["create type", "alter type", "replace type", "drop type"],
}


def phrase_pattern(types: list[str] | None = None) -> str:
    """Any phrase of the given types, by its first word and then by what follows it.

    Grouping by first word means five literals are tried at a position, not thirty.
    Within a word the order of the phrases is kept, so longer ones still win.
    """
    by_word: dict[str, list[str]] = {}
    for kind in types or CHANGE_PHRASES:
        for phrase in CHANGE_PHRASES[kind]:
            word, rest = phrase.split(" ", 1)
            by_word.setdefault(word, []).append(rest)
    return "(?:" + "|".join(f"{w} (?:{'|'.join(r)})" for w, r in by_word.items()) + ")"


LINE_COMMENT = r"--[^\n\r\x{85}\x{2028}\x{2029}]*\r*\n"
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
# Runs of ordinary characters are matched whole, which restarts the matcher less often.
QUOTE_OUTSIDE_TEXT = r"([^\"'/-]+|'[^']*'|--[^\n]*|/\*[\s\S]*?\*/|[-/'])|" + '"'
CONSTRAINT_START = r"(?:^|\n)\s*(?:PRIMARY KEY|CONSTRAINT)"
BEFORE_CONSTRAINTS = r"^([\s\S]*?(?:^|\n))\s*(?:PRIMARY KEY|CONSTRAINT)"
AFTER_CONSTRAINTS = r"^[\s\S]*(\n\s*\)[\s\S]*)\z"
PRIMARY_KEY_LINE = r"^\s*(?:CONSTRAINT\s+\S+\s+)?PRIMARY KEY\s"
NAMED_CONSTRAINT_LINE = r"^\s*CONSTRAINT\s+(\S+)\s"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed a single time, however often it is used.

    A costly expression that a rule mentions several times would otherwise be
    evaluated at each mention.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_script(text: Column) -> Column:
    """Drop comments and quotes, fold whitespace, lower-case."""
    t = F.regexp_replace(text, LINE_COMMENT, "")
    t = F.regexp_replace(t, BLOCK_COMMENT, "")
    t = F.regexp_replace(t, r"\n+", " ")
    t = F.regexp_replace(t, r"\s\s+", " ")
    return F.lower(F.replace(t, F.lit('"'), F.lit("")))


def object_type_of_phrase(phrase: Column) -> Column:
    """Object type announced by a matched phrase, from a literal map."""
    pairs = [F.lit(v) for t, ps in CHANGE_PHRASES.items() for p in ps for v in (p, t)]
    return F.element_at(F.create_map(*pairs), phrase)


def changed_object_array(text: Column) -> Column:
    """Array of (object_name, object_type) a raw script touches, repeats kept.

    The text is scanned once; phrase and name are then cut from the short matches.
    """
    found = F.regexp_extract_all(normalize_script(text), F.lit(phrase_pattern() + r"\s+\w+"), 0)

    def parts(match: Column) -> Column:
        name = F.regexp_extract(match, r"\w+\z", 0)
        phrase = F.regexp_replace(match, r"\s+\w+\z", "")
        return F.struct(name.alias("object_name"), object_type_of_phrase(phrase).alias("object_type"))

    return F.transform(found, parts)


def is_package_script(text: Column) -> Column:
    """True when the script changes a package spec or body; null and empty are false."""
    pattern = phrase_pattern(["PACKAGE_BODY", "PACKAGE_SPEC"]) + r"\s+\w+"
    return F.coalesce(normalize_script(text).rlike(pattern), F.lit(False))


# --- object definitions ------------------------------------------------------


# Everything up to U+0020, and the characters a pattern calls whitespace.
CONTROL = "".join(chr(c) for c in range(0x21))
WHITESPACE = " \t\n\x0b\f\r"


def trim_control(text: Column) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.btrim(text, F.lit(CONTROL))


def close_with(text: Column, mark: str, end: Column) -> Column:
    """Replace a final ``mark`` and the whitespace before it, if there is any, by ``end``."""
    stem = F.left(text, F.length(text) - len(mark))
    bare = F.rtrim(stem, F.lit(WHITESPACE))
    return F.when(text.endswith(mark) & (bare != stem), F.concat(bare, end)).otherwise(text)


def to_crlf(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\r\n"))


def strip_schema(ddl: Column, owner: str) -> Column:
    return F.replace(ddl, F.lit(f'"{owner.upper()}".'), F.lit(""))


def strip_editionable(ddl: Column) -> Column:
    plain = F.replace(ddl, F.lit("NONEDITIONABLE "), F.lit(""))
    return F.replace(plain, F.lit("EDITIONABLE "), F.lit(""))


def requoted(bare: Column) -> Column:
    """The reserved word CASE in its quotes again."""
    worded = F.regexp_replace(bare, r"\bCASE,", '"CASE",')
    worded = F.when(bare.contains("CASE,"), worded).otherwise(bare)
    return F.replace(worded, F.lit("(CASE)"), F.lit('("CASE")'))


def unquote_identifiers(ddl: Column) -> Column:
    """Drop identifier quotes outside literals and comments; keep reserved CASE quoted."""
    return once(F.regexp_replace(ddl, QUOTE_OUTSIDE_TEXT, "$1"), requoted)


# What a text can be inside of: nothing, a literal, a line comment, a block comment. Each is named
# by what opens it; the second value closes it.
QUOTING = {"": "", "'": "'", "--": "", "/*": "*/"}


def quoting_pattern(later_quote: bool, later_close: bool) -> str:
    """Reduces a text to what is still open at its end.

    A literal or block comment is one only if its end follows somewhere; ``later_quote`` and
    ``later_close`` say whether the rest of the document has such an end.
    """
    open_ends = ["--", *["'"] * later_quote, *[r"/\*"] * later_close]
    closed = r"[^'/-]+|'[^']*'|--[^\n]*\n|/\*[\s\S]*?\*/"
    return closed + "|(" + "|".join(open_ends) + r")[\s\S]*\z|[-/']"


def open_quoting(text: Column, before: str, later_quote: Column, later_close: Column) -> Column:
    """What a text leaves open that begins inside of ``before``."""
    from_there = F.concat(F.lit(before), text)

    def reduced(quote: bool, close: bool) -> Column:
        return F.regexp_replace(from_there, quoting_pattern(quote, close), "$1")

    with_quote = F.when(later_close, reduced(True, True)).otherwise(reduced(True, False))
    without = F.when(later_close, reduced(False, True)).otherwise(reduced(False, False))
    return F.when(later_quote, with_quote).otherwise(without)


def unquote_inside(ddl: Column, before: Column, after: Column) -> Column:
    """``unquote_identifiers`` of a part of a document that begins inside of ``before`` and ends inside of ``after``."""
    closing = F.element_at(F.create_map(*[F.lit(x) for pair in QUOTING.items() for x in pair]), after)
    whole = F.concat(before, ddl, closing)
    bare = F.regexp_replace(whole, QUOTE_OUTSIDE_TEXT, "$1")
    inner = F.substring(bare, F.length(before) + 1, F.length(bare) - F.length(before) - F.length(closing))
    return once(inner, requoted)


def code_style(ddl: Column) -> Column:
    """Last step before a definition is stored."""
    return unquote_identifiers(strip_editionable(ddl))


def canonical_package(ddl: Column, owner: str) -> Column:
    d = trim_control(strip_schema(ddl, owner))
    return to_crlf(close_with(d, "/", F.lit("\n/")))


canonical_type = canonical_package


def canonical_view(ddl: Column, owner: str) -> Column:
    d = trim_control(strip_schema(ddl, owner))
    return to_crlf(F.regexp_replace(d, r"\s+;", ";"))


def canonical_table(ddl: Column, owner: str) -> Column:
    d = trim_control(strip_schema(ddl, owner))
    d = F.replace(d, F.lit("\n  USING INDEX  ENABLE"), F.lit(""))
    d = F.regexp_replace(d, r"\s+;", ";")
    # Anchored lazy prefixes make these two first-match-only.
    d = F.regexp_replace(d, r"^([\s\S]*?)\n\s+\(", "$1(\n")
    d = F.regexp_replace(d, r"^([\s\S]*?)\s+\)", "$1\n)")
    d = F.replace(to_crlf(d), F.lit("\t"), F.lit("    "))
    d = F.regexp_replace(d, r"\r\n\s+REFERENCES\s", " REFERENCES ")
    return sort_constraints(d)


def number_aware_parts(name: Column) -> dict[str, Column]:
    """Columns that sort names as people do: letters first, then the number in them."""
    digits = F.ltrim(F.regexp_replace(name, r"\D+", ""), F.lit("0"))
    return {
        "letters": F.upper(F.translate(name, "0123456789", "")),
        "digit_count": F.length(digits).cast("int"),
        "digits": digits,
    }


def number_aware_key(name: Column) -> Column:
    """Total-order sort key; number width before digits compares numbers of any length."""
    parts = [c.alias(k) for k, c in number_aware_parts(name).items()]
    return F.struct(*parts, name.alias("name"))


def sort_constraints(ddl: Column) -> Column:
    """Primary key first, then named constraints by number-aware name, the rest last."""
    def sortable(line: Column, position: Column) -> Column:
        name = F.regexp_extract(line, NAMED_CONSTRAINT_LINE, 1)
        rank = F.when(line.rlike(PRIMARY_KEY_LINE), 0).when(name != "", 1).otherwise(2)
        key = F.when(rank == 1, name).otherwise(F.lit(""))
        return F.struct(
            rank.alias("rank"),
            number_aware_key(key).alias("key"),
            position.alias("position"),
            F.replace(line, F.lit("\r"), F.lit("")).alias("line"),
        )

    def ordered(block: Column) -> Column:
        lines = F.array_sort(F.transform(F.split(block, r",\s*\n"), sortable))
        return F.array_join(F.transform(lines, lambda s: s["line"]), ",\r\n")

    def from_rest(head: Column, rest: Column, whole: Column) -> Column:
        def closed(tail: Column) -> Column:
            block = F.left(rest, F.length(rest) - F.length(tail))
            return F.when(tail == "", whole).otherwise(F.concat(head, ordered(block), tail))

        return once(F.regexp_extract(rest, AFTER_CONSTRAINTS, 1), closed)

    def from_head(head: Column, whole: Column) -> Column:
        rest = F.substring(whole, F.length(head) + 1, F.length(whole))
        return once(rest, lambda r: from_rest(head, r, whole))

    def from_whole(whole: Column) -> Column:
        head = F.regexp_extract(whole, BEFORE_CONSTRAINTS, 1)
        sorted_ddl = once(head, lambda h: from_head(h, whole))
        return F.when(whole.rlike(CONSTRAINT_START), sorted_ddl).otherwise(whole)

    return once(ddl, from_whole)


def index_statement(ddl: Column, compression: Column, prefix_length: Column, owner: str) -> Column:
    end = F.when(
        compression == "ENABLED",
        F.concat(F.lit(" COMPRESS "), F.coalesce(prefix_length, F.lit(0)).cast("string"), F.lit(";")),
    ).otherwise(F.lit(";"))
    return trim_control(strip_schema(close_with(ddl, ";", end), owner))


def sequence_statement(ddl: Column, owner: str) -> Column:
    """Keep the statement up to its last quoted name."""
    d = F.concat(F.lit("\r\n\r\n"), trim_control(strip_schema(ddl, owner)))
    after_last = F.substring_index(d, '"', -1)
    cut = F.concat(F.left(d, F.length(d) - F.length(after_last)), F.lit(";"))
    return F.when(d.contains('"'), cut).otherwise(close_with(d, ";", F.lit(";")))


def trigger_statement(ddl: Column, owner: str) -> Column:
    d = F.concat(F.lit("\r\n"), to_crlf(trim_control(strip_schema(ddl, owner))))
    d = F.regexp_replace(d, r"\s+/", "\r\n/")
    return F.regexp_replace(d, r"^([\s\S]*?)ALTER TRIGGER " + r'"\w+" ENABLE;', "$1")


def comment_statement(table: Column, column: Column | None, comment: Column, one_line: bool = False) -> Column:
    """COMMENT statement with the literal's quotes doubled, and without line ends if asked for."""
    target = F.concat(F.lit('TABLE "'), table, F.lit('"'))
    if column is not None:
        target = F.concat(F.lit('COLUMN "'), table, F.lit('"."'), column, F.lit('"'))
    literal = F.replace(comment, F.lit("'"), F.lit("''"))
    full = F.concat(F.lit("COMMENT ON "), target, F.lit(" IS '"), literal, F.lit("';"))
    return F.replace(full, F.lit("\n"), F.lit("")) if one_line else full


# --- package sources ----------------------------------------------------------


def compose_package(spec: Column, body: Column) -> Column:
    """Spec and optional body as one script, each closed by a slash; null without a spec."""
    blank, newline = F.lit(" "), F.lit("\n")
    s = F.rtrim(F.rtrim(spec, newline), blank)
    s = F.concat(s, F.when(s.endswith("/"), F.lit("\n\n")).otherwise(F.lit("/\n\n")))
    b = F.rtrim(F.rtrim(F.rtrim(body, blank), newline), blank)
    full = F.concat(s, b)
    closed = F.when(full.endswith("\n"), full).otherwise(F.concat(full, newline))
    return F.when(body.isNull(), s).otherwise(closed)


def rewrite_year_range(text: Column, year: int) -> Column:
    return F.regexp_replace(text, r"2003-20[0-9][0-9]", f"2003-{int(year)}")
