"""Template rendering and placeholder extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = r'\{(\w[^{"\r\n]*\w)\}'


def render_named(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by the value of each known name; unknown names stay.

    All names are substituted in one pass over the template's own pieces, so a
    value that happens to contain ``{other}`` is not expanded again.
    """
    if not values:
        return template
    pairs = [c for k, v in values.items() for c in (F.lit(k), v.cast("string"))]
    return render_from_map(template, F.create_map(*pairs))


def render_from_map(template: Column, values: Column) -> Column:
    """As ``render_named`` with a per-row map of values."""
    pieces = F.split(template, r"\{")

    def piece(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"^([^}]*)\}", 1)
        value = F.when(part.contains("}"), F.try_element_at(values, name))
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        known = F.concat(value, rest)
        kept = F.concat(F.lit("{"), part)
        return F.when(i == 0, part).otherwise(F.coalesce(known, kept))

    rendered = F.array_join(F.transform(pieces, piece), "")
    blank = template.rlike(r"^\s*\z")
    empty = F.coalesce(F.size(values) == 0, F.lit(True))
    return F.when(blank | empty, template).otherwise(rendered)


def render_positional(template: Column, args: Column) -> Column:
    """Fill each ``{}`` in turn from an array; surplus ``{}`` and arguments are left."""
    pieces = F.split(template, r"\{\}")
    count = F.size(args)

    def piece(part: Column, i: Column) -> Column:
        filler = F.when(
            i <= count, F.coalesce(F.get(args, i - 1).cast("string"), F.lit("null"))
        ).otherwise(F.lit("{}"))
        return F.when(i == 0, part).otherwise(F.concat(filler, part))

    return F.array_join(F.transform(pieces, piece), "")


def extract_placeholders(template: Column, keep_braces: bool = False) -> Column:
    """Distinct placeholder names of a template, in order of first use."""
    found = F.regexp_extract_all(template, F.lit(PLACEHOLDER), 0 if keep_braces else 1)
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))

