"""Queries over the object catalogue.

A catalogue holds the objects of many owners; operators that go by an object's name alone take
the owner and look at nothing else. Lookups take a frame of requested names. Requests are made distinct first, so a
name asked for millions of times is one row before it reaches a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.operators.skew import HOT_ROWS, join_counted, union_all
from ledgerframe.session import materialize

# Catalogue spelling of each object type.
CATALOGUE_TYPE = {
    "PACKAGE_BODY": "PACKAGE BODY",
    "PACKAGE_SPEC": "PACKAGE",
    "TABLE": "TABLE",
    "VIEW": "VIEW",
    "COMMENT": "COMMENT",
    "INDEX": "INDEX",
    "SEQUENCE": "SEQUENCE",
    "TRIGGER": "TRIGGER",
    "TYPE_BODY": "TYPE BODY",
    "TYPE_SPEC": "TYPE",
}
# Object types that can be recompiled, with the statement for each.
COMPILE_STATEMENT = {
    "TRIGGER": ("alter trigger ", " compile"),
    "PROCEDURE": ("alter procedure ", " compile"),
    "FUNCTION": ("alter function ", " compile"),
    "PACKAGE": ("alter package ", " compile specification"),
    "PACKAGE BODY": ("alter package ", " compile body"),
    "TYPE": ("alter type ", " compile specification"),
    "TYPE BODY": ("alter type ", " compile body"),
    "INDEX": ("alter index ", " rebuild"),
    "VIEW": ("alter view ", " compile"),
    "SYNONYM": ("select 1 from ", ""),
}
# Folder and file suffix of each stored definition.
STORED_AS = {
    "PACKAGE_BODY": ("packages", ".sql"),
    "PACKAGE_SPEC": ("packages", "_spec.sql"),
    "TABLE": ("tables", ".sql"),
    "VIEW": ("views", ".sql"),
    "TYPE_BODY": ("types", ".sql"),
    "TYPE_SPEC": ("types", "_spec.sql"),
}
# Names left out of definitions by default.
EXCLUDED_PREFIXES = {"PACKAGE": ("PKGR_",), "PACKAGE BODY": ("PKGR_",), "VIEW": ("VX_",)}
EXCLUDED_SEQUENCES = ("SEQ_BPD_ITEMS_UNIT_ID",)
SCHEMA_POSTFIXES = ("_USER", "_RPT", "_PKG")


def catalogue_type(object_type: Column) -> Column:
    """Catalogue spelling; types that are spelled alike stay as they are."""
    pairs = [F.lit(v) for kv in CATALOGUE_TYPE.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), object_type), object_type)


def of_owner(objects: DataFrame, owner: str) -> DataFrame:
    return objects.where(F.col("owner") == owner)


def list_objects(objects: DataFrame, owner: str) -> DataFrame:
    """The owner's objects that have a stored definition; ``_`` is a wildcard in the patterns."""
    kind, name = F.col("object_type"), F.col("object_name")
    own = F.col("generated") == "N"
    table = (kind == "TABLE") & own & ~name.like("Z_%") & ~name.like("%_OLD")
    always = kind.isin("VIEW", "PACKAGE", "PACKAGE BODY", "TRIGGER")
    typed = kind.isin("TYPE", "TYPE BODY") & own & ~name.like("T$%")
    return of_owner(objects, owner).where(table | always | typed).select("object_name", "object_type")


def distinct_keys(objects: DataFrame) -> DataFrame:
    return objects.select("object_name", "object_type").distinct()


def object_exists(requests: DataFrame, objects: DataFrame, owner: str) -> DataFrame:
    """(object_name, object_type, found) per distinct request; blank requests are false."""
    asked = requests.select("object_name", "object_type").distinct()
    keyed = asked.withColumns(
        {"key_name": F.upper("object_name"), "key_type": catalogue_type(F.col("object_type"))}
    )
    known = distinct_keys(of_owner(objects, owner)).select(
        F.col("object_name").alias("key_name"),
        F.col("object_type").alias("key_type"),
        F.lit(True).alias("hit"),
    )
    joined = keyed.join(known, ["key_name", "key_type"], "left")
    blank = F.trim("object_name") == ""
    found = F.coalesce(F.col("hit"), F.lit(False)) & ~F.coalesce(blank, F.lit(True))
    return joined.select("object_name", "object_type", found.alias("found"))


def _kinds(objects: DataFrame) -> DataFrame:
    return (
        objects.where(F.col("object_type").isin("TABLE", "VIEW"))
        .groupBy(F.col("object_name").alias("key_name"))
        .agg(F.count(F.lit(1)).alias("hits"), F.max("object_type").alias("kind"))
    )


def object_kind(names: DataFrame, objects: DataFrame, owner: str) -> DataFrame:
    """TABLE or VIEW per name, or ``missing`` / ``ambiguous``."""
    asked = names.select("object_name").distinct().withColumn("key_name", F.upper("object_name"))
    joined = asked.join(_kinds(of_owner(objects, owner)), "key_name", "left")
    kind = (
        F.when(F.col("hits").isNull(), "missing")
        .when(F.col("hits") > 1, "ambiguous")
        .otherwise(F.col("kind"))
    )
    return joined.select("object_name", kind.alias("kind"))


def _parent(names: DataFrame, owned: DataFrame, owned_name: str) -> DataFrame:
    asked = names.select("object_name").distinct().withColumn("key_name", F.upper("object_name"))
    parents = owned.select(F.col(owned_name).alias("key_name"), "table_name")
    return asked.join(parents, "key_name", "left").select("object_name", "table_name")


def parent_by_index(names: DataFrame, indexes: DataFrame) -> DataFrame:
    return _parent(names, indexes, "index_name")


def parent_by_trigger(names: DataFrame, triggers: DataFrame) -> DataFrame:
    return _parent(names, triggers, "trigger_name")


def table_sequences(dependencies: DataFrame, triggers: DataFrame) -> DataFrame:
    """Distinct (table_name, sequence_name): a table uses the sequences its triggers read.

    References are made distinct before the join. A trigger that still names a large
    share of the sequences is split by adaptive skew handling, which is free to do so
    because the join's output is shuffled on other columns anyway.
    """
    uses = (
        dependencies.where("type = 'TRIGGER' and referenced_type = 'SEQUENCE'")
        .select(F.col("name").alias("trigger_name"), F.col("referenced_name").alias("sequence_name"))
        .distinct()
    )
    owners = triggers.select("trigger_name", "table_name")
    return uses.join(owners, "trigger_name").select("table_name", "sequence_name").distinct()


def parent_by_sequence(
    names: DataFrame, dependencies: DataFrame, triggers: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every table of a sequence, with the number of tables it has."""
    asked = names.select("object_name").distinct().withColumn("sequence_name", F.upper("object_name"))
    # Written, as the scripts behind the names may be costly to scan and it is read three times.
    asked = materialize(asked, "asked")
    # References are cut to the asked names before anything else is done with them.
    wanted = dependencies.join(
        asked.select(F.col("sequence_name").alias("referenced_name")).distinct(), "referenced_name", "left_semi"
    )
    pairs = table_sequences(wanted, triggers)
    # Slim, and read by the count as well as by the join with it: made once. An inner
    # join, so that a sequence with very many tables can be split on its own side.
    found = materialize(
        pairs.join(asked, "sequence_name").select("object_name", "table_name"), "sequence_owners"
    )
    counts = found.groupBy("object_name").agg(F.count(F.lit(1)).alias("n_tables"))
    owned = join_counted(found, counts, ["object_name"], rows="n_tables", hot_rows=hot_rows)
    absent = asked.join(counts, "object_name", "left_anti").select(
        "object_name",
        F.lit(None).cast("string").alias("table_name"),
        F.lit(0).cast("bigint").alias("n_tables"),
    )
    return owned.select("object_name", "table_name", "n_tables").unionByName(absent)


def index_sort_columns() -> dict[str, Column]:
    """Order within a table: unique ones first, then by leading text and first number."""
    name = F.col("index_name")
    lead = F.nullif(F.regexp_extract(name, r"^\D*", 0), F.lit(""))
    number = F.nullif(F.regexp_extract(name, r"\d+", 0), F.lit(""))
    return {"lead": lead, "number": number.try_cast("decimal(38,0)")}


def table_indexes(indexes: DataFrame) -> DataFrame:
    """Hand-made indexes with their sort columns, in a range-partitioned global order."""
    own = indexes.where((F.col("generated") == "N") & ~F.col("index_name").like("PK_%"))
    compressed = F.when(F.col("compression") == "ENABLED", F.lit(1)).otherwise(F.lit(0))
    return (
        own.withColumns({**index_sort_columns(), "compressed": compressed})
        .select("table_name", "index_name", "uniqueness", "lead", "number", "compressed", "prefix_length")
        .orderBy(
            "table_name",
            F.desc("uniqueness"),
            F.asc_nulls_first("lead"),
            F.asc_nulls_last("number"),
            "index_name",
        )
    )


def table_triggers(triggers: DataFrame) -> DataFrame:
    own = triggers.where(~F.col("trigger_name").like("Z_%"))
    return own.select(
        "table_name", "trigger_name", F.lower("trigger_name").alias("sort_name")
    ).orderBy("table_name", "sort_name", "trigger_name")


def commented_tables(tab_comments: DataFrame, col_comments: DataFrame) -> DataFrame:
    parts = [c.where("comments is not null").select("table_name") for c in (tab_comments, col_comments)]
    return union_all(parts).distinct()


def resolve_changed_objects(
    changed: DataFrame,
    objects: DataFrame,
    indexes: DataFrame,
    triggers: DataFrame,
    dependencies: DataFrame,
    owner: str,
) -> DataFrame:
    """(target_name, target_type, action): what a set of changed objects means.

    A comment stands for its table or view; an index, trigger or sequence for its
    table. Objects still in the catalogue are to ``regenerate``, stored ones that
    left it are ``redundant``, and dependants without a parent are ``unresolved``.
    """
    # Names only, read once per kind below: the scripts behind them are scanned once.
    asked = materialize(changed.select("object_name", "object_type").distinct(), "changed")
    objects = of_owner(objects, owner)

    def of(kind: str) -> DataFrame:
        return asked.where(F.col("object_type") == kind).select("object_name")

    def row(name: Column, kind: Column, action: Column) -> list[Column]:
        return [
            F.lower(name).alias("target_name"),
            kind.alias("target_type"),
            action.alias("action"),
        ]

    tables = objects.where("object_type = 'TABLE'").select(F.col("object_name").alias("table_name")).distinct()
    dependants = []
    for kind, parents in (
        ("INDEX", parent_by_index(of("INDEX"), indexes)),
        ("TRIGGER", parent_by_trigger(of("TRIGGER"), triggers)),
    ):
        present = tables.withColumn("is_table", F.lit(True))
        joined = parents.join(present, "table_name", "left")
        ok = F.col("is_table").isNotNull()
        dependants.append(
            joined.select(
                *row(
                    F.when(ok, F.col("table_name")).otherwise(F.col("object_name")),
                    F.when(ok, F.lit("TABLE")).otherwise(F.lit(kind)),
                    F.when(ok, F.lit("regenerate")).otherwise(F.lit("unresolved")),
                )
            )
        )
    owners = parent_by_sequence(of("SEQUENCE"), dependencies, triggers)
    owned = F.col("table_name").isNotNull()
    dependants.append(
        owners.select(
            *row(
                F.coalesce("table_name", "object_name"),
                F.when(owned, F.lit("TABLE")).otherwise(F.lit("SEQUENCE")),
                F.when(owned, F.lit("regenerate")).otherwise(F.lit("unresolved")),
            )
        )
    )
    kinds = object_kind(of("COMMENT"), objects, owner)
    known = F.col("kind").isin("TABLE", "VIEW")
    dependants.append(
        kinds.select(
            *row(
                F.col("object_name"),
                F.when(known, F.col("kind")).otherwise(F.lit("COMMENT")),
                F.when(known, F.lit("regenerate")).otherwise(F.lit("unresolved")),
            )
        )
    )
    stored = asked.where(F.col("object_type").isin(*STORED_AS))
    direct = object_exists(stored, objects, owner).select(
        *row(
            F.col("object_name"),
            F.col("object_type"),
            F.when(F.col("found"), F.lit("regenerate")).otherwise(F.lit("redundant")),
        )
    )
    return union_all([*dependants, direct]).distinct()


def artifact_path(object_name: Column, object_type: Column) -> Column:
    """``{folder}/{lower name}[_spec].sql``, null for types without a stored file."""
    chain = None
    for kind, (folder, suffix) in STORED_AS.items():
        path = F.concat(F.lit(folder + "/"), F.lower(object_name), F.lit(suffix))
        hit = object_type.isin(kind, CATALOGUE_TYPE[kind])
        chain = F.when(hit, path) if chain is None else chain.when(hit, path)
    return chain


def artifact_paths(objects: DataFrame) -> DataFrame:
    path = artifact_path(F.col("object_name"), F.col("object_type"))
    return objects.select("object_name", "object_type", path.alias("path"))


def redundant_artifacts(changed: DataFrame, objects: DataFrame, owner: str) -> DataFrame:
    """Stored files of objects that left the catalogue; a spec takes its body along."""
    stored = changed.where(F.col("object_type").isin(*STORED_AS))
    gone = object_exists(stored, objects, owner).where(~F.col("found"))
    name, kind = F.col("object_name"), F.col("object_type")
    body_kind = F.replace(kind, F.lit("_SPEC"), F.lit("_BODY"))
    paths = F.when(
        kind.endswith("_SPEC"), F.array(artifact_path(name, kind), artifact_path(name, body_kind))
    ).otherwise(F.array(artifact_path(name, kind)))
    return gone.select("object_name", "object_type", F.explode(paths).alias("path"))


def is_excluded(
    object_name: Column,
    object_type: Column,
    prefixes: dict[str, tuple[str, ...]] = EXCLUDED_PREFIXES,
    sequences: tuple[str, ...] = EXCLUDED_SEQUENCES,
) -> Column:
    """Does an object never get a definition, by its prefix or sequence name?"""
    name = F.upper(object_name)
    hit = F.lit(False)
    for wanted, starts in prefixes.items():
        for start in starts:
            hit = hit | ((object_type == wanted) & name.startswith(start.upper()))
    for part in sequences:
        hit = hit | ((object_type == "SEQUENCE") & name.contains(part))
    return hit


def excluded_objects(objects: DataFrame, **lists) -> DataFrame:
    """Objects left out of definitions; the lists are those of ``is_excluded``."""
    hit = is_excluded(F.col("object_name"), F.col("object_type"), **lists)
    return objects.where(hit).select("object_name", "object_type")


def invalid_objects(objects: DataFrame, owner: str) -> DataFrame:
    schemas = [owner, *[owner + p for p in SCHEMA_POSTFIXES]]
    bad = objects.where(
        (F.col("status") == "INVALID")
        & ~F.col("object_name").like("BIN$%")
        & (F.col("object_type") != "SYNONYM")
        & F.col("owner").isin(*schemas)
    )
    return bad.select("owner", "object_type", "object_name").orderBy("owner", "object_type", "object_name")


def _compilable(objects: DataFrame) -> DataFrame:
    return objects.where((F.col("status") != "VALID") & F.col("object_type").isin(*COMPILE_STATEMENT))


def invalid_summary(objects: DataFrame) -> DataFrame:
    """Invalid objects per owner and type, with subtotals and the total as null keys."""
    return _compilable(objects).rollup("owner", "object_type").agg(F.count(F.lit(1)).alias("n_invalid"))


def compile_statements(objects: DataFrame, owner: str) -> DataFrame:
    """The statement that would recompile each invalid object of the owner, as text only."""
    kind, name = F.col("object_type"), F.col("object_name")
    chain = None
    for wanted, (before, after) in COMPILE_STATEMENT.items():
        text = F.concat(F.lit(before), name, F.lit(after))
        chain = F.when(kind == wanted, text) if chain is None else chain.when(kind == wanted, text)
    return _compilable(of_owner(objects, owner)).select("owner", "object_name", "object_type", chain.alias("statement"))


def present_schemas(owner: str, users: DataFrame) -> DataFrame:
    wanted = [owner + p for p in SCHEMA_POSTFIXES]
    return users.where(F.col("username").isin(*wanted)).select("username").distinct()
