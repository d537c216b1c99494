"""From changed or all objects to the definition files that have to be stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.operators import catalog as C
from ledgerframe.operators import definitions as D
from ledgerframe.operators import impact as I
from ledgerframe.session import materialize


def chosen_objects(corpus: DataFrame, targets: DataFrame | None) -> DataFrame:
    """The part of a corpus that gets a file: not excluded and, if given, a target.

    Targets carry (object_name, object_type) in any case and in either spelling of the
    type. Both sides are unique by object. The list of targets is written, so that the
    scripts it may come from are read once.
    """
    kept = corpus.where(~C.is_excluded(F.col("object_name"), F.col("object_type")))
    if targets is None:
        return kept
    key_type = C.catalogue_type(F.col("object_type")).alias("object_type")
    wanted = materialize(targets.select(F.upper("object_name").alias("key_name"), key_type).distinct(), "wanted")
    keyed = kept.withColumn("key_name", F.upper("object_name"))
    return keyed.join(wanted, ["key_name", "object_type"], "left_semi").select(*corpus.columns)


def regeneration_targets(
    directory: DataFrame,
    registry: DataFrame,
    objects: DataFrame,
    indexes: DataFrame,
    triggers: DataFrame,
    dependencies: DataFrame,
    owner: str,
) -> DataFrame:
    """(object_name, object_type) whose definitions the scripts in development or changed ask for."""
    changed = I.candidate_objects(directory, registry)
    told = C.resolve_changed_objects(changed, objects, indexes, triggers, dependencies, owner)
    return told.where("action = 'regenerate'").select(
        F.col("target_name").alias("object_name"), F.col("target_type").alias("object_type")
    )


def definition_files(
    corpus: DataFrame,
    indexes: DataFrame,
    tab_comments: DataFrame,
    col_comments: DataFrame,
    sequences: DataFrame,
    triggers: DataFrame,
    owner: str,
    targets: DataFrame | None = None,
) -> DataFrame:
    """(path, part, text) of every definition, or of the targets' definitions.

    Tables come with indexes, comments, sequences and triggers, views with comments,
    packages and types as they are. Everything is joined once per kind instead of being
    asked for object by object. Given targets, dependants are first cut to theirs by a
    written list of names, whose known size lets Spark choose the join.
    """
    chosen = chosen_objects(corpus, targets)
    if targets is not None:
        names = materialize(chosen.select(F.col("object_name").alias("table_name")).distinct(), "targets")
        dependants = (indexes, tab_comments, col_comments, sequences, triggers)
        indexes, tab_comments, col_comments, sequences, triggers = (
            frame.join(names, "table_name", "left_semi") for frame in dependants
        )
    name, kind = F.col("object_name"), F.col("object_type")
    tables = D.table_documents(chosen, indexes, tab_comments, col_comments, sequences, triggers, owner)
    views = D.view_documents(chosen, tab_comments, col_comments, owner)
    programs = D.canonical(chosen.where(~kind.isin("TABLE", "VIEW")), owner)
    parts = [
        tables.select(C.artifact_path(name, F.lit("TABLE")).alias("path"), "part", "text"),
        views.select(C.artifact_path(name, F.lit("VIEW")).alias("path"), "part", "text"),
        programs.select(
            C.artifact_path(name, kind).alias("path"), F.lit(0).cast("bigint").alias("part"), F.col("ddl").alias("text")
        ),
    ]
    return D.union_all(parts).where("path is not null")
