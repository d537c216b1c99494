"""Which database objects does a corpus of scripts touch?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions import names as N
from ledgerframe.functions import text as T
from ledgerframe.operators import reconcile as R
from ledgerframe.session import materialize


def normalize_scripts(scripts: DataFrame) -> DataFrame:
    return scripts.select("name", T.normalize_script(F.col("text")).alias("text"))


def changed_objects(scripts: DataFrame) -> DataFrame:
    """(name, object_name, object_type), one row per change phrase; no shuffle."""
    found = F.inline(T.changed_object_array(F.col("text")))
    return scripts.select("name", found)


def distinct_changed_objects(scripts: DataFrame) -> DataFrame:
    found = F.inline(T.changed_object_array(F.col("text")))
    return scripts.select(found).distinct()


def object_touch_counts(scripts: DataFrame) -> DataFrame:
    """Scripts per object. Repeats within a script fold in its own row, so the
    count is a plain one and combines before the shuffle."""
    once = F.array_distinct(T.changed_object_array(F.col("text")))
    return (
        scripts.select(F.inline(once))
        .groupBy("object_name", "object_type")
        .agg(F.count(F.lit(1)).alias("n_scripts"))
    )


def package_scripts(scripts: DataFrame) -> DataFrame:
    return scripts.select("name", T.is_package_script(F.col("text")).alias("is_package_script"))


def candidate_names(directory: DataFrame, registry: DataFrame) -> DataFrame:
    """Names of the forward owner scripts that are in development or changed.

    Decided on names and fingerprints: no text is in the exchange.
    """
    name = F.col("name")
    forward = R.valid_scripts(directory).where((N.script_type(name) == N.COMMIT) & (N.schema_type(name) == N.OWNER))
    known = R.registry_keys(registry).select("name", "reg_hash")
    marked = forward.select("name", N.fingerprint(F.col("text")).alias("dir_hash")).join(known, "name", "left")
    developing = N.order_number(name) < N.DEVELOPMENT_LIMIT
    changed = F.col("dir_hash") != F.col("reg_hash")
    return marked.where(F.coalesce(developing, F.lit(False)) | F.coalesce(changed, F.lit(False))).select("name")


def candidate_objects(directory: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct objects that the candidate scripts change.

    The names are written, so that Spark knows their size when it fetches the texts behind
    them; phrases are looked for in candidates only.
    """
    names = materialize(candidate_names(directory, registry), "candidates")
    return distinct_changed_objects(directory.join(names, "name", "left_semi"))


def ddl_candidates(directory: DataFrame, registry: DataFrame) -> DataFrame:
    """Forward owner scripts that are in development or changed, each once.

    Both conditions read one left join on name, so text is shuffled once and
    nothing has to be deduplicated.
    """
    name = F.col("name")
    forward = R.valid_scripts(directory).where(
        (N.script_type(name) == N.COMMIT) & (N.schema_type(name) == N.OWNER)
    )
    known = R.registry_keys(registry).select("name", "reg_hash")
    marked = forward.join(known, "name", "left")
    changed = N.fingerprint(F.col("text")) != F.col("reg_hash")
    developing = N.order_number(name) < N.DEVELOPMENT_LIMIT
    picked = marked.where(F.coalesce(developing, F.lit(False)) | F.coalesce(changed, F.lit(False)))
    return picked.select("name", "text", N.order_number(name).alias("order_number")).orderBy(
        F.asc_nulls_first("order_number"), "name"
    )
