"""Facts carried by a script file name, as native column expressions.

A name is ``<order number>_<description>[_<schema>][_rollback].sql``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids stored in the registry.
COMMIT, ROLLBACK = 0, 1
EXECUTED, NOT_EXECUTED, EXECUTED_WITH_ERRORS, COMMAND_EXEC_FAILURE = 0, 1, 2, 3
ROLLBACK_SUFFIX = "_rollback"
DEVELOPMENT_LIMIT = 100
COMMON_BAND, UNDER_HUNDRED_BAND = 0, 1

# Name suffix of each target schema, and the suffixes that look
# like one but belong to the owner schema.
SCHEMA_SUFFIXES = {
    "USER": ("_user", ("pkg_user", "pkg_ext_imp_user")),
    "RPT": ("_rpt", ("pkg_rpt", "pkg_config_field_rpt")),
    "PKG": ("_pkg", ()),
    "PERFSTAT": ("_perfstat", ()),
}
OWNER = "OWNER"

VALID_NAME = r"^[0-9]+_+[^_]"


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def order_number(name: Column) -> Column:
    """Leading number of the name; null when absent or beyond 38 digits."""
    digits = F.regexp_extract(name, r"^([0-9]+)(?:_|\z)", 1)
    return F.when(digits != "", digits.try_cast("decimal(38,0)"))


def is_valid_name(name: Column) -> Column:
    return name.rlike(VALID_NAME)


def is_quarantined(name: Column) -> Column:
    """Whether a valid name has no place in the order, as its number is out of range."""
    return is_valid_name(name) & order_number(name).isNull()


def script_type(name: Column) -> Column:
    is_rollback = base_name(name).endswith(ROLLBACK_SUFFIX)
    return F.when(is_rollback, F.lit(ROLLBACK)).otherwise(F.lit(COMMIT)).cast("int")


def schema_type(name: Column) -> Column:
    base = F.lower(base_name(name))
    chain = None
    for schema, (suffix, owned_by_owner) in SCHEMA_SUFFIXES.items():
        hit = base.endswith(suffix)
        for other in owned_by_owner:
            hit = hit & ~base.endswith(other)
        chain = F.when(hit, schema) if chain is None else chain.when(hit, schema)
    return chain.otherwise(OWNER)


def effective_schema(name: Column) -> Column:
    """Schema of the forward script a rollback belongs to."""
    return schema_type(commit_name(name))


def rollback_name(name: Column) -> Column:
    made = F.concat(base_name(name), F.lit(ROLLBACK_SUFFIX + "."), extension(name))
    return F.when(script_type(name) == ROLLBACK, name).otherwise(made)


def commit_name(name: Column, strict: bool = False) -> Column:
    """Forward name of a rollback; removes every suffix unless ``strict``."""
    if strict:
        made = F.regexp_replace(name, ROLLBACK_SUFFIX + r"(\.[^.]*)?\z", "$1")
    else:
        made = F.replace(name, F.lit(ROLLBACK_SUFFIX), F.lit(""))
    return F.when(script_type(name) == ROLLBACK, made).otherwise(name)


def execution_band(name: Column) -> Column:
    """0 for names numbered with three digits or more, 1 for the rest."""
    common = name.rlike(r"^[0-9]{3,}_")
    return F.when(common, F.lit(COMMON_BAND)).otherwise(F.lit(UNDER_HUNDRED_BAND)).cast("int")


def fingerprint(text: Column) -> Column:
    """SHA-1 of the text with Windows line ends folded."""
    return F.sha1(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def status_of_exit_code(exit_code: Column) -> Column:
    ok = F.when(exit_code == 0, F.lit(EXECUTED))
    return ok.otherwise(F.lit(EXECUTED_WITH_ERRORS)).cast("int")


def elapsed_ms(seconds: Column) -> Column:
    return F.floor(seconds * 1000).cast("bigint")


def duration_hms(milliseconds: Column) -> Column:
    """``HH:mm:ss.SSS``; hours grow past two digits when they must."""
    ms = milliseconds.cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(ms / 3600000),
        F.floor(ms / 60000) % 60,
        F.floor(ms / 1000) % 60,
        ms % 1000,
    )


def with_script_facts(scripts):
    """Add every name-derived column to a frame that has ``name``."""
    name = F.col("name")
    return scripts.withColumns(
        {
            "order_number": order_number(name),
            "band": execution_band(name),
            "type": script_type(name),
            "schema_type": schema_type(name),
        }
    )
