"""Catalogue tables from a database or from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Catalogue views and the columns the operators need.
CATALOGUE_COLUMNS = {
    "objects": ("all_objects", "owner, object_name, object_type, generated, status"),
    "tab_comments": ("user_tab_comments", "table_name, comments"),
    "col_comments": ("user_col_comments", "table_name, column_name, comments"),
    "dependencies": ("user_dependencies", "name, type, referenced_type, referenced_name"),
    "triggers": ("user_triggers", "trigger_name, table_name"),
    "indexes": (
        "user_indexes",
        "table_name, index_name, uniqueness, compression, prefix_length, generated",
    ),
    "users": ("all_users", "username"),
}


def read_catalogue(spark: SparkSession, location: str, table: str, slices: int = 1, **options: str) -> DataFrame:
    """One catalogue table, from a ``jdbc:`` URL or from ``<location>/<table>`` in parquet.

    Over JDBC the rows are read in ``slices`` parallel queries, each taking one bucket
    of a hash of the first name column, so no connection carries the whole table.
    """
    view, columns = CATALOGUE_COLUMNS[table]
    if not location.startswith("jdbc:"):
        return spark.read.parquet(f"{location}/{table}").select(*[c.strip() for c in columns.split(",")])
    query = f"(select {columns} from {view}) q"
    if slices == 1:
        return spark.read.jdbc(location, query, properties=options)
    key = columns.split(",")[1 if table == "objects" else 0].strip()
    predicates = [f"ora_hash({key}, {slices - 1}) = {i}" for i in range(slices)]
    return spark.read.jdbc(location, query, predicates=predicates, properties=options)
