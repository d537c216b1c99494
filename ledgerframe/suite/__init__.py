"""Registered queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("scripts", "catalog", "definitions", "changes", "files")


def _load():
    for group in GROUPS:
        import_module(f"ledgerframe.suite.{group}")
    from ledgerframe.suite import registry

    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().CHECKS)
