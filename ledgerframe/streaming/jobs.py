"""Streams of arriving scripts and of run steps."""

from __future__ import annotations

from ledgerframe.streaming.registry_log import (
    absorb_scripts,
    compact_registry,
    latest,
    reconcile_stream,
    registry_versions,
    seed_registry,
    write_version,
)
from ledgerframe.streaming.run_log import recorded_steps, run_log_stream

__all__ = [
    "absorb_scripts",
    "compact_registry",
    "latest",
    "reconcile_stream",
    "recorded_steps",
    "registry_versions",
    "run_log_stream",
    "seed_registry",
    "write_version",
]
