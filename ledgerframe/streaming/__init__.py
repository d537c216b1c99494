"""Structured Streaming forms of reconciliation and of run replay."""
