"""Incremental forms of the append-only steps."""
