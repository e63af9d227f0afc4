"""Named queries over the stand-in tables, each with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

from reviewlake.catalog.registry import ORACLE, QUERIES

for _group in ("dashboard", "cleaning", "tokens", "phrases", "language", "gold", "metrics", "frontier", "storage"):
    import_module(f"reviewlake.catalog.{_group}")

__all__ = ["ORACLE", "QUERIES"]
