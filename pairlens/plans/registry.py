"""All queries of the analytics operators: importing the modules registers them."""

from __future__ import annotations

from . import comparisons, files, integrity, paired, protocols, selections, summaries, tasks, texts, vectors  # noqa: F401
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
