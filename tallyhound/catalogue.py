"""The registered queries over the reference's operators and their SQL."""

from __future__ import annotations

from tallyhound.plans import domain, linking, reporting, scans, sketches, streams, tables, timing, verdict, words  # noqa: F401
from tallyhound.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
