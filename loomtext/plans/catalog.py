"""All queries of the library: importing the operator modules registers them."""

from __future__ import annotations

from loomtext.operators import align, anchors, audit, contracts, diffs, eventlog, fileformats, logfiles, logrules, metrics, misc, ranks, relational, scripts, sections, segment, stats, vectors  # noqa: F401
from loomtext.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
