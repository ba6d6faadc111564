"""Named queries on the test tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from arbitra.plans import (  # noqa: F401  (each import registers its queries)
    evaluation,
    features,
    inputs,
    registry,
    rules,
    scoring,
    sources,
    splits,
    streams,
    training,
)
from arbitra.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
