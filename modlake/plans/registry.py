"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from modlake.plans import collection, evaluation, io, more, streams  # noqa: F401  each registers its queries
from modlake.plans.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
