"""Registry of the reference-shaped queries and their SQL oracles."""

from __future__ import annotations

from . import core, derived, extraction

QUERIES = {**core.QUERIES, **extraction.QUERIES, **derived.QUERIES}
ORACLES = {**core.ORACLES, **extraction.ORACLES, **derived.ORACLES}
