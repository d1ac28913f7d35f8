"""All queries outside the subpackage for training data."""

from __future__ import annotations

from grammarlens.plans import corpus, p2, usage

_MODULES = (corpus, usage, p2)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
