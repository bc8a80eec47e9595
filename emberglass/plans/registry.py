"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from . import rules, training

QUERIES = {**rules.QUERIES, **training.QUERIES}
ORACLES = {**rules.ORACLES, **training.ORACLES}
FLAGSHIP = "q_rules"
