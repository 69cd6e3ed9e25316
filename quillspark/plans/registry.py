"""All queries of the library and their SQL."""

from __future__ import annotations

from . import audits, details, evaluation, facts, files, more, nested, outcomes, programs, retrieval, rules, stats, streams, surface, tables, text

_MODULES = (retrieval, surface, audits, details, evaluation, more, outcomes, tables, text, programs, stats, files, rules, nested, facts, streams)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
