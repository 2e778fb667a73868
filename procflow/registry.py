"""Registered queries of the library's own operators."""

from __future__ import annotations

from procflow.queries import artifacts, documents, files, live, operations

_MODULES = (documents, artifacts, operations, files, live)
flagship = documents.flagship


def queries():
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: s for m in _MODULES for name, s in m.SQL.items()}
