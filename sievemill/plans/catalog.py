"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from . import datasets, derived, evaluation, labels, nested, records, storage, streams, texts

MODULES = [nested, datasets, labels, records, evaluation, texts, derived, storage, streams]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def sql() -> dict:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
