"""Registered queries over the driver tables, each with its SQL form where SQL can express it."""

from __future__ import annotations

from . import evaluation, files, hierarchy, indexed, listing, mutation, product, retrieval, semantic, textprep

_PARTS = (semantic, product, hierarchy, retrieval, textprep, mutation, evaluation, listing, indexed, files)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
