"""Registered queries by family."""

from . import assembly, binding, contracts, documents, entities, evaluation, features, grids, guards, identity, labels, linking, lookups, matching, requests, responses, search, sequences, stability  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
