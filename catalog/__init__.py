"""Registered queries and, where SQL can say the same, the SQL they are checked against."""

from catalog.base import REGISTRY
from catalog import events, ingest, panel, profiles, regression, samples  # noqa: F401

__all__ = ["REGISTRY"]
