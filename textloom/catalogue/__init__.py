"""Registered queries and their SQL twins, each over whole tables of a data folder."""

from . import batches, dialogue, files, labels, metrics, predictions, prepared, tokens  # noqa: F401  (register)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
