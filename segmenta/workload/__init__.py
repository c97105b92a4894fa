"""The registered queries."""

from . import clinical, history, messages  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
