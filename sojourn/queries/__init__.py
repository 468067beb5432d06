"""Importing the modules fills the registry."""

from sojourn.queries import cohorts, descriptive, layouts, relational, survival, website  # noqa: F401
from sojourn.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
