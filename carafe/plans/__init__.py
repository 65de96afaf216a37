"""The analysis API and the registered queries."""

from . import catalogue, lines, menus, photos, profiles, records, runs, webpages  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
