"""All queries over the layout operators, by name, with their SQL."""

from . import export, files, layout, more, texts  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
