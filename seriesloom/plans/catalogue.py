"""All queries and their SQL."""

from . import checks, models, series  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
