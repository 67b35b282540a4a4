"""All named queries."""

from . import (  # noqa: F401
    catalog_entries,
    catalog_files,
    catalog_mutate,
    catalog_quality,
    catalog_tags,
    catalog_validate,
)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
