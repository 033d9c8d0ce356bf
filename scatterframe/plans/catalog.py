"""Importing this module registers every query."""

from . import (  # noqa: F401
    anova_queries,
    assoc_queries,
    blockload_queries,
    burst_queries,
    io_queries,
    kpi_queries,
    quality_queries,
    reorder_queries,
    shape_queries,
    structure_queries,
    validate_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
