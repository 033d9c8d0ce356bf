"""Importing this module registers every query of the subpackage."""

from . import decontaminate_query, filters_query, idfiles_query, jaccard_query, negatives_query, packing_query, pii_query, quality_query, stream_dedup_query, suffix_dedup_query, topk_query, url_filter_query, warc_query  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
