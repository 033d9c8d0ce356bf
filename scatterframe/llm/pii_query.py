"""Query op8: personal data in every document."""

from __future__ import annotations

from .pii import find_pii
from .registry import read, register


@register("op8_pii")
def op8(spark, sf_dir):
    return find_pii(read(spark, sf_dir, "documents"))
