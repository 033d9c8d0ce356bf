"""Query op10: a quality score of every document."""

from __future__ import annotations

from .quality import classify
from .registry import read, register


@register("op10_quality")
def op10(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
