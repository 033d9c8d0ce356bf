"""Query op13: exact copies among all documents, taken in as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import register
from .stream_dedup import deduplicate

SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)
"""


@register("op13_stream_dedup", SQL)
def op13(spark, sf_dir):
    return deduplicate(spark, f"{sf_dir}/documents.parquet").select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
