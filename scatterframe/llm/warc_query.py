"""Query op5: every page to WARC files and back."""

from __future__ import annotations

from .common import new_folder
from .registry import read, register
from .warc import LEAST, read_archive, write_archive

SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT digest, max(page_id) AS keeper FROM p WHERE n >= {LEAST} GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n < {LEAST} OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= {LEAST} AND keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (digest)
"""


@register("op5_warc", SQL)
def op5(spark, sf_dir):
    path = new_folder(spark, "warc")
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, payload=False)
