"""Query op3: documents without the bytes of repeated 400-byte strings."""

from __future__ import annotations

from .registry import read, register
from .suffix_dedup import remove_repeats

SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i + 1:i + 400]) AS h FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
r AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
g AS (SELECT doc_id, i, count(*) FILTER (p IS NULL OR i > p + 400) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, k),
cut AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM sp
  UNION ALL SELECT doc_id, coalesce(max(z), 0), octet_length(any_value(b)) FROM d LEFT JOIN sp USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, sha256(unhex(string_agg(hex(b[x + 1:y]), '' ORDER BY x))) AS kept_sha256 FROM cut JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, count(a) AS n_spans, CAST(coalesce(sum(z - a), 0) AS BIGINT) AS n_removed, CAST(octet_length(any_value(b)) AS BIGINT) AS n_bytes FROM d LEFT JOIN sp USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM sums JOIN kept USING (doc_id)
"""


@register("op3_suffix_dedup", SQL)
def op3(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)
