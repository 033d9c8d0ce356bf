"""Query op6: every page's URL against the rules and the vocabulary."""

from __future__ import annotations

from .registry import read, register
from .url_filter import SOFT, SOFT_LIMIT, STRICT, filter_urls

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _hit(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"


SQL = f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
ruled AS (
  SELECT *, CASE
    {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))}
    END AS hit FROM parts)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule,
  coalesce(split_part(hit, ' ', 1), CASE WHEN {" OR ".join(map(_hit, STRICT))}
    OR ({" + ".join(f"CAST({_hit(t)} AS INT)" for t in SOFT)}) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""


@register("op6_url_filter", SQL)
def op6(spark, sf_dir):
    return filter_urls(read(spark, sf_dir, "pages"), RULES)
