"""Query op12: five filters in all orders, by language."""

from __future__ import annotations

from itertools import permutations

from .filters import LETTERS, audit
from .registry import read, register

ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations(LETTERS))
FAILED = {
    "A": "len(words) < 100",
    "B": "100 * len(list_distinct(words)) < 80 * len(words)",
    "C": "100 * len(regexp_extract_all(body, '[A-Z]')) > 10 * length(body)",
    "D": "regexp_matches(body, '[#$%&*|]')",
    "E": "doc_id > min(doc_id) OVER (PARTITION BY body)",
}

SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
cut AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words FROM texts),
failed AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
    [{", ".join(f"coalesce({FAILED[f]}, false)" for f in LETTERS)}] AS fails
  FROM cut LEFT JOIN labels USING (doc_id)),
counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b, len(list_filter(fails, lambda x: x)) AS k FROM failed GROUP BY part, fails),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, list_transform(string_split(substr(filter_order, 1, step), ''), lambda x: ascii(x) - 64) AS run
  FROM (VALUES {ORDERS}) AS o(filter_order), range(1, 6) AS r(step)),
told AS (SELECT part, filter_order, step, n, g, b, k, fails[run[step]] AS hit, len(list_filter(run[1:step - 1], lambda i: fails[i])) > 0 AS gone FROM counted, steps)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (hit AND k = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(g) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(b) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(sum(n) FILTER (hit AND NOT gone), 0)) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM told GROUP BY part, filter_order, step
"""


@register("op12_filter_audit", SQL)
def op12(spark, sf_dir):
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
