"""URL filtering: host and path rules, then a weighted vocabulary counted by Aho-Corasick.

A rule names a host and the start of a path; it fits that host and its
subdomains, and of the rules that fit the longest decides.  URLs that no rule
fits are judged by their words: one strict term rejects, and so do several
different soft terms.  A term counts only between characters that are no ASCII
letters or digits (or the ends), so ``ads`` is not found in ``roads``.

Defined results: a null URL, or one without ``://``, has an empty host and
path; null and empty URLs hold no term and are allowed.  Repeated rows are
judged alike.  Columns of the input other than the URL and the kept ones are
ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = ("adult-x", "casino", "cheap-pills", "porn", "spam-farm", "viagra", "xxx")
SOFT = ("ads", "adult", "bet", "bets", "cheap", "escort", "free", "loan", "pills", "poker", "sex", "spam", "track", "win")
SOFT_LIMIT = 2
_FOLD = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does; ``rules`` holds (verdict, host, path)."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    if len(found):
        found.make_automaton()
    return found


def rejects(url: str | None, terms: ahocorasick.Automaton, soft_limit: int) -> bool:
    text = (url or "").translate(_FOLD)
    if not text or not len(terms):
        return False
    edge = lambda i: not (0 <= i < len(text)) or not (text[i].isascii() and text[i].isalnum())
    soft = set()
    for last, (term, strict) in terms.iter(text):
        if edge(last + 1) and edge(last - len(term)):
            if strict:
                return True
            soft.add(term)
            if len(soft) >= soft_limit:
                return True
    return False


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``keep`` plus host, path, rule and verdict (``allow`` or ``block``) of every row."""

    @F.pandas_udf("string")
    def judge(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = automaton(strict, soft)
        for batch in urls:
            yield pd.Series(["block" if rejects(u, terms, soft_limit) else "allow" for u in batch], dtype=object)

    host, path = host_and_path(F.col(url))
    rows = pages.select(*keep, F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("_judged", judge("_url"))
    return rows.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("_judged")).alias("verdict"))
