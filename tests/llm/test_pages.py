"""WARC framing and URL rules on small cases."""

import hashlib

import pytest

from scatterframe.llm import url_filter, warc

PAGES = "page_id long, url string, html string, digest string, value string"


def test_chunks():
    data = ("é" * 9001 + "x").encode()
    assert warc.unchunked(warc.chunked(data, 100)) == data
    assert warc.unchunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_archive_round_trip(spark, tmp_path):
    long = "ü\r\n\r\nWARC/1.1" * 20_000
    rows = [(1, "http://a/b c\r\n", long), (2, "u", long), (3, None, None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 1000), (9, "u", "y" * 1000), (8, "u", "y" * 1000), (8, "u", "y" * 1000), (None, "u", "y" * 1000)]
    pages = spark.createDataFrame([(*r, "d", "v") for r in rows], PAGES)
    path = f"file://{tmp_path}/w"
    warc.write_archive(pages, path, segment=50_000, per_file=3)
    got = {}
    for r in warc.read_archive(spark, path).collect():
        got.setdefault(r.page_id, []).append(r)
    for key, _, html in rows:
        data = (html or "").encode()
        for r in got[key]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            assert r.record_type == "revisit" or bytes(r.payload) == data
    assert {k: v[0].refers_to for k, v in got.items()} == {1: 2, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 9, 8: 9, 9: None, None: 9}
    assert len(got[8]) == 2
    warc.write_archive(pages.limit(0), f"{path}0")
    assert warc.read_archive(spark, f"{path}0").count() == 0


def test_missing_segment_is_an_error(spark, tmp_path):
    page = list(warc.records_of(1, "u", b"z" * 300, hashlib.sha1(b"z" * 300).hexdigest(), None, 0, 100))
    assert len(page) > 2
    spark.createDataFrame([(p,) for p in page[:-2] + page[-1:]], "value string").coalesce(1).write.option("lineSep", warc.SEPARATOR).text(f"{tmp_path}/w")
    with pytest.raises(Exception, match="missing"):
        warc.read_archive(spark, f"file://{tmp_path}/w").collect()


@pytest.mark.parametrize(("url", "bad"), [
    (None, False), ("", False), ("http://casino.com", True), ("http://casinos.com", False), ("http://x.com/ADS/track", True), ("http://x.com/ads/ads", False),
    ("http://roads.com/tracks", False), ("http://x.com/éads-bet", True), ("x" * 50_000 + "-porn", True)])
def test_terms(url, bad):
    assert url_filter.rejects(url, url_filter.automaton(url_filter.STRICT, url_filter.SOFT), 2) is bad


def test_rules(spark):
    rows = [(1, "HTTP://Www.Example.ORG/es/x?q"), (2, "http://notexample.org/es/"), (3, None), (4, "casino"), (5, "http://example.org"), (6, "a://org/en/1"), (7, "a://example.org/en/15#x"), (7, "a://example.org/en/15#x"), (None, "a://x.com/de/casino")]
    from scatterframe.llm.url_filter_query import RULES
    pages = spark.createDataFrame([(a, b, "h", "clash", "clash") for a, b in rows], "page_id long, url string, host string, path string, rule string")
    got = [tuple(r) for r in url_filter.filter_urls(pages, RULES).collect()]
    assert got == [
        (1, "www.example.org", "/es/x", "example.org/es/", "block"), (2, "notexample.org", "/es/", "org/", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "block"),
        (5, "example.org", "", None, "allow"), (6, "org", "/en/1", "org/", "allow"), (7, "example.org", "/en/15", "example.org/en/1", "block"), (7, "example.org", "/en/15", "example.org/en/1", "block"), (None, "x.com", "/de/casino", "com/de/", "block")]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
