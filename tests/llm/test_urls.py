"""Hosts, rules and shrinkage."""

import pytest

from wristwave.llm import urls as u

PAGES = "page_id long, url string, host string"


def test_parts_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        ("https://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
        ("https://example.com/DE/1", "example.com", "/DE/1", None, "allow"),
        ("x://a.net", "a.net", "", None, "allow"),
        ("x://a.net/", "a.net", "/", "net/", "block"),
        ("x://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
        ("x://a.org?u=http://b.net/", "a.org", "", None, "allow"),
        ("x://a.org#/fr/", "a.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("a\n://É.NET/p\nq", "É.net", "/p\nq", "net/", "block"), ("://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)], PAGES)
    none = spark.createDataFrame([], "page long, bad int")
    got = {r.page_id: r for r in u.judge(pages, none).collect()}
    for i, c in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == c[1:], c


def test_reputation_shrinks(spark):
    """Many bad outcomes block a host; a single one doesn't; an unseen host follows its domain."""
    rows, bad = [], []
    for host, n, k in [("bad.x.com", 60, 57), ("ok.x.com", 60, 2), ("one.x.com", 1, 1), ("a.evil.org", 40, 40), ("b.evil.org", 40, 39), ("new.evil.org", 1, None), ("fine.org", 200, 5)]:
        for i in range(n):
            rows.append((len(rows), f"http://{host}/p", ""))
            if k is not None:
                bad.append((len(rows) - 1, int(i < k)))
    outcomes = spark.createDataFrame([*bad, (None, 1), (0, None), bad[0]], "page long, bad int")
    got = {r.host: r for r in u.judge(spark.createDataFrame(rows, PAGES), outcomes).collect()}
    assert got["bad.x.com"].verdict == got["a.evil.org"].verdict == "block"
    assert got["ok.x.com"].verdict == got["one.x.com"].verdict == got["fine.org"].verdict == "allow"
    assert got["new.evil.org"].rate > got["one.x.com"].rate > got["ok.x.com"].rate
    assert 0 < got["ok.x.com"].bound < got["ok.x.com"].rate


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b.com/"), (1, "http://a.b.com/"), (None, "http://c.com"), (None, None)], "page_id long, url string")
    got = u.judge(pages, spark.createDataFrame([(1, 1), (1, 0)], "page long, bad int"))
    assert got.count() == 4
    assert u.judge(pages.limit(0), spark.createDataFrame([], "page long, bad int")).count() == 0


@pytest.mark.parametrize("host,domain,suffix", [("a.b.co.uk", "b.co.uk", "co.uk"), ("a.b.com", "b.com", "com"), ("localhost", "localhost", "localhost"), ("", "", "")])
def test_domains(spark, host, domain, suffix):
    from pyspark.sql import functions as F

    assert tuple(spark.range(1).select(u.domain_of(F.lit(host)), u.suffix_of(F.lit(host))).first()) == (domain, suffix)
