from __future__ import annotations

import pytest

import tallyloom.llm.url_filter as url_filter
from tallyloom.llm.queries import URL_RULES


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    cut = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
    return host, rest[:cut]


def verdict(url, rules):
    host, path = host_path(url)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "HTTP://A.Example.NET/en/1?x#y",
    "https://example.net",
    "https://example.net/",
    "https://notexample.net/en/",
    "https://example.net?q=/en/",
    "https://a.org/fr/x",
    "https://org/fr/",
    "https://example.com/de",
    "https://www.example.com/de/9",
    "https://example.net/EN/",
    "ftp://x.net/a://b.org/fr/",
    "https://É.net/",
    "https://" + "a." * 3000 + "net/" + "p/" * 3000,
    "https://example.net:80/en/",
    "http://net/x",
    "http://.net/x",
    "http://net./x",
]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, None, None) for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    pages = pages.unionAll(pages.limit(3))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted([tuple(r) for r in url_filter.filter_urls(pages, table).collect()], key=str)
    want = [(r.page_id, *verdict(r.url, rules)) for r in pages.collect()]
    assert got == sorted(want, key=str)


def test_rules_of_the_query(spark):
    check(spark, URLS, URL_RULES)


def test_both_joins_agree(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    check(spark, URLS, URL_RULES)


def test_paths_without_a_slash_and_conflicts(spark):
    check(spark, ["http://a.b/path", "http://b/pa", "http://b/"], [("b", "/pa", "block"), ("b", "/path", "allow"), ("b", "", "block")])
    check(spark, ["http://a.b/path"], [("b", "/", "block"), ("b", "/", "allow")])


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert [tuple(r) for r in url_filter.filter_urls(pages, rules).collect()] == [(1, "a.net", "/", None, "allow")]
    some = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filter.filter_urls(pages.limit(0), some).count() == 0


@pytest.mark.parametrize("node", ["ArrowEvalPython", "MapInArrow", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"])
def test_plan_is_native(spark, node):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert node not in url_filter.filter_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
