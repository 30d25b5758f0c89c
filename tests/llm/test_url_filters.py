import pytest

from vellum.llm.queries import URL_RULES
from vellum.llm.url_filters import filter_urls


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(URL_RULES, "rule string, verdict string")


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = path = ""
    if rest is not None:
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if host and ("." + host).endswith("." + h) and path.startswith("/" + p if "/" in rule else ""):
            fits.append((len(rule), verdict == "block", rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = ["http://www.Example.COM/en/a?x=1", "https://example.com/en/", "https://a.example.com/en", "https://example.com", "http://x.net/es/q#z", "http://net/fr/", "http://fakeexample.com/en/b", "http://a.b.c.d.net/es/",
        "nourl", "", None, "://", "http://", "http:///en/", "http://EXAMPLE.com?a=/en/", "http://xcom/", "a://b://c.com/", "http://x.com/" + "p/" * 3000, "http://é.com/en/\nx", "http://com/"]


def test_against_brute_force(spark, rules, got):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert got(filter_urls(df, rules), "page_id", "host", "path", "rule", "verdict") == sorted([(i, *judge(u, URL_RULES)) for i, u in enumerate(URLS)], key=repr)


def test_rules_without_slash_end_and_ties(spark, got):
    rules = [("x.org/a/b", "block"), ("x.org", "allow"), ("y.org/a", "allow"), ("y.org/a", "block")]
    urls = ["http://x.org/a/bc", "http://x.org/a/c", "http://x.org", "http://y.org/ab"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = got(filter_urls(df, spark.createDataFrame(rules, "rule string, verdict string")), "page_id", "host", "path", "rule", "verdict")
    assert out == sorted([(i, *judge(u, rules)) for i, u in enumerate(urls)], key=repr)


def test_repeated_null_empty_and_clashing(spark, rules, got):
    rows = [(1, "http://x.net/es/"), (1, "http://x.net/es/"), (None, None), (None, "http://a.com/"), (1, "http://x.net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' as rule", "1 as r_prefix", "2 as u_at")
    assert got(filter_urls(df, rules), "page_id", "verdict") == sorted([(1, "block"), (1, "block"), (None, "allow"), (None, "allow"), (1, "allow")], key=repr)
    assert filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in filter_urls(df, rules.limit(0)).collect()} == {"allow"}
