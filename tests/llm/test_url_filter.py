import pytest

from penprint.llm import url_filter as U

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = [
    "http://a.Example.ORG/es/1", "https://example.org/en/1x?q=/es/", "https://example.org/en/2#top", "http://notexample.org/es/", "http://org/", "http://x.org", "http://x.com/de/a", "http://x.com/fr/",
    "ftp://x.com/fr?/de/", "no scheme", "", None, "http://", "://org/x", "http://a.org/es/", "http://example.org/es", "http://EXAMPLE.org/ES/", "http://u:p@x.org:80/a", "http://x.com/de/://org/", "a://b\n.org/\nx", "http://ÀB.org/",
    "http://" + "a." * 5000 + "org/" + "y" * 100_000,
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, "allow")


def test_verdicts_equal_brute_force(spark):
    rows = [(i, u, "rule", "v") for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    got = sorted(((r.page_id if r.page_id is not None else -1), r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, U.rule_table(spark, RULES)).collect())
    want = sorted(((i if i is not None else -1), *brute(u)) for i, u, *_ in rows)
    assert len(got) == len(want)
    assert got == want


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(df, U.rule_table(spark, RULES)).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    empty = spark.createDataFrame([], "verdict string, host string, path string")
    assert [r.verdict for r in U.filter_urls(one, empty).collect()] == ["allow"]


def test_large_rule_table_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 1)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, U.rule_table(spark, RULES)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("default", ["allow", "block"])
def test_default(spark, default):
    df = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert U.filter_urls(df, U.rule_table(spark, RULES), default=default).collect()[0].verdict == default
