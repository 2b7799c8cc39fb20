from lexilink.llm.urlfilter import RULES, filter_urls

URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://WWW.Example.ORG/es/1?x=/en/", "x://example.org/en/17#a",
    "x://notexample.org/es/", "x://a.com/fr/b://c.org/", "x://a.com/frx/", "x://com?/fr/", "x://a.b.c.com/de/", "x://a..org/", "http://org/", "x://org:80/", "ü://ÄB.org/é",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), a, h + p) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[3] if fit else None, max(fit)[2] if fit else "allow"


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for limit in (100, 1):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, RULES, broadcast_rules=limit).collect()}
        assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_empty_tables_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert filter_urls(df.limit(0), RULES).count() == 0
    none = spark.createDataFrame([], "action string, host string, path string")
    assert filter_urls(df, none, default="block").collect()[0].verdict == "block"


def test_repeated_ids_repeated_urls_and_long_urls(spark):
    long = "http://" + "a." * 300 + "example.org/en/1" + "x" * 200_000 + "?" + "y" * 1000
    rows = [(1, "http://a.com/de/x"), (1, "http://a.com/de/x"), (1, "http://a.com/fr/"), (None, "http://a.com/de/x"), (None, None), (2, long), (2, "http://" + "b" * 300_000)]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(spark.createDataFrame(rows * 3, "page_id long, url string"), RULES).collect()), key=repr)
    assert got == sorted([(i, *brute(u)) for i, u in rows * 3], key=repr)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://x.org/", "a", "b", "c")], "page_id long, url string, `key` string, best string, rule string")
    assert filter_urls(df, RULES).first().rule == "org/"


def test_hosts_of_very_many_labels(spark):
    import time

    rows = [(1, "http://" + "a." * 60_000 + "example.org/en/1"), (2, "http://" + "b." * 60_000 + "net/")] + [(k, None) for k in range(3, 50)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    began = time.time()
    got = {r.page_id: r.rule for r in filter_urls(df, RULES).select("page_id", "rule").collect()}
    assert time.time() - began < 10 and got[1] == "example.org/en/1" and got[2] is None and len(got) == 49
