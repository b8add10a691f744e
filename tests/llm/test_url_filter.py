from staylens.llm import url_filter as U
from staylens.llm.queries import QUERIES, URL_RULES

URLS = [None, "", "x", "http://", "http://EXAMPLE.com", "http://example.com/", "http://a.example.com/en/x?y#z", "https://www.Example.com/en/", "https://www.example.com/en", "ftp://net/es/1",
        "http://x.net/es/", "http://x.net/fr/#", "http://xnet/es/", "http://x.net?/es/", "a://b://com/", "http://com/", "http://acom/", "http://..com/", "http://com./", "://com/", "http://user@com:80/",
        "http://ÀB.com/é", "http://www.example.com/en/a/b", "http://x#y", "http://example.com//en/", "http://" + "a." * 3000 + "com/" + "p/" * 3000]


def plain(url, rules, default="allow"):
    """Brute force: host, path, rule and verdict of a url."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), a == "block", h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_equals_brute_force(spark):
    rules = [*URL_RULES, ("com", "", "block"), ("com", "", "allow"), ("x.net", "/e", "allow"), ("b:", "/", "block"), ("com.", "/", "block")]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = U.url_verdicts(pages, spark.createDataFrame([*rules, *rules[:2], (None, "/", "block"), ("com", None, "block"), ("", "/", "block")], "host string, path string, action string"))
    assert sorted((r.page_id, r._host, r._path, r._rule, r._verdict, r.host) for r in got.collect()) == sorted((k, *plain(u, rules), "h") for k, u in enumerate(URLS * 2))


def test_empty(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://x.net/es/")], "page_id long, url string")
    assert U.url_verdicts(pages.where("false"), rules).collect() == []
    assert [r._verdict for r in U.url_verdicts(pages, rules.where("false"), default="block").collect()] == ["block"]


def test_query_is_native(spark, sf_small):
    out = QUERIES["op6_url_filter"](spark, sf_small)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    pages = spark.read.parquet(f"{sf_small}/pages.parquet").collect()
    assert sorted(tuple(r) for r in out.collect()) == sorted((p.page_id, *plain(p.url, URL_RULES)) for p in pages)


def test_clashing_columns_are_kept(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://x.net/es/", "mine", 4, "old")], "page_id long, url string, _url string, _best int, _rule string")
    r = U.url_verdicts(pages, rules).collect()[0]
    assert (r._url, r._best, r._rule, r._verdict) == ("mine", 4, "net/es/", "block")
