import random

from pyspark.sql import functions as F

from posteria.llm import queries, urls


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return host, rest[:cut]


def brute_rule(host, path):
    best = None
    for verdict, name, start in queries.URL_RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            if best is None or len(name + start) > len(best[0]):
                best = (name + start, verdict)
    return best or (None, None)


ODD = [None, "", "no host", "http://", "http:///x", "HTTP://EXAMPLE.com/en/a", "http://www.example.com/en/", "a://b://c/d",
       "http://x.net?q=/es/", "http://x.net#/fr/", "http://example.com/en", "http://notexample.com/en/x", "http://com/", "http://ÄÖ.net/es/\nx"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(ODD)], "page_id long, url string, host int")
    out = urls.judge_urls(pages, queries.URL_RULES, pages.limit(0)).collect()
    assert len(out) == len(ODD)
    for r in out:
        host, path = brute(ODD[r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_list_is_exact_even_with_a_tiny_filter(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_BLOCKS", 1)  # nearly every probe is a false positive
    rnd = random.Random(4)
    listed = [f"k{rnd.randrange(500)}" for _ in range(300)] + [None]
    rows = [(i, f"k{rnd.randrange(900)}" if i % 10 else None, True, 5) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, listed boolean, block int")
    out = urls.listed_rows(df, "k", spark.createDataFrame([(x,) for x in listed], "k string"), "k").collect()
    assert len(out) == 2000
    assert all(r["listed"] == (r["k"] is not None and r["k"] in listed) for r in out)


def test_canonical_form_decides_without_a_rule(spark):
    pages = [(1, "https://www.a.org/x/?utm_source=f&b=2&a=1#top"), (2, "http://a.org/x?a=1&b=2"), (3, "http://a.org/x"), (1, "http://A.org/y/")]
    listed = spark.createDataFrame([("http://A.org/x/?b=2&a=1",), ("http://a.org/y",), (None,)], "url string")
    out = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), [], listed)
    verdicts = {(r["page_id"], r["path"]): r["verdict"] for r in out.collect()}
    assert verdicts == {(1, "/x/"): "block", (2, "/x"): "block", (3, "/x"): "allow", (1, "/y/"): "block"}
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), [], listed).collect() == []


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    out = urls.judge_urls(pages, queries.URL_RULES, pages.select(F.col("url")))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
