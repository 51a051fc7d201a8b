import random

from stocklens.llm.url_rules import RULES, judge_urls, with_host_and_path


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = ""
    for ch in rest:
        if ch in "/?#":
            break
        host += ch
    path = rest[len(host) :]
    path = path if path.startswith("/") else ""
    for stop in "?#":
        path = path.split(stop)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "x.net", "", "É.com", "A.Com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/x/y", "/fr/é", "//"]
    tails = ["", "?q=/en/", "#f", "?a#b"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(400)]
    urls += [None, "", "nothing", "://", "http://a.com/en/?x://net/", urls[0], "http://a.com/" + "z" * 50_000]
    rules = [("com", "/", "allow"), ("a.com", "/en", "block"), ("a.com", "/en/x", "allow"), ("b.a.com", "/en/x/", "block"), ("net", "/", "block"), ("x.net", "", "allow"), ("É.com", "/", "block")]
    extra = [(None, "/", "block"), ("net", "/", "block")]
    pages = [(i % 390, u, "clash") for i, u in enumerate(urls)] + [(None, "http://a.com/en/", "x")] * 3
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    for per_group in (20_000, 7):
        got = judge_urls(df, spark.createDataFrame(rules + extra, "host string, path string, verdict string"), rows_per_group=per_group)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(((p, *brute(u, rules)) for p, u, _ in pages), key=key)


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in judge_urls(pages, rules.limit(0)).collect()] == [(1, "a.com", "/", None, "allow")]


def test_host_and_path_of_null(spark):
    row = with_host_and_path(spark.createDataFrame([(None,)], "url string")).first()
    assert (row.host, row.path) == ("", "")
