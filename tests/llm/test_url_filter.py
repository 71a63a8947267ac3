"""URL filter against a plain loop over all rules."""

import random

import pytest

from tidepool.llm import url_filter as U


def brute(url, rules, default=U.ALLOW):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, v in rules:
        if h is None or p is None or v is None:
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), h + p, v == U.BLOCK, v))
    return (host, path, best[2], best[4]) if best else (host, path, None, default)


def check(spark, urls, rules, **kw):
    pages = spark.createDataFrame(urls, "page_id long, url string, host string, rule string, `at` string")
    got = U.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), **kw).collect()
    want = [(u[0], *brute(u[1], rules, **kw)) for u in urls]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def _urls(texts):
    return [(i, u, "x", "y", "z") for i, u in enumerate(texts)]


EDGE = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/x", "https://www.example.com/en/", "https://www.example.com/EN/",
    "x://a.net/es/?q#f", "x://net/es/", "x://notnet/es/", "x://a.net/e", "x://b.com", "x://b.com/", "x://b.com?/en/", "x://b.com#/",
    "x://example.com/en", "x://y://z.com/", "x://É.example.com/en/é", "x://.com/", "x://com./", "x://a..com/", "x://com/\n/en/",
    "x://deep." + "sub." * 3000 + "example.com/en/" + "p/" * 30000, None, "x://b.com/",
]


def test_edges_of_the_contract_rules(spark):
    check(spark, _urls(EDGE), list(U.RULES))


@pytest.mark.parametrize("seed", range(3))
def test_random_nested_rules(spark, seed):
    rng = random.Random(seed)
    labels, steps = ["a", "b", "ab", "A", ""], ["/", "x", "y", "é"]
    host = lambda n: ".".join(rng.choices(labels, k=rng.randint(1, n)))
    path = lambda n: "/" * rng.randint(0, 1) + "".join(rng.choices(steps, k=rng.randint(0, n)))
    rules = list({(h.lower(), p): (h, p, rng.choice([U.ALLOW, U.BLOCK])) for h, p in ((host(3), path(3)) for _ in range(60))}.values())
    rules += [("b", "/", U.ALLOW), ("b", "/", U.BLOCK), (None, "/", U.BLOCK), ("a", None, U.BLOCK)]
    urls = [f"s://{host(5)}{path(5)}{rng.choice(['', '?q', '#f'])}" for _ in range(600)]
    check(spark, _urls(urls + ["s://b/x"] * 300), rules, default=U.BLOCK)


def test_empty_tables(spark):
    check(spark, _urls(EDGE[:6]), [])
    check(spark, [], list(U.RULES))


def test_rows_are_not_sent_to_one_task(spark):
    urls = _urls(["s://hot.com/en/"] * 3000 + ["s://cold.net/es/"] * 10)
    pages = spark.createDataFrame(urls, "page_id long, url string, host string, rule string, `at` string").repartition(8)
    out = U.judge(pages, U.rule_table(spark, U.RULES))
    assert out.count() == 3010 and out.where("rule = 'com/'").count() == 3000
