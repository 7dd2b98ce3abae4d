"""Rules of paths and the breadth-first crawl against a plain queue."""

import random

import pytest

from spandrel.operators import crawl

RULES = "host string, path string, allow boolean"


def plain_rule(url, rules):
    host, path = url.split("/")[2].lower(), "/" + url.split("/", 3)[3] if url.count("/") > 2 else "/"
    met = [(len(p), a, p) for h, p, a in rules if h.lower() == host and p and path.startswith(p)]
    return max(met)[1:] if met else (True, None)


def plain(seeds, edges, rules, hosts, depth, budget):
    seen, used, level = {}, {}, [("", 0, u) for u in set(seeds)]
    for d in range(depth + 1):
        named = {}
        for src, place, url in sorted(level):
            named.setdefault(url, (src, place))
        fetched = []
        for url, _ in sorted(named.items(), key=lambda x: (x[1], x[0])):
            if url in seen:
                continue
            host, (allow, rule) = url.split("/")[2].lower(), plain_rule(url, rules)
            status = "other host" if host not in hosts else "disallowed" if not allow else "over budget" if used.get(host, 0) >= budget else "fetched"
            seen[url] = (d, status, rule)
            if status == "fetched":
                used[host] = used.get(host, 0) + 1
                fetched.append(url)
        level = [(s, p, t) for s, t, p in edges if s in set(fetched)]
    return seen


@pytest.mark.parametrize("budget", [3, 100])
def test_crawl_follows_the_queue(spark, budget):
    rng = random.Random(budget)
    urls = [f"http://{h}.example/{p}/{k}" for h in ("a", "b", "c") for p in ("x", "x/y", "z") for k in range(12)] + ["http://a.example"]
    edges = [(rng.choice(urls), rng.choice(urls), k % 4) for k in range(400)]
    rules = [("a.example", "/x/", False), ("A.example", "/x/y/", True), ("b.example", "/", False), ("b.example", "/z", True), ("b.example", "/z", False), ("c.example", "", False)]
    seeds = urls[:3] + urls[60:63] + urls[-1:] + urls[:1]
    got = crawl.crawl(spark.createDataFrame([(u,) for u in seeds], "url string"), spark.createDataFrame(edges, "src string, dst string, place int"), spark.createDataFrame(rules, RULES), ["A.example", "b.example"], depth=3, budget=budget)
    assert {r.url: (r.depth, r.status, r.rule) for r in got.collect()} == plain(seeds, edges, rules, ["a.example", "b.example"], 3, budget)


def test_no_rules_and_no_links(spark):
    seeds = spark.createDataFrame([("http://a.example/",)], "url string")
    edges, rules = spark.createDataFrame([], "src string, dst string, place int"), spark.createDataFrame([], RULES)
    assert [(r.status, r.rule) for r in crawl.crawl(seeds, edges, rules, ["a.example"]).collect()] == [("fetched", None)]
    assert crawl.crawl(seeds.limit(0), edges, rules, ["a.example"]).count() == 0
