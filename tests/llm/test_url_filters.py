"""URL filter lists against brute force, with filters too small for the list, large lists and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cairnflow.llm import url_filters
from cairnflow.llm.queries import URL_RULES

RULE_SCHEMA = "host string, path string, verdict string"
PAGES = "page_id long, url string, html string, host string, path string, rule int, hits string, pages int, verdict int"


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def frame(spark, urls):
    rows = [(i if i % 7 else None, u, "<p>", "h", "p", 1, "x", 2, 3) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, PAGES).repartition(3), [r[0] for r in rows]


def odd_urls():
    fixed = [
        None, "", "no scheme", "://", "http://", "http:///en/x", "https://EXAMPLE.com/en/a", "http://a.Example.COM/en/", "http://www.example.com/en/?q=/fr/",
        "http://www.example.com/EN/", "http://example.com", "http://example.com?x", "http://com/", "http://acom/", "http://x.net/es/1", "http://net/fr/",
        "http://x.net/es", "http://x.org/fr/#a", "http://a..com/en/", "http://example.com./en/", ".com://example.com/en/y", "http://u:p@example.com/en/", "http://example.com:80/en/",
        "http://é.example.com/en/ü", "http://ÀB.com/ü/é", "a://b://c.com/en/", "http://x.com/" + "a/" * 40_000, "http://" + "a." * 5_000 + "net/fr/z", "http://example.com/e\nn/", "http://x.net/fr/\n",
    ]
    rnd = random.Random(4)
    hosts = ["example.com", "www.example.com", "b.net", "net", "c.d.e.net", "o.org", "x.com"]
    made = [f"http://{rnd.choice(['', 'm.', 'a.b.'])}{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/es/', '/fr/', '/fr'])}{rnd.randrange(40)}" for _ in range(300)]
    return fixed + made + ["http://hot.example.com/en/1"] * 200


@pytest.mark.parametrize("small_list, blocks", [(100_000, 1 << 16), (0, 1)])
def test_rules_of_the_query(spark, small_list, blocks):
    urls = odd_urls()
    pages, ids = frame(spark, urls)
    rules = {(h, p): v for h, p, v in URL_RULES}
    found = url_filters.judge(pages, spark.createDataFrame(URL_RULES, RULE_SCHEMA), small_list, blocks)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = [(i, *brute(u, rules)) for i, u in zip(ids, urls)]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("small_list, blocks", [(100_000, 1 << 16), (0, 2)])
def test_long_list_with_a_crowded_filter(spark, small_list, blocks):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 3)))
    made = [(".".join(word() for _ in range(rnd.randint(1, 3))), rnd.choice(["", "/", f"/{word()}", f"/{word()}/{word()}"]), rnd.choice(["allow", "block"])) for _ in range(600)]
    rules: dict = {}
    for h, p, v in made:
        rules[h, p] = max(v, rules.get((h, p), v))
    extra = [("A" + made[0][0], None, "BLOCK"), (None, "/", "block"), ("", "/", "block"), ("a", "/", None), ("a", "/", "odd"), made[0]]
    rules["a" + made[0][0], ""] = "block"
    urls = [f"s://{'.'.join(word() for _ in range(rnd.randint(1, 4)))}/{word()}/{word()}" for _ in range(500)]
    pages, ids = frame(spark, urls)
    found = url_filters.judge(pages, spark.createDataFrame(made + extra, RULE_SCHEMA), small_list, blocks).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found), key=order) == sorted([(i, *brute(u, rules)) for i, u in zip(ids, urls)], key=order)


def test_filter_misses_no_key_and_passes_few_others(spark):
    rules = spark.range(20_000).selectExpr("concat('h', id, '.org') AS host", "concat('/', id % 7, '/') AS path", "'block' AS verdict")
    bits = url_filters.build_filter(rules, 20_000)
    assert len(bits.bits) <= 2048

    def keys(names):
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"host": pa.array(names), "path": pa.array(["/x/"] * len(names))})
        return next(url_filters.rule_keys(batch)).column("h").to_numpy().view(np.uint64)[: len(names)]

    assert bits.may_hold(keys([f"h{i}.org" for i in range(20_000)])).all()
    assert bits.may_hold(keys([f"g{i}.org" for i in range(20_000)])).mean() < 0.01


def test_empty_tables(spark):
    pages, ids = frame(spark, odd_urls()[:20])
    none = spark.createDataFrame([], RULE_SCHEMA)
    assert {(r.rule, r.verdict) for r in url_filters.judge(pages, none).collect()} == {(None, "allow")}
    assert url_filters.judge(pages.limit(0), spark.createDataFrame(URL_RULES, RULE_SCHEMA)).collect() == []
