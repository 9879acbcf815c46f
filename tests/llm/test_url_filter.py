import re

import pytest

from plumbline.llm.url_filter import RULES, judge


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "example.com/en/", "http://example.com/en/", "http://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/x", "http://a.www.example.com/en/", "http://myexample.com/en/", "http://example.com/en",
    "http://example.com", "http://example.com?/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://x.org/en/", "ftp://u@example.com:80/en/", "http://example.com/EN/", "http://://example.com/en/",
    "https://é.example.com/en/é", "http://com/", "http:///en/", "http://.com/", "http://example.com./en/", "x\ny://a.com/b\nc", "http://" + "a." * 3000 + "example.com/en/" + "x/" * 3000,
]


@pytest.mark.parametrize("rules", [RULES, [], [("b.example.com", "/en/x", "block"), ("example.com", "/e", "allow"), ("example.com", "", "block")]])
def test_against_brute_force(spark, rules):
    pages = spark.createDataFrame([(i % 7 and i, u, 1) for i, u in enumerate(URLS + URLS[:4])], "page_id long, url string, rule int")
    got = sorted((tuple(r) for r in judge(pages, rules).collect()), key=str)
    assert got == sorted(((i % 7 and i, *brute(u, rules)) for i, u in enumerate(URLS + URLS[:4])), key=str)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    got = {r.page_id: tuple(r)[1:] for r in judge(pages, RULES).collect()}
    assert got == {k: brute(u, RULES) for k, u in urls.items()}
    assert {"com/", "example.com/en/", "net/es/", "net/fr/", None} <= {x[2] for x in got.values()}
    assert judge(pages.limit(0), RULES).count() == 0
