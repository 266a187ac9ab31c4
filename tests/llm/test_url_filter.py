from __future__ import annotations

import random

import pytest
from helpers import clashing, rows_of

from factloom.llm import url_filter as op
from factloom.operators import skew

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("example.org", "/a/b", "block"), ("example.org", "", "allow"), ("dup.org", "/x", "allow"), ("dup.org", "/x", "block"),
    ("", "/", "block"), ("com", None, "block"), (None, "/", "block"), ("com", "en", "block"), ("org", "/a/", None),
]


def parse(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def judge(url, rules):
    host, path = parse(url)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if h and p is not None and v and (p == "" or p[0] == "/") and path.startswith(p)
        and (host == h or host.endswith("." + h))
    ]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else "allow")


URLS = [
    None, "", "no scheme", "http://", "http://WWW.Example.com/en/x?q=/es/", "http://example.com/en", "https://Example.COM/en/",
    "ftp://a.net/es/1#t", "http://net/es/", "http://xnet/es/", "http://example.org/a/bcd", "http://example.org", "x://y://z.com/",
    "http://dup.org/xy", "http://.com/", "http://com./", "http://É.com/", "http://user@a.com:80/p\nq", "http://a.com?x", "://com/",
    "http://example.org/" + "/" * 20_000, "http://" + "a." * 20_000 + "com/en/",
]


def expected(rows, rules):
    return sorted(((i, *judge(u, rules)) for i, u in rows), key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(skew, "ROWS_PER_SPLIT", 5)
    draw = random.Random(3)
    hosts, paths = ["com", "example.com", "www.example.com", "a.net", "example.org"], ["", "/", "/en/", "/es/x", "/a/b/c"]
    made = [f"http://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(100)]
    rows = list(enumerate(URLS + made)) + [(None, "http://a.com/"), (3, "http://com/"), (3, "http://com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert rows_of(op.judge_urls(clashing(pages), rules)) == expected(rows, RULES)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    none = rules.where("false")
    assert rows_of(op.judge_urls(pages, none, default="block")) == [(1, "a.com", "/x", None, "block")]
    assert rows_of(op.judge_urls(pages.where("false"), rules)) == []


def test_no_python_on_the_main_path(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame(RULES[:4], "host string, path string, verdict string")
    plan = op.judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
