import collections
import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import url_rules as U

URLS = [
    "http://A.Example.NET/en/x", "http://net", "http://net/", "https://foo.net/a?b=c", "https://notnet/", "http://example.net/en", "http://x.example.com/de/1#f", "http://example.com/deep", "http://org/fr/", "http://a.org/fr/z?q",
    "http://a.org/en/", None, "", "no scheme.net/", "://", "http://user@x.net:80/p", "http://x.com?y=/de/", "ftp://É.net/ü", "a://b.org/fr/?u=http://c.net/", "http://x.net/a\nb?c",
]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, verdict) for verdict, h, p in U.EXPLICIT if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
    return host, path, rule, verdict


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([*enumerate(URLS), (3, URLS[3])], "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS tokens", "'y' AS verdict")


def test_explicit_rules(spark, pages, folder):
    rows = U.op5_url_rules(spark, folder(pages=pages)).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = by_hand(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
        if not host:
            assert r["verdict"] == "allow"
    assert U.op5_url_rules(spark, folder(pages=pages.where("false"))).collect() == []


def test_mined_rules_decide_the_rest(spark):
    labelled = [(f"http://s{i}.net/casino/win{i}", i) for i in range(40)] + [(f"http://h{i}.example.net/en/news", 100 + i) for i in range(40)]
    other = [("http://other.com/casino/win7", 500), ("http://other.com/news", 501), ("http://other.com/cats", 502)]
    rows = {r["page_id"]: r for r in U.judge(spark.createDataFrame(labelled + other, "url string, page_id long")).collect()}
    assert rows[500]["verdict"] == "block" and rows[500]["mined"] in ("path:casino", "path:win0")
    assert rows[501]["verdict"] == "allow" and "path:news" in rows[501]["mined"]
    assert rows[502]["mined"] is None or "cats" not in rows[502]["mined"]


def mined_by_hand(items, support, confidence, longest=3):
    rows = sorted({(tuple(sorted(set(t))), v) for t, v in items if v is not None})
    least = max(1, math.ceil(support * len(rows)))
    n = collections.Counter(c for t, _ in rows for k in range(1, longest + 1) for c in itertools.combinations(t, k))
    with_ = collections.Counter((c, v) for t, v in rows for k in range(1, longest + 1) for c in itertools.combinations(t, k))
    rules = {(c, v): (m / n[c], m / len(rows)) for (c, v), m in with_.items() if m >= least and m / n[c] >= confidence}
    return {k: x for k, x in rules.items() if not any(rules.get((k[0][:i] + k[0][i + 1 :], k[1]), (0,))[0] >= x[0] for i in range(len(k[0]) if len(k[0]) > 1 else 0))}


def test_rules_against_counting(spark):
    rng = random.Random(14)
    items = [(["a", "b"], "block"), (["a", "b", "c"], "block"), (["a"], "allow"), (["b", "c"], "block"), (["c"], "allow"), (["a", "b"], "block"), (["d"], None)]
    drawn = []
    for _ in range(150):
        t = rng.sample("abcdefgh", rng.randint(1, 6))
        drawn.append((t, "block" if {"a", "b"} <= {*t} or ("c" in t and rng.random() < 0.7) else rng.choice(["allow", "allow", "block"]) if "h" in t else "allow"))
    for rows, support, confidence in ((items, 0.1, 0.7), (drawn, 0.03, 0.8), (drawn, 0.2, 0.5)):
        found = {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["support"]) for r in U.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), support, confidence).collect()}
        assert found == {k: tuple(map(pytest.approx, x)) for k, x in mined_by_hand(rows, support, confidence).items()}


def test_long_repeated_urls_are_mined_in_bounded_time(spark):
    parts = "/".join(f"{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(40))
    urls = [f"http://s.net/{parts}"] * 200 + [f"http://u{'xyz'[i % 3] * (1 + i)}.net/{parts}/{'p' * i}" for i in range(100)] + [f"http://example.net/en/{'q' * i}" for i in range(60)] + [f"http://elsewhere.com/{parts}", "http://elsewhere.com/" + "long/" * 50_000]
    began = time.monotonic()
    rows = U.judge(spark.createDataFrame([*enumerate(urls)], "page_id long, url string")).collect()
    assert time.monotonic() - began < 120 and len(rows) == len(urls)
    assert {r["verdict"] for r in rows if r["page_id"] == 360} == {"block"}


def test_each_url_gets_its_best_rule(spark):
    """Rules looked up by the index against trying every rule on every URL."""
    docs = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = docs.select("page_id", "url").withColumn("host", U.host_of(F.col("url"))).withColumn("path", U.path_of(F.col("url")))
    rows = rows.withColumn("by", U.explicit_rule(F.col("host"), F.col("path"), U.EXPLICIT)).withColumn("tokens", U.tokens(F.col("url"), F.col("host"), F.col("path"))).collect()
    rules = mined_by_hand([(r["tokens"], r["by"]["verdict"]) for r in rows if r["by"]], U.SUPPORT, U.CONFIDENCE)
    want = {}
    for r in rows:
        fits = [(c, s, v, " ".join(t)) for (t, v), (c, s) in rules.items() if {*t} <= {*r["tokens"]}]
        want[r["page_id"]] = (r["by"]["verdict"], None) if r["by"] else max(fits)[2:] if fits and r["host"] else ("allow", None)
    found = {r["page_id"]: (r["verdict"], r["mined"]) for r in U.judge(docs).collect()}
    assert found == want and len({v for v, _ in found.values()}) == 2
