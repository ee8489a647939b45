from __future__ import annotations

import random
import re

from quantspark.llm import url_rules

from .helpers import FOLD

SCHEMA = "page_id long, url string"


def brute(url):
    m = re.search(r"://", url or "")
    if not m:
        return "", "", None, None
    rest = url[m.end() :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(FOLD)
    fits = [(h + p, v) for v, h, p in url_rules.DEFAULT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


URLS = [
    None,
    "",
    "no scheme",
    "http://Example.ORG/es/1",
    "https://a.example.org/en/17?x=1#y",
    "https://example.org",
    "https://notexample.org/en/1",
    "http://com/de/x",
    "http://a.com/fr/x",
    "http://a.com/fr",
    "ftp://org/",
    "x://y://org/",
    "http://ÜBER.com/de/",
    "http://a.net?q=://org/",
    "http://a.org\n/es/",
    "http://" + "a" * 20000 + ".org/",
]


def test_base_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], "clash", 1)], f"{SCHEMA}, rule string, host int")
    rows = url_rules.judge_urls(pages, spark.createDataFrame([], "url string, bad boolean")).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_mined_rules(spark):
    rows = [(f"http://site{i % 7}.net/spam/x{i}?ref={i}", True) for i in range(60)] + [(f"http://site{i % 7}.net/news/x{i}?ref={i}", False) for i in range(200)]
    rows += [(f"http://site{i % 7}.net/spam/x{i}", i % 10 != 0) for i in range(20)] + [(None, True), ("http://x.net/", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "https://site3.net/spam/new"), (2, "http://other.net/news/spam1"), (3, "http://a.org/spam/"), (4, None)], SCHEMA)
    got = {r.page_id: r for r in url_rules.judge_urls(pages, labelled, min_support=0.02).collect()}
    assert got[1].verdict == "block" and got[1].mined_rule == "path:spam"
    assert got[2].verdict == "allow" and got[4].verdict == "allow"
    assert got[3].verdict == "allow" and got[3].rule == "org/"


def test_mined_rules_are_what_counting_gives(spark):
    rows = [(f"http://s{i % 3}.net/{'bad' if i % 4 == 0 else 'good'}/{'x' if i % 5 else 'y'}", i % 4 == 0 and i % 3 != 0) for i in range(240)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    from quantspark.llm.common import Scratch

    rules = url_rules.mine_rules(labelled, Scratch(spark, "test"), min_support=0.02).collect()
    tokens = {r.url: set(r.t) for r in labelled.select("url", url_rules.url_tokens(url_rules.F.col("url")).alias("t")).collect()}
    assert rules
    for r in rules:
        hit = [bad for url, bad in rows if set(r.tokens) <= tokens[url]]
        assert abs(sum(hit) / len(hit) - r.confidence) < 1e-9 and r.confidence >= 0.6 and r.anchor in r.tokens


def test_chance_gives_no_rules_and_rules_hold_on_other_pages(spark):
    rng = random.Random(4)
    page = lambda: f"https://{rng.choice('abcdefgh')}.site{rng.randint(0, 5)}.net/{rng.choice(['news', 'shop', 'spam', 'wiki'])}/{rng.choice('uvwxyz')}?{rng.choice('pqr')}=1"
    noise = spark.createDataFrame([(page(), rng.random() < 0.25) for _ in range(100)], "url string, bad boolean")
    urls = [page() for _ in range(2000)]
    pages = spark.createDataFrame(list(enumerate(urls)), SCHEMA)
    assert url_rules.judge_urls(pages, noise).where("verdict = 'block'").count() == 0
    bad = lambda u: rng.random() < (0.9 if "/spam/" in u else 0.05)
    truth = [bad(u) for u in urls]
    learned = spark.createDataFrame([(u, bad(u)) for u in (page() for _ in range(600))], "url string, bad boolean")
    blocked = [r.page_id for r in url_rules.judge_urls(pages, learned).where("verdict = 'block'").collect()]
    right = sum(truth[i] for i in blocked)
    assert right / len(blocked) > 0.8 and right / sum(truth) > 0.7


def test_labelled_pages(spark):
    pages = spark.createDataFrame([(i, f"http://x.net/{i}", "clash") for i in (1, 2, 3, 4, 5, None)], "page_id long, url string, quality string")
    labels = spark.createDataFrame([(1, 0, None), (2, None, 0), (3, None, None), (4, 1, 0), (4, 1, 1), (None, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.url: r.bad for r in url_rules.labelled_pages(pages, labels).collect()}
    assert got == {"http://x.net/1": True, "http://x.net/2": False, "http://x.net/4": True}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "url string, bad boolean")
    assert url_rules.judge_urls(spark.createDataFrame([], SCHEMA), empty).count() == 0


def test_no_rule_is_dropped_for_the_number_of_surer_ones(spark):
    from quantspark.llm.common import Scratch

    # Eleven tokens of the surest URLs make thousands of rules, all surer than the rule of the few others.
    many = "/".join(f"word{chr(97 + i)}" for i in range(10))
    rows = [(f"http://bad/{many}", True)] * 100 + [("http://good/lone", True)] * 20 + [("http://good/fine", False)] * 280
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = {tuple(r.tokens) for r in url_rules.mine_rules(labelled, Scratch(spark, "test")).collect()}
    assert ("path:lone",) in rules and ("site:bad",) in rules
