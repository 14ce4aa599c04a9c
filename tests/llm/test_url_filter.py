import re

from orbitmill.llm import url_filter as u

from .conftest import as_set

URLS = [
    "http://a.example.com/en/7", "https://EXAMPLE.com/en/8?x=1", "http://example.net/de/81", "http://x.example.net/de/9#top", "http://org/es/", "http://notorg/es/",
    "ftp://b.org/es", "no scheme", None, "", "http://", "http:///en/", "http://com?/en/", "http://com/en/", "http://ÄB.Example.COM/en/7/ü", "http://a.b.c.example.com:80/en/71",
    "x://y?u=http://com/en/", "http://example.com/EN/7", "http://a.example.com/en/7", "http://" + "sub." * 300 + "net/de/" + "p" * 5000,
]
PAGES = [(k // 2 if k % 5 else None, url, None) for k, url in enumerate(URLS)]


def judge(url, rules, unlisted="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else unlisted


def check(spark, make_pages, rules):
    got = as_set(u.url_verdicts(make_pages(PAGES), u.rule_table(spark, rules)), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([(i, *judge(url, rules)) for i, url, _ in PAGES], key=repr)


def test_contract_rules(spark, make_pages):
    check(spark, make_pages, u.RULES)


def test_ties_repeats_and_clashes(spark, make_pages):
    check(spark, make_pages, [("allow", "com", "/en/"), ("block", "com", "/en/"), ("block", "net", ""), ("allow", "example.com", "/en/"), ("block", "it's", "/\\")])


def test_many_rules_and_none(spark, make_pages):
    check(spark, make_pages, [("block", f"site{i}.net", f"/{i}/") for i in range(300)] + u.RULES)
    check(spark, make_pages, [])


def test_beyond_the_broadcast(spark, make_pages, monkeypatch):
    monkeypatch.setattr(u, "MOST_BLOCKS", 0)
    monkeypatch.setattr(u, "MOST_RULES", 0)
    check(spark, make_pages, u.RULES)


def test_empty_table(spark, make_pages):
    assert u.url_verdicts(make_pages([]), u.rule_table(spark, u.RULES)).count() == 0


def test_plan_has_no_python(spark, make_pages):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = u.url_verdicts(pages, u.rule_table(spark, u.RULES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|RDD", plan)
