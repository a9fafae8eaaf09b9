"""URL lists over time against a plain walk through the entries."""

import datetime as dt
import random

from siftline.llm.url_lists import judge, url_patterns
from pyspark.sql import functions as F

DAY = dt.date(2024, 1, 1)


def covers(pattern, host, path):
    phost, slash, rest = pattern.partition("/")
    rest = slash + rest
    if not (host == phost or host.endswith("." + phost)):
        return False
    return rest in ("", path) or (rest.endswith("/") and path.startswith(rest))


def brute(captures, entries):
    order = {"block": 2, "allow": 1}
    out = []
    for i, url, at in captures:
        best = None
        if url and "://" in url and at:
            rest = url.split("://", 1)[1]
            host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
            path = "/" + rest.partition("/")[2].split("?")[0].split("#")[0] if "/" in rest.split("?")[0].split("#")[0] else ""
            for pattern in {p for p, s, _ in entries if p and s}:
                past = [(s, order.get(a, 0)) for p, s, a in entries if p == pattern and s and s <= at]
                if past and max(past)[1] and host and covers(pattern, host, path):
                    action = "block" if max(past)[1] == 2 else "allow"
                    best = max(best or (0, "", ""), (len(pattern), action, pattern))
        out.append((i, at, best and best[2], best and best[1], bool(best) and best[1] == "block"))
    return sorted(out, key=repr)


def test_judged_as_of_fetch_time(spark):
    rng = random.Random(1)
    hosts = ["a.com", "www.a.com", "b.a.com", "x.org", "co.uk", "p.co.uk"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/en/1/2?q=/fr/", "/fr/x#/en/"]
    patterns = hosts + ["com", "a.com/", "a.com/en/", "www.a.com/en/1", "x.org/en", "p.co.uk/fr/"]
    entries = [(rng.choice(patterns), DAY + dt.timedelta(rng.randrange(30)), rng.choice(["block", "allow", "remove", None])) for _ in range(120)]
    entries += [(None, DAY, "block"), ("a.com", None, "block")] + entries[:5]
    captures = [(i, f"https://{rng.choice(hosts)}{rng.choice(paths)}", DAY + dt.timedelta(rng.randrange(40))) for i in range(400)]
    captures += [(900, None, DAY), (901, "", DAY), (902, "no scheme", DAY), (903, "http://A.com./en/1", dt.date(2024, 2, 1)), (904, "http://u@www.a.com:80", None)]
    captures += [(905, "http://evila.com/", dt.date(2024, 2, 1)), (None, "http://x.org", dt.date(2024, 2, 1)), (1, "http://x.org", dt.date(2024, 2, 1)), (906, "http://a.com/" + "d/" * 300, dt.date(2024, 2, 1))]
    pages = spark.createDataFrame([(*c, "x", 1) for c in captures], "page_id long, url string, fetched date, pattern string, _row int")
    lists = spark.createDataFrame([(*e, "y") for e in entries], "pattern string, since date, action string, url string")
    got = [tuple(r) for r in judge(pages, lists, "page_id").collect()]
    assert sorted(got, key=repr) == brute(captures, entries)
    assert sum(r[4] for r in got) > 40


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com", DAY)], "page_id long, url string, fetched date")
    lists = spark.createDataFrame([("a.com", DAY, "block")], "pattern string, since date, action string")
    assert [tuple(r) for r in judge(pages, lists.where("false"), "page_id").collect()] == [(1, DAY, None, None, False)]
    assert judge(pages.where("false"), lists, "page_id").collect() == []


def test_patterns(spark):
    row = spark.range(1).select(url_patterns(F.lit("http://w.a.com/x/y?z"))).first()[0]
    assert row == [d + p for d in ("w.a.com", "a.com", "com") for p in ("", "/", "/x/", "/x/y")]
