"""The URL filter against a scan of all rules."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import urls

SCHEMA = "page_id long, url string"
RULES = "action string, host string, path string"


def plain(url, rules):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1], found[2]) if found else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (-len(h + p), a != "block", h + p, a)
        for a, h, p in rules
        if None not in (a, h, p) and host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *((min(fits)[2], min(fits)[3]) if fits else (None, "allow")))


def judged(spark, pages, rules):
    frame = spark.createDataFrame(pages, SCHEMA).withColumns({"host": F.lit(1), "rule": F.lit("old"), "extra": F.lit("x")})
    out = urls.judge(frame, spark.createDataFrame(rules, RULES))
    assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    return sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=repr)


def test_against_a_scan_of_all_rules(spark):
    rng = random.Random(4)
    labels, folders = ["a", "b", "net", "É", ""], ["x", "y", "xy", "", "é"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    path = lambda n: "".join("/" + rng.choice(folders) for _ in range(n))
    pages = [(i, f"http://{host(rng.randint(1, 4)).upper()}{path(rng.randint(0, 4))}{rng.choice(['', '?q=/x/', '#/y'])}") for i in range(400)]
    odd = [None, "", "no scheme/x", "://", "a://", "ftp://net", "x://y://net/", "http://NET/x\ny/", "http://.net/", "http://net./x", "http://a.net?/x/", "http://a.net"]
    pages += [(1000 + i, u) for i, u in enumerate(odd)] + [(7, "http://a.net/x/"), (7, "http://a.net/x/"), (None, "http://b.net/y")]
    rules = [(rng.choice(["block", "allow"]), host(rng.randint(1, 3)), path(rng.randint(0, 3)) + rng.choice(["", "/"])) for _ in range(120)]
    rules += [("block", "net", "/x"), ("allow", "net", "/x"), ("allow", "net", "/x"), ("block", "a.net", ""), ("allow", "net", "/x/"), (None, "b", "/"), ("block", None, "/"), ("block", "b", None)]
    got = judged(spark, pages, rules)
    assert got == sorted(((i, u, *plain(u, rules)) for i, u in pages), key=repr)
    assert {r[5] for r in got} == {"block", "allow"} and any(r[4] is None and r[2] for r in got)


def test_equally_long_rules(spark):
    rules = [("allow", "b.net", "/x"), ("block", "net", "/x/y"), ("allow", "net", "/x/y")]
    assert judged(spark, [(1, "http://a.b.net/x/y")], rules)[0][4:] == ("net/x/y", "block")
    assert judged(spark, [(1, "http://a.b.net/x/z")], rules)[0][4:] == ("b.net/x", "allow")


def test_empty_tables_and_deep_paths(spark):
    deep = "http://" + "s." * 30 + "net/" + "f/" * 400
    assert judged(spark, [(1, deep)], [("block", "net", "/" + "f/" * 399), ("allow", "net", "/f/")])[0][5] == "block"
    pages = spark.createDataFrame([(1, deep)], SCHEMA)
    assert urls.judge(pages, urls.rule_table(spark).limit(0)).select("rule", "verdict").collect() == [(None, "allow")]
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).collect() == []
