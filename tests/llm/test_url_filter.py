import random
import re
from collections import Counter

from pyspark.sql import types as T

from curator.llm import url_filter as m
from curator.llm.catalogue import RULES

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("rule", T.StringType())])
RULE = "host string, path string, verdict string"


def brute(rows, rules):
    out = Counter()
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
        fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out[i, host, path, best and best[3], best[2] if best else "allow"] += 1
    return out


def got(spark, rows, rules, **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in m.judge(pages, spark.createDataFrame(rules, RULE), **more).collect())


def test_cases_match_brute_force(spark):
    rules = [tuple(r) for r in RULES]
    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=/es/", "http://example.org/en/2", "http://org/", "http://forg/", "http://x.com/de/", "http://com/fr/é#z", "http://x.com", "ftp://example.org?x://y/", "no scheme", "", None,
            "http://example.org/e", "http://aexample.org/es/", "http://example.org:80/es/", "http://example.org./es/", "HTTP://É.ORG/", "http://a..org/x", "http:///x", "a://b://c/d", "http://x.org/a\nb", "http://example.org/es/" + "y" * 50_000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3]), (None, urls[0]), (None, None)]
    assert got(spark, rows, rules) == brute(rows, rules)


def test_random_rules_match_brute_force(spark):
    r = random.Random(0)
    host = lambda: ".".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 6)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((host(), r.choice(["", path()])) for _ in range(120))}.values())
    rows = [(i, f"http://{host()}{path()}") for i in range(400)]
    assert got(spark, rows, rules) == got(spark, rows, rules * 2, sort=7) == brute(rows, rules)


def test_empty_tables(spark):
    assert got(spark, [], [("org", "", "block")]) == Counter()
    assert got(spark, [(1, "http://a.org/")], [], default="block") == Counter({(1, "a.org", "/", None, "block"): 1})


def test_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "")], SCHEMA)
    plan = m.judge(pages, spark.createDataFrame([], RULE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string").selectExpr("*", *[f"1 as {c}" for c in ("host", "path", "rule", "key", "salt", "salts", "stack", "kind", "open", "times")])
    rules = spark.createDataFrame([("org", "/x", "block")], RULE).selectExpr("*", "1 as key", "2 as page_id")
    assert [tuple(r) for r in m.judge(pages, rules).collect()] == [(1, "a.org", "/x", "org/x", "block")]
