from pyspark.sql import functions as F

from boxloom.llm import url_filter
from boxloom.runtime import write_table

SCHEMA = "page_id long, url string"


def brute(url, rules, listed):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [k for k in rules if (host == k.partition("/")[0] or host.endswith("." + k.partition("/")[0])) and path.startswith(k[len(k.partition("/")[0]) :])]
    rule = max(fits, key=len) if fits else None
    if rule:
        return host, path, rule, rules[rule]
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in listed) else "allow"


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
URLS = [None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.example.net/en/1?x", "https://a.example.net/en", "https://example.net/EN/1", "x://y.net?/en/", "http://b.example.com/de/#t", "http://badexample.com/de/", "http://ads.example.com/en/", "http://q.ads.example.com", "http://é.org/fr/a", "http://a.org/fr", "a://b://c.net/", "http://x.net#/", "http://u@example.com:80/de/", "http://.net/", "http://a..net/\n/x?y"]


def rows(spark, urls, **kwargs):
    df = spark.createDataFrame(list(enumerate(urls)), SCHEMA).withColumn("rule", F.lit(1)).withColumn("key", F.lit("k"))
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, **kwargs).orderBy("page_id").collect()]


def test_rules_and_list(spark):
    listed = ["ads.example.com", "c.net"]
    want = [brute(u, RULES, listed) for u in URLS + URLS]
    assert rows(spark, URLS + URLS, rules=RULES, listed=listed) == want


def test_list_as_a_table(spark):
    listed = spark.createDataFrame([("ads.example.com",), (None,), ("c.net",), ("c.net",)], "h string")
    assert rows(spark, URLS, rules=RULES, listed=listed) == [brute(u, RULES, ["ads.example.com", "c.net"]) for u in URLS]


def test_a_list_in_shards(spark, monkeypatch):
    """Lists whose cascades would be too large are judged shard by shard; what is in no page is not held at all."""
    monkeypatch.setattr(url_filter, "MAX_BYTES", 8)
    assert url_filter.shards(0, 50) == 0 and url_filter.shards(1, 50) <= 2 < url_filter.shards(300, 400)
    listed = [f"h{i}.example.com" for i in range(0, 400, 3)] + ["c.net"]
    urls = URLS + [f"http://{'' if i % 2 else 'sub.'}h{i}.example.com/de/p" for i in range(12)]
    monkeypatch.setattr(url_filter, "shards", lambda n, universe: min(n, 3))
    assert rows(spark, urls, rules=RULES, listed=listed) == [brute(u, RULES, listed) for u in urls]


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(30_000)]
    universe = write_table(spark.createDataFrame([(k,) for k in keys], "key string"), "universe")
    # one in seven is listed, and as many keys that the corpus lacks
    listed = [*keys[::7], *(f"x{i}" for i in range(4000))]
    cascade = url_filter.Cascade.build(write_table(spark.createDataFrame([(k,) for k in listed], "key string"), "listed"), universe)
    got = {r["key"] for r in universe.where(cascade.holds(F.col("key"))).collect()}
    assert got == set(keys[::7]) and len(cascade.levels) > 4


def test_long_list(spark):
    """100,000 listed hosts, some with subdomains in the pages."""
    listed = [f"h{i}.example.com" for i in range(100_000)]
    held = set(listed)
    urls = [f"http://{'' if i % 2 else 'sub.'}h{i * 13}.example.{'com' if i % 3 else 'org'}/p" for i in range(20_000)]
    assert rows(spark, urls, rules=RULES, listed=listed) == [brute_listed(u, held) for u in urls]


def brute_listed(url, listed):
    host, path, rule, verdict = brute(url, RULES, [])
    if rule is None and any(host.split(".", n)[n] in listed for n in range(host.count(".") + 1)):
        verdict = "block"
    return host, path, rule, verdict


def test_empty(spark):
    assert rows(spark, [], rules=RULES) == []
    assert rows(spark, ["http://a.net/"], rules={}) == [("a.net", "/", None, "allow")]
    listed = spark.createDataFrame([], "h string")
    assert rows(spark, ["http://a.net/", "http://b.org/"], rules={}, listed=listed) == [("a.net", "/", None, "allow"), ("b.org", "/", None, "allow")]
