import random
import re

from tapeworks.llm.url_filter import judge_urls

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"), ("block", "bad-host.org"), ("block", "example.com/en/7"), ("block", "a+b.org/(x")]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host, best = re.sub("[A-Z]", lambda m: m[0].lower(), host), None
    for verdict, text in RULES:
        h, slash, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (not best or len(text) > len(best[1])):
            best = verdict, text
    return host, path, best[1] if best else None, best[0] if best else "allow"


def test_rules_match_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "a.com", "EXAMPLE.com", "www.example.com", "notexample.com", "example.net", "x.example.net", "com.org", "bad-host.org", "z.bad-host.org", "a+b.org", "É.com", ""]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/72#a", "/en/8", "/de/8?x=/en/", "/de/", "/es/1", "/es", "?en/", "/(x)", "/EN/7", "/en/\n7"]
    urls = [rng.choice(["http://", "https://", "", "//", "a://b://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(500)]
    urls += [None, "", "://", "http://com/en/" + "x" * 100_000, "://com/en/ ://"]
    rows = [(i % 300, u, "h", 1) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rank int").repartition(4)
    want = sorted(((i % 300, *expected(u)) for i, u in enumerate(urls)), key=str)
    assert sorted(map(tuple, judge_urls(pages, RULES).collect()), key=str) == want
    assert {r.verdict for r in judge_urls(pages, []).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), RULES).count() == 0
