import random
import re

from quillspan.llm import urlfilter


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_against_brute_force(spark):
    r = random.Random(6)
    labels = ["com", "net", "example", "www", "Blog", "a", "b", "ab"]
    name = lambda: ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))
    rules = list({(name().lower(), r.choice(["/", "", "/en/", "/e", "/en/x"])): r.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [None, "", "no scheme", "://", "http://", "http://com", "x://com?q", "http://COM/en/?a#b", "http://a.com#/en/", "http://evilexample.com/en/", "http://com./en/", "http://..com/"]
    urls += [f"{r.choice(['http', 'https'])}://{name()}{r.choice(['', '/', '/en/', '/en/x?y=/fr/', '/es/1#t', '?q=://com/'])}" for _ in range(2500)]
    urls += ["http://www.example.com/en/1"] * 1500
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(7, urls[7], "again"), (None, urls[7], "x")], "page_id long, url string, host string").repartition(6)
    table = spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    for ranges in (1, 9):
        got = urlfilter.judge_urls(pages, table, ranges=ranges).collect()
        assert sorted([tuple(x) for x in got], key=str) == sorted([(i, *brute(u, rules)) for i, u in [*enumerate(urls), (7, urls[7]), (None, urls[7])]], key=str)
    assert urlfilter.judge_urls(pages.limit(0), table).count() == 0
    assert {x.verdict for x in urlfilter.judge_urls(pages, table.limit(0), default="block").collect()} == {"block"}
