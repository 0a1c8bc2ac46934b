import random

import pytest

from lanewise.llm.url_rules import judge_urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0] + [len(rest)])
    tail = rest[cut:]
    end = min([i for c in "?#" if (i := tail.find(c)) >= 0] + [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def judged(url, rules):
    host, path = split(url)
    fits = [(len(h) + len(p or ""), len(h), a == "block", h + (p or ""), a) for h, p, a in rules
            if h is not None and a is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("example.com", "/d", "allow"), ("a.example.com", "", "block"), ("example.com", None, "block"), ("org", "/fr/", "block"),
         (None, "/", "block"), ("x.org", "/a/b/c", "allow"), ("", "/q", "block")]


@pytest.mark.parametrize("rules", [RULES, RULES[:4], []])
def test_equals_brute_force(spark, rules):
    rng = random.Random(4)
    hosts = ["net", "example.net", "www.Example.NET", "badexample.net", "example.com", "a.example.com", "b.a.example.com", "org", "x.org", "", ".org", "org."]
    paths = ["", "/", "/en/", "/en", "/de/x", "/d", "/fr/a?b=/fr/", "/a/b/c", "/a/b/cd/e", "?x=1/2", "#f/g", "/fr/\nnext", "//", "/q", "/é/😀"]
    urls = [f"{s}://{h}{p}" for s in ("http", "ftp") for h in hosts for p in paths]
    urls += [None, "", "no scheme", "://net/", "http://net://org/fr/", "http:/net/", "http://org" + "/fr" * 4000 + "/", "http://" + "a." * 3000 + "net/"]
    rows = [(rng.choice([None, i]), u, "html", "k") for i, u in enumerate(urls)] + [(5, "http://net/", None, None)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = sorted((tuple(r) for r in judge_urls(pages, table, "page_id", "url").collect()), key=repr)
    assert got == sorted(((i, *judged(u, rules)) for i, u, *_ in rows), key=repr)
    assert judge_urls(pages.limit(0), table, "page_id", "url").count() == 0
