import random
from collections import Counter

import pytest

from cyclecast.llm import common, urlrules

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def slow(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c < "\x7f" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h + p), len(h), v)
            best = max(best or rank, rank)
            if best == rank:
                name = h + p
    return host, path, name if best else None, best[2] if best else default


def urls(n=400):
    rnd = random.Random(6)
    hosts = ["example.org", "blog.example.org", "a-b.example.org", "EXAMPLE.com", "x.com", "com", "notorg", "org", "example.org.net", ".org", "org.", "a..org", "é.org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/a/b", "/de/", "/deutsch", "/EN/1"]
    ends = ["", "?q=://x.org/es/", "#/es/", "?", "/"]
    made = [f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(ends)}" for _ in range(n)]
    return [*made, None, "", "no scheme", "://", "http:///es/", "a\n://example.org/es/\nx", "http://example.org/es/" + "x" * 50000, *["http://hot.example.org/es/1"] * 300]


@pytest.mark.parametrize("rules", [RULES, [], [*RULES, ("org", "/es/deep/long/path", "allow"), ("b.example.org", "/", "block"), ("org", "/", "block"), ("com", "", "block"), ("example.org", "/es/x", "allow"), ("", "", "allow")]])
def test_matches_brute_force(spark, rules):
    common.prepare(spark)
    data = [(i, u, "x", 1) for i, u in enumerate(urls())]
    pages = spark.createDataFrame(data, "page_id long, url string, rule string, part int").repartition(3)
    given = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    for n in (1, 7):
        got = urlrules.judge(pages, given, partitions=n)
        assert got.columns == ["page_id", "url", "rule", "part", "host", "path", "_rule", "verdict"]
        found = Counter((r.page_id, r.host, r.path, r._rule, r.verdict) for r in got.collect())
        assert found == Counter((i, *slow(u, rules)) for i, u, _, _ in data)


def test_empty_table_and_repeated_rows(spark):
    common.prepare(spark)
    given = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None)], "page_id long, url string")
    assert urlrules.judge(pages.limit(0), given).count() == 0
    assert sorted(str(r.rule) for r in urlrules.judge(pages, given).collect()) == ["None", "org/", "org/"]
