import random

from quern.llm import url_filter as uf


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if a and h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    n, m, text, _ = max(f[:3] + ("",) for f in fits)
    return host, path, text, min(a for k, l, t, a in fits if (k, l, t) == (n, m, text))


ODD = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7?x=/de/", "http://a.example.com#/en/", "http://example.com?/en/", "http://example.com/en", "http://xexample.com/en/7", "ftp://Ünï.ORG/es/", "http://com/en/", "http://.com/en/1", "http://u:p@example.net:80/de/8", "a://b://c/d", "http://example.net/de/8\n/x", "http://deep.a.b.c.d.e.net/de/" + "x" * 5000]


def rows_of(frame):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in frame.collect()), key=str)


def test_against_every_rule(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "example.net", "x.example.net", "net", "org", "a.b.org", "b.org"]
    rules = [*uf.RULES, *[(rng.choice(["allow", "block"]), rng.choice(hosts), "/" + "".join(rng.choices("ab/", k=rng.randint(0, 4)))) for _ in range(25)], ("block", None, "/"), (None, "com", "/"), ("allow", "b.org", ""), ("block", "b.org", "")]
    urls = ODD + [f"http://{rng.choice(hosts)}/{''.join(rng.choices('ab/7', k=rng.randint(0, 6)))}{rng.choice(['', '?q', '#f'])}" for _ in range(300)]
    pages = [(i, u, "x", 1) for i, u in enumerate(urls)] + [(0, urls[4], "x", 1)] * 3
    frame = spark.createDataFrame(pages, "page_id long, url string, rule string, host int")
    for chosen in (rules, uf.RULES, []):
        table = spark.createDataFrame(list(chosen), "action string, host string, path string")
        assert rows_of(uf.judge(frame, table)) == sorted(((i, *plain(u, chosen)) for i, u, *_ in pages), key=str)
    assert rows_of(uf.judge(frame.where("false"), uf.rule_table(spark))) == []


def test_long_hosts_and_clashing_columns(spark):
    urls = ["http://" + "a." * 50_000 + "com/en/1", "http://" + "x" * 100_000 + ".net/de/1", "http://" + "." * 2_000 + "org/es/", "http://a.b.com./en/", "http://b.org"]
    names = ["page_id", "url", "h", "p", "best", "suffix", "n", "rule_path", "odd`name", "host"]
    frame = spark.createDataFrame([(i, u, *["x"] * 8) for i, u in enumerate(urls)], "page_id long, url string, h string, p string, best string, suffix string, n string, rule_path string, `odd``name` string, host string")
    got = uf.judge(frame, uf.rule_table(spark))
    assert got.columns == [*names[:-1], "host", "path", "rule", "verdict"]
    assert rows_of(got) == sorted(((i, *plain(u, uf.RULES)) for i, u in enumerate(urls)), key=str)
    assert all(r.h == "x" and r.p == "x" for r in got.collect())
