import random

from readweaver.llm import urls


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, tail = rest[:k], rest[k:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, False, None, "allow"))
    return host, path, best[3], best[4]


URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://example.com/en/",
    "http://a.b.example.com/en/1", "http://www.example.com/en/", "http://x.www.example.com/en/", "http://notexample.com/en/", "http://example.com:80/en/", "http://a.net/es/", "http://net/fr/x",
    "http://a.net/de/", "http://a.net?/es/", "http://a.net#/es/", "x://y://com/", "http://\u0130.com/", "http://com./", "http://.com/", "http://a\u0001b.com/", "http://example.com\n/en/", "ftp://www.example.com/en/a\nb?c",
]


def run(spark, rows, rules, schema="page_id long, url string, html string, host string, path string, rule string, bucket int, key string"):
    table = spark.createDataFrame([(i, u, "h", "clash", "clash", "clash", 1, "k") for i, u in rows], schema)
    return urls.filter_urls(table, urls.rule_table(spark, rules))


def test_contract_rules(spark):
    rows = list(enumerate(URLS)) + [(5, URLS[7]), (None, URLS[10])]
    got = sorted(map(tuple, run(spark, rows, urls.RULES).collect()), key=str)
    assert got == sorted([(i, *brute(u, urls.RULES)) for i, u in rows], key=str)


def test_random_nested_rules(spark):
    rng = random.Random(4)
    labels, paths = ["a", "b", "ab", "c-d", "é"], ["", "/", "/x", "/x/", "/x/y"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(host(), rng.choice(paths)): 0 for _ in range(80)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    rows = [(i, f"http://{host()}{rng.choice(paths)}{rng.choice(['', '?q', '#f', 'z'])}") for i in range(600)]
    got = {r.page_id: tuple(r)[1:] for r in run(spark, rows, rules).collect()}
    for i, u in rows:
        want = brute(u, rules)
        assert got[i][:2] == want[:2] and len(got[i][2] or "") == len(want[2] or ""), u
        assert got[i] == want


def test_empty_tables(spark):
    assert run(spark, [], urls.RULES).collect() == []


def test_oracle(spark, tmp_path):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = sorted(con.sql(urls.ORACLE_SQL).fetchall())
    assert sorted(map(tuple, urls.op1_url_filters(spark, d).collect())) == want
