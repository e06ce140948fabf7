from pyspark.sql import functions as F

from skimmer.llm import urls

PAGES = "page_id long, url string, html string"


def test_host_and_path(spark):
    cases = {None: ("", ""), "": ("", ""), "no scheme": ("", ""), "http://A.Example.COM/X/y?q#f": ("a.example.com", "/X/y"), "x://h?q/": ("h", ""), "x://h#f/": ("h", ""), "x://": ("", ""), "a://b://c/d": ("b:", "//c/d"), "http://ÉÀ.fr/": ("ÉÀ.fr", "/")}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r[0]: (r[1], r[2]) for r in df.select("url", *urls.host_and_path(F.col("url"))).collect()}
    assert got == cases


def test_rules(spark):
    cases = {"http://x.com/": "com/", "http://com/a": "com/", "http://example.com/en/1": "example.com/en/", "http://m.example.com/en/1": "example.com/en/", "http://www.example.com/en/1": "www.example.com/en/", "http://a.www.example.com/en/": "www.example.com/en/", "http://x.net/es/": "net/es/", "http://x.net/es": None, "http://x.com": None, "http://xcom/": None, "http://x.net/de/": None}
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], PAGES)
    got = {r["page_id"]: r["rule"] for r in urls.judged(df, urls.UrlParams()).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def brute(pages, p):
    """Dense walks over dictionaries."""
    links, rows = {}, []
    for host, ruled, targets in pages:
        rows.append((host, ruled))
        for t in set(targets):
            links[host, t] = links.get((host, t), 0) + 1

    def walk(edges, verdict):
        seeds = [h for h, r in rows if r == verdict]
        start = {h: seeds.count(h) / len(seeds) for h in set(seeds)}
        out, now = {}, start
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        for _ in range(p.rounds):
            new = {h: (1 - p.damping) * s for h, s in start.items()}
            for (a, b), n in edges.items():
                new[b] = new.get(b, 0) + p.damping * now.get(a, 0) * n / out[a]
            now = new
        return now

    return walk(links, "allow"), walk({(b, a): n for (a, b), n in links.items()}, "block")


def test_propagation(spark):
    data = [
        (0, "http://good.com/1", "good.com", "allow", ["mid.org", "good.com"], '<a href="http://Mid.org/x">x</a> <a href=/rel>y</a> <a href="//mid.org">z</a>'),
        (1, "http://mid.org/2", "mid.org", None, ["far.org"], "<a class=b HREF='https://far.org?x'>"),
        (2, "http://far.org/", "far.org", None, [], None),
        (3, "http://fan.org/", "fan.org", None, ["bad.net"], '<a href="http://bad.net/es/1">'),
        (4, "http://bad.net/es/1", "bad.net", "block", ["mid.org"], '<link href="http://mid.org/">'),
        (5, "http://bad.net/de/1", "bad.net", None, [], ""),
        (6, "http://alone.org/", "alone.org", None, [], "<p data-href='x'>"),
        (7, None, "", None, [], '<a href="http://mid.org/">'),
    ]
    df = spark.createDataFrame([(i, u, h) for i, u, _, _, _, h in data], PAGES).withColumn("host", F.lit("clash"))
    df = df.unionByName(df.where("page_id = 3"))
    p = urls.UrlParams()
    trust, distrust = brute([x[2:5] for x in [*data, data[3]] if x[2]], p)
    rows = urls.filter_urls(df, p).collect()
    assert len(rows) == 9
    for r in rows:
        t, d = trust.get(r["host"], 0), distrust.get(r["host"], 0)
        assert abs(r["trust"] - t) < 1e-9 and abs(r["distrust"] - d) < 1e-9
        ruled = data[r["page_id"]][3]
        assert r["verdict"] == (ruled or ("block" if round(d, 12) > round(t, 12) else "allow"))
    got = {r["page_id"]: r["verdict"] for r in rows}
    assert got == {0: "allow", 1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}


def test_nothing(spark):
    assert urls.digest(spark.createDataFrame([], PAGES)).count() == 0
