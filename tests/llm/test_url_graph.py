import numpy as np
import pytest

from pelagos.llm import url_graph as u


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.com/en/7x?q#f", "https://b.com/en/8", "x.com/en/", None, "s://org", "s://example.net/de/81", "s://q.net/de/9", "s://notcom/en/", "s://a.org:80/es/", ""]
    pages = spark.createDataFrame([(i, x, None) for i, x in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(pages).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("b.com", "/en/8", "com/en/", "block")
    assert got[2][:3] == ("", "", None) and got[3] == ("", "", None, "allow") and got[9] == ("", "", None, "allow")
    assert got[4][:3] == ("org", "", None)
    assert got[5][2:] == ("example.net/de/8", "block") and got[6][2:] == ("net/de/", "allow") and got[7][2] is None and got[8][2] is None


def test_spread_against_dense_iteration(spark):
    rng = np.random.default_rng(2)
    n, steps = 12, 400
    edges = [(f"h{a}", f"h{b}", int(rng.integers(1, 4))) for a in range(n) for b in range(n) if a != b and rng.random() < 0.25]
    seeds = [(f"h{i}", float(rng.random() < 0.4)) for i in range(n)]
    frame, seed = spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, seed double")
    for a, b in (("src", "dst"), ("dst", "src")):
        got = {r.host: r.score for r in u.spread(seed, frame, a, b, 0.85, 1e-13).collect()}
        m = np.zeros((n, n))
        for x, y, w in edges:
            x, y = (x, y) if a == "src" else (y, x)
            m[int(y[1:]), int(x[1:])] += w
        m = m / np.maximum(m.sum(0), 1e-300)
        base = 0.15 * np.array([s for _, s in seeds])
        score = base.copy()
        for _ in range(steps):
            score = base + 0.85 * m @ score
        assert all(abs(got.get(f"h{i}", 0) - score[i]) < 1e-12 for i in range(n))


def test_links_spread_verdicts(spark, same):
    link = lambda *hosts: " ".join(f"<a HREF='http://{h}/x'>" for h in hosts)
    rows = [(1, "http://bad.com/en/1", ""), (2, "http://friend.biz/a", link("bad.com", "bad.com")), (3, "http://good.net/de/1", link("neutral.biz")), (4, "http://neutral.biz/", link("neutral.biz")), (4, "http://neutral.biz/", None), (5, "http://bad.com/fr", None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = u.judge(pages).toPandas()
    verdict = dict(zip(got.page_id, got.verdict, strict=True))
    assert verdict == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block"} and len(got) == 6
    scores = {r.host: (r.trust, r.distrust) for r in got.itertuples()}
    assert scores["neutral.biz"][0] > 0 and scores["friend.biz"][1] > 0
    import duckdb

    c = duckdb.connect()
    c.register("pages", pages.select("page_id", "url", "html").toPandas())
    same(got[["page_id", "host", "path", "rule", "verdict"]], c.execute(u.oracle()).df())


def test_long_chains_settle(spark):
    """A host forty links away from the only seed has its score, and a graph that has not settled is an error."""
    frame = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(40)], "src string, dst string, n long")
    seed = spark.createDataFrame([("h0", 1.0)], "host string, seed double")
    got = {r.host: r.score for r in u.spread(seed, frame, "src", "dst", 0.85, 1e-9).collect()}
    assert all(abs(got[f"h{i}"] - 0.15 * 0.85**i) < 1e-12 for i in range(41))
    with pytest.raises(RuntimeError):
        u.spread(seed, frame, "src", "dst", 0.85, 1e-9, most_rounds=8)


def test_very_long_html(spark):
    page = "".join(f"<p>text {i}</p><a href='https://h{i % 500}.org/{i}'>x</a>" for i in range(60_000))
    edges = {r.dst: r.n for r in u.host_edges(spark.createDataFrame([(1, "http://a.com/", page)], "page_id long, url string, html string")).collect()}
    assert len(edges) == 500 and set(edges.values()) == {120}


def test_empty(spark):
    assert u.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
