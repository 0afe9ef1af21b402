import random

import pytest

from corpusloom.plans.config import CrawlConfig, keyword_list
from corpusloom.plans.crawl import Crawler, link_view, media_view, pretty_json, sorted_by, stats, write_json, write_markdown
from corpusloom.plans.traverse import bfs, traverse, walk, walk_with_hooks
from corpusloom.sources import fetch, sitemap
from corpusloom.streaming.pages import domain_counts, page_stream, process_stream

O = "https://site.test"  # noqa: E741


def graph(spark, links, missing=()):
    pages = [p for p in {*links, *(x for v in links.values() for x in v)} if p not in missing]
    nodes = spark.createDataFrame([(O + p,) for p in pages], "url string")
    edges = [(O + s, O + d, i, "internal") for s, v in links.items() for i, d in enumerate(v)]
    return nodes, spark.createDataFrame(edges, "src string, dst string, ordinal int, kind string")


def order(df):
    return [(r.url[len(O) :], r.depth, r.success) for r in df.orderBy("visit").collect()]


TREE = {"/": ["/a", "/b"], "/a": ["/a1", "/a2"], "/b": ["/b1", "/a1"], "/a1": ["/deep"]}


def test_orders(spark):
    n, e = graph(spark, TREE, missing=("/b",))
    start = (O + "/",)
    assert order(bfs(n, e, CrawlConfig(start))) == [("/", 0, True), ("/a", 1, True), ("/b", 1, False), ("/a1", 2, True), ("/a2", 2, True)]
    assert [u for u, _, _ in order(traverse(n, e, CrawlConfig(start, strategy="dfs", max_depth=3)))] == ["/", "/a", "/a1", "/deep", "/a2", "/b"]
    best = traverse(n, e, CrawlConfig(start, strategy="best-first", max_depth=3, keywords=("b", "2")))
    assert [u for u, _, _ in order(best)] == ["/", "/b", "/a", "/a2", "/a1", "/deep"]
    many = walk(n, e, {"x": CrawlConfig(start, strategy="dfs", max_depth=1), "y": CrawlConfig((O + "/a",), strategy="best-first", max_depth=1)})
    assert {(r.crawl_id, r.url[len(O) :]) for r in many.collect()} == {("x", "/"), ("x", "/a"), ("x", "/b"), ("y", "/a"), ("y", "/a1"), ("y", "/a2")}


def sequential(links, missing, seeds, max_depth, cap):
    """A plain level-by-level crawl, one page at a time."""
    visited, level, out, n, depth = set(seeds), [(s, None) for s in seeds], [], 0, 0
    while level and n < cap:
        nxt = []
        for url, parent in level:
            ok = url not in missing
            out.append((url, depth, parent, ok))
            if not ok:
                continue
            n += 1
            if depth + 1 > max_depth or n >= cap:
                continue
            found = []
            for d in links.get(url, []):
                if d not in visited:
                    visited.add(d)
                    found.append(d)
            nxt += [(d, url) for d in found[: cap - n]]
        level, depth = nxt, depth + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bfs_against_sequential(spark, seed):
    rng = random.Random(seed)
    names = [f"/{i}" for i in range(14)]
    links = {p: rng.sample(names, rng.randint(0, 4)) for p in names}
    missing = {p for p in names[1:] if rng.random() < 0.2}
    cap = rng.choice([3, 6, 100])
    n, e = graph(spark, links, missing)
    got = [(r.url[len(O) :], r.depth, r.parent_url and r.parent_url[len(O) :], r.success) for r in bfs(n, e, CrawlConfig((O + "/0",), max_depth=3, max_pages=cap)).orderBy("visit").collect()]
    assert got == sequential(links, missing, ["/0"], 3, cap)


def test_resume_and_cancel(spark, tmp_path):
    n, e = graph(spark, TREE)
    c = CrawlConfig((O + "/",), max_depth=3)
    calls = []
    bfs(n, e, c, checkpoint=str(tmp_path / "c"), should_cancel=lambda: calls.append(1) or len(calls) > 1)
    seen = []
    assert order(bfs(n, e, c, checkpoint=str(tmp_path / "c"), on_progress=seen.append)) == order(bfs(n, e, c))
    assert seen and seen[0]["depth"] == 2
    assert bfs(n, e, c, should_cancel=lambda: True).count() == 0


def test_strict_cap(spark):
    n, e = graph(spark, {"/": ["/1", "/2", "/3"], "/1": ["/4"]})
    assert len(order(bfs(n, e, CrawlConfig((O + "/",), max_pages=2, cap_mode="strict")))) == 2


def test_config():
    for bad in ({"strategy": "x"}, {"max_depth": -1}, {"max_pages": "7"}, {"cap_mode": "y"}):
        with pytest.raises(ValueError):
            CrawlConfig((O,), **bad)
    with pytest.raises(ValueError):
        CrawlConfig(("",))
    assert keyword_list("a, b  c") == ("a", "b", "c")


@pytest.mark.parametrize("strategy", ["dfs", "best-first"])
def test_walk_hooks(spark, tmp_path, strategy):
    rng = random.Random(4)
    names = [f"/p{i}" for i in range(40)]
    links = {n: rng.sample(names, 4) for n in names}
    n, e = graph(spark, links, missing=names[5:9])
    c = CrawlConfig((O + "/p0",), strategy=strategy, max_depth=6, max_pages=25, keywords=("3", "7"), batch=3)
    want = traverse(n, e, c).orderBy("visit").collect()
    assert len(want) >= 20
    for step in (1, 7):
        got = walk_with_hooks(n, e, c, on_progress=lambda x: None, step=step).orderBy("visit").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]
    calls, seen = [], []
    at = str(tmp_path / strategy)
    part = walk_with_hooks(n, e, c, seen.append, lambda: calls.append(1) or len(calls) > 2, at, step=6).orderBy("visit").collect()
    assert 12 <= len(part) < len(want) and part == want[: len(part)] and seen[0]["queued"] > 0 and seen[1]["pages_crawled"] > seen[0]["pages_crawled"]
    assert walk_with_hooks(n, e, c, checkpoint=at, step=6).orderBy("visit").collect() == want
    assert traverse(n, e, c, should_cancel=lambda: True).count() == 0


def test_bfs_needs_no_single_task_for_a_level(spark):
    n, e = graph(spark, TREE)
    plan = bfs(n, e, CrawlConfig((O + "/",)))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_crawl_job(spark):
    pages = spark.createDataFrame([(O + "/", "<a href='/a'>a</a>"), (O + "/a", "<a href='/b'>b</a>"), (O + "/b", "<p>end</p>")], "url string, html string")
    maps = spark.createDataFrame([(O + "/sitemap.xml", f"<urlset><url><loc>{O}/b</loc></url><url><loc>{O}/a</loc></url></urlset>")], "url string, body string")
    crawler = Crawler(spark, pages, maps)
    config = crawler.seeded(O + "/", max_depth=0)
    assert config.start_urls == (O + "/b", O + "/a")
    job = crawler.start(config)
    assert [r.url for r in job.wait().orderBy("visit").collect()] == [O + "/b", O + "/a"]
    assert job.status()["state"] == "done"
    job.clear()
    assert job.wait().count() == 0
    gone = crawler.start(CrawlConfig((O + "/",), max_depth=3))
    gone.cancel()
    assert gone.wait().count() <= 3 and gone.status()["state"] == "cancelled"
    bad = Crawler(spark, pages.select("url")).start(config)
    with pytest.raises(Exception):
        bad.wait()
    assert bad.status()["state"] == "failed"
    with pytest.raises(ValueError, match="no such sitemap"):
        crawler.seeded(O + "/", sitemap_url=O + "/nowhere.xml")


def test_crawler(spark, tmp_path):
    pages = spark.createDataFrame([(O + "/", "<title>H</title><p>x</p><a href='/a'>a</a><a href='/gone'>g</a>"), (O + "/a", "<h1>A</h1><p>text</p>")], "url string, html string")
    out = Crawler(spark, pages).crawl(CrawlConfig((O + "/",)))
    rows = {r.url: r for r in out.collect()}
    assert rows[O + "/"].title == "H" and rows[O + "/a"].markdown == "# A\n\ntext" and rows[O + "/gone"].error and rows[O + "/gone"].word_count == 0
    assert rows[O + "/gone"].links is not None and len(out.columns) == 18
    assert stats(out).first().asDict() == {"total": 3, "successful": 2, "failed": 1}
    assert [r.href for r in link_view(out).where("url = 'https://site.test/'").collect()] == [O + "/a", O + "/gone"] and media_view(out).count() == 0
    assert [r.word_count for r in sorted_by(out, "word_count", descending=True).collect()][-1] == 0
    assert pretty_json(out, 10).startswith("[\n  {")
    write_markdown(out, str(tmp_path / "md"))
    write_json(out, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("*.txt")))
    assert text.startswith("# H\n\n<https://site.test/>\n\nx") and "\n---\n\n# https://site.test/a" in text


def answer(url, timeout):
    found = {"/ok": (200, url, "text/html; charset=utf-8", "<p>x</p>"), "/404": (404, url, "text/html", "<p>n</p>"), "/json": (200, url, "application/json", "{}"), "/none": (200, url, "", ""), "/moved": (200, O + "/ok", "text/html", "m")}
    path = url[len(O) :]
    if path == "/slow":
        raise TimeoutError
    if path not in found:
        raise OSError("no route")
    return found[path]


def test_fetch(spark):
    got = {p: fetch.raw_fetch(O + p, 9, answer) for p in ("/ok", "/404", "/json", "/none", "/moved", "/slow", "/x")}
    assert got["/ok"]["success"] and got["/404"]["html"] and not got["/404"]["success"]
    assert [got[p]["error"] for p in ("/404", "/json", "/none", "/slow", "/x")] == ["HTTP 404", "Unsupported content type: application/json", "Unsupported content type: unknown", "Timed out after 9ms", "no route"]
    assert got["/moved"]["redirected_url"] == O + "/ok"
    urls = spark.createDataFrame([(O + "/ok",), (O + "/ok",), (O + "/x",)], "url string")
    assert sorted(r.success for r in fetch.fetch_live(urls, opener=lambda u, t: (200, u, "text/html", "x") if u.endswith("ok") else 1 / 0).collect()) == [False, True]
    pages = spark.createDataFrame([(O + "/ok", "h")], "url string, html string")
    assert {(r.success, r.error) for r in fetch.fetch_corpus(urls, pages).collect()} == {(True, None), (False, "not in the corpus")}


def test_sitemaps(spark):
    s = "https://s.test"
    bodies = spark.createDataFrame([
        (s + "/i.xml", f"<sitemapindex><loc>{s}/1.xml</loc><loc>{s}/broken.xml</loc><loc>https://evil.test/x.xml</loc><loc>{s}/i.xml</loc></sitemapindex>"),
        (s + "/1.xml", f"<urlset><loc> {s}/p/1 </loc><loc>{s}/q/2</loc><loc>{s}/p/1</loc><loc>ftp://z</loc></urlset>"),
        ("https://evil.test/x.xml", "<urlset><loc>https://evil.test/a</loc></urlset>"), (s + "/t.txt", f"{s}/p/9\n\nnot a url\n{s}/q/8\n"),
        (s + "/robots.txt", f"Sitemap: https://evil.test/x.xml\n sitemap: {s}/nope.xml\n"), (s + "/sitemap_index.xml", f"<urlset><loc>{s}/docs/1</loc><loc>{s}/other</loc></urlset>"),
    ], "url string, body string")
    roots = spark.createDataFrame([(s + "/i.xml",), (s + "/t.txt",)], "url string")
    got = sorted((r.root[len(s) :], r.ordinal, r.url[len(s) :]) for r in sitemap.sitemap_urls(bodies, roots).collect())
    assert got == [("/i.xml", 0, "/p/1"), ("/i.xml", 1, "/q/2"), ("/t.txt", 0, "/p/9"), ("/t.txt", 1, "/q/8")]
    assert sitemap.plan_seeds(spark, s + "/docs/x", bodies, use_sitemap=True) == [s + "/docs/1"]
    assert sitemap.plan_seeds(spark, s + "/none/x", bodies, use_sitemap=True, max_pages=1) == [s + "/docs/1"]
    assert sitemap.plan_seeds(spark, s + "/x", bodies) == [s + "/x"]
    with pytest.raises(ValueError):
        sitemap.plan_seeds(spark, s, bodies, use_sitemap=True, sitemap_url=s + "/1.xml", sitemap_match="zzz")


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, O + "/a", "<title>A</title><p>x</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    q = process_stream(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), outputs=("metadata",))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().metadata.title == "A"
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01 00:01:00' AS at, 'https://www.e.com/x' AS url")
    assert domain_counts(rows, "at").first().base_domain == "e.com"
