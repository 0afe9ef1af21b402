"""Work and memory that must not grow faster than the input."""

import gc
import sys

import duckdb
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom import queries as core
from corpusloom.functions import dom
from corpusloom.functions.dom import parse
from corpusloom.functions.markdown import _inside
from corpusloom.functions.scrape import ScrapeOptions, scrape
from corpusloom.operators import pages as P
from corpusloom.plans import traverse
from corpusloom.plans.config import CrawlConfig
from corpusloom.sources import sitemap


def test_cards_have_pages_of_bounded_size(spark, tmp_path):
    orders = spark.range(0, 64 * 50).select(F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    orders.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity")).write.parquet(str(tmp_path / "lineitem.parquet"))
    cards = core._cards(spark, str(tmp_path)).select(F.regexp_count("html", F.lit('class="order"')).alias("n")).collect()
    assert sum(r.n for r in cards) == 64 * 50 and max(r.n for r in cards) <= core.CARDS


def test_batches_are_cut():
    b = pa.RecordBatch.from_arrays([pa.array(["x"] * 600 + ["y" * (3 << 20)] * 3 + [None]), pa.array(range(604))], names=["t", "k"])
    got = list(P.pieces(iter([b, b.slice(0, 0)]), "t"))
    assert [k for g in got for k in g.column("k").to_pylist()] == list(range(604))
    assert max(g.num_rows for g in got) <= P.PIECE_ROWS and all(sum(len(t or "") for t in g.column("t").to_pylist()) <= P.PIECE_BYTES for g in got)


def test_sitemap_bodies_are_left_behind(spark, monkeypatch):
    plans = []
    kept = sitemap.staged
    monkeypatch.setattr(sitemap, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, name))
    s = "https://s.test"
    bodies = spark.createDataFrame([(s + "/i.xml", f"<urlset><loc>{s}/1</loc><loc>{s}/2</loc></urlset>")], "url string, body string")
    assert sitemap.sitemap_urls(bodies, bodies.select("url")).count() == 2
    above, below = plans[0].split("Generate", 1)
    assert "RLIKE" not in above and "RLIKE" in below


def test_sitemap_limit_is_taken_in_each_task(spark):
    s = "https://s.test"
    bodies = spark.createDataFrame([(s + "/i.xml", "<urlset>" + "".join(f"<loc>{s}/{i}</loc>" for i in range(9)) + "</urlset>")], "url string, body string")
    out = sitemap.sitemap_urls(bodies, bodies.select("url"), limit=3)
    assert sorted(map(tuple, out.select("ordinal", "url").collect())) == [(i, f"{s}/{i}") for i in range(3)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_row_group_are_dealt(spark, small):
    """Each query over orders, one file of one row group, works in more than one task."""
    for name in ("extract_fields", "links_by_kind", "markdown_known", "cleaned_known", "images_scored", "page_markdown"):
        tree = core.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        below = tree[tree.rindex("MapInArrow") :]
        assert "Repartition" in below and "Join" not in tree, name


def test_markdown_is_linear_in_children():
    html = lambda n: "<title>t</title>" + "".join(f'<a href="/c/{i}">x</a>' for i in range(n))

    def steps(n):
        counted = 0

        def count(frame, event, arg):
            nonlocal counted
            counted += event == "line" or event == "call"
            return count

        page = parse(html(n))
        sys.settrace(count)
        try:
            _inside(page.body)
        finally:
            sys.settrace(None)
        return counted

    assert steps(800) < 2.5 * steps(400)


def test_excluded_images_go():
    page = scrape(parse("<p>t<img src='https://o.org/i.png'><b>x</b><i></i></p>"), "https://e.com/", ScrapeOptions(exclude_external_images=True, only_text=True), ("cleaned_html",))
    assert page["cleaned_html"] == "<p>tx</p>"


def test_titles_with_a_reference_cut_off(spark, tmp_path):
    pages = [(1, "https://www.e.com/a", "<title>a &amp; b&amp</title><a href='/x'>x</a>"), (2, "https://www.e.com/b", "<title>&copy;&ampx; &quot</title>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {r.page_id: r.title for r in core.page_summary(spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(f"SELECT page_id, title FROM ({core.SQL['page_summary']})").fetchall())
    assert parse("<title>b&amp</title>").first("title").text == "b&"


def test_walks_hold_numbers(spark):
    """The one task of a walk gets no addresses."""
    s = "https://s.test/"
    nodes = spark.createDataFrame([(s + p,) for p in "abc"], "url string")
    edges = spark.createDataFrame([(s + "a", s + "c", 0, "internal"), (s + "a", s + "b", 1, "internal"), (s + "c", s + "x", 0, "internal")], "src string, dst string, ordinal int, kind string")
    out = traverse.walk(nodes, edges, {"k": CrawlConfig((s + "a",), strategy="dfs", max_depth=3)})
    assert [(r.url[-1], r.depth, (r.parent_url or "-")[-1], r.success) for r in out.orderBy("visit").collect()] == [("a", 0, "-", True), ("c", 1, "a", True), ("x", 2, "c", False), ("b", 1, "a", True)]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_scores_leave_in_pieces(spark, small):
    tree = core.pruning_score(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in tree and "ArrowEvalPython" not in tree and "Repartition" in tree


CARD = '<div class="k" onclick="x" data-n="%d">t <b>plain</b> <span>%d</span></div><p> </p><section><p></p></section><form>f</form><aside>gone</aside><p class="ad">gone</p><pre><i></i></pre>'
CLEAN = ScrapeOptions(excluded_tags=("aside",), excluded_selector=".ad", remove_forms=True, only_text=True)


def test_a_short_page_takes_few_calls():
    """Calls of Python and of built-ins, which time follows; the garbage collector is another test's."""
    clean = lambda i: P.process_html(CARD % (i, i), "https://e.com/", ("cleaned_html",), scrape_options=CLEAN)["cleaned_html"]
    calls, out = 0, clean(0)

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        for i in range(1, 11):
            out = clean(i)
    finally:
        sys.setprofile(None)
    assert out == '<div class="k">t plain 10</div><pre></pre>' and calls < 10 * 600


@pytest.mark.parametrize("content_filter", ["readability", "pruning-legacy", "bm25", "none"])
def test_pages_are_let_go_at_once(content_filter):
    """No page waits for the garbage collector."""
    html = "<title>t</title>" + CARD % (1, 1) + "<b><p>a</b>b</p>" + f"<p>{'Some words, and more of them. ' * 30}</p><nav class='popup'>n<i>x</i></nav>"
    options = ScrapeOptions(excluded_selector=".ad", css_selector="", exclude_external_links=True)
    alive = lambda: sum(isinstance(x, dom.Node) for x in gc.get_objects())
    P.process_html(html, "https://e.com/", content_filter=content_filter, scrape_options=options)
    gc.collect()
    before = alive()
    gc.disable()
    try:
        for _ in range(3):
            assert P.process_html(html, "https://e.com/", content_filter=content_filter, scrape_options=options, overlays=True)["cleaned_html"]
        assert alive() == before
    finally:
        gc.enable()


def test_tags_met_before_read_alike():
    pages = ['<a title=">" href=x>a</a>', "<a title='>'>a</a>", '<a"b>c</a"b>', '<p class="k>t</p>"x>u', "<p class='k>t</p>v", "<P CLASS=k>t</P >", "<p/><br/>t</p/>", "<pre>\nt</pre><textarea>\n<b></textarea>", "<!--<p>--><p>", "<p"]
    dom._MET.clear()
    cold = []
    for h in pages:
        cold.append(parse(h).outer_html)
        dom._MET.clear()
    for h in pages * 2:
        page = parse(h)
        assert page.outer_html == cold[pages.index(h)]
        for e in page.walk():
            e.attrs["more"] = "x"
