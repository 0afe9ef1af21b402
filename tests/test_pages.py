import json

import pytest

from corpusloom.functions import filters
from corpusloom.functions.dom import SelectorError, parse
from corpusloom.functions.extract import extract, problems
from corpusloom.functions.markdown import cite, to_markdown
from corpusloom.functions.scrape import ScrapeOptions, scrape, srcset
from corpusloom.operators import bm25
from corpusloom.operators import pages as P

URL = "https://example.com/blog/post"


@pytest.mark.parametrize(
    "html, body",
    [
        ("<p>a<b>x<p>y</b>z", "<p>a<b>x</b></p><p><b>y</b>z</p>"),
        ("<b><p>x</b>y</p>", "<b></b><p><b>x</b>y</p>"),
        ("<table><tr><td>1<td>2<tr><th>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></tbody></table>"),
        ("<table>foo<tr><td>x</table>", "foo<table><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<p>1 < 2 &amp; 3&nbsp;x", "<p>1 &lt; 2 &amp; 3&nbsp;x</p>"),
        ("<script>if(a<b)'</p>'</script>t", "t"),
        ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ("</p>", "<p></p>"), ("<div", ""), ("", ""),
    ],
)
def test_tree(html, body):
    assert parse(html).body.inner_html == body


def test_selectors():
    d = parse('<div class="a b" data-k="V-1"><h3>A</h3><p class=n>p</p><span>1</span><span>2</span></div>')
    count = lambda s: len(d.select(s))
    assert [count(s) for s in ("div > h3", "h3 + p", "h3 ~ span", "span:nth-child(4)", "[data-k='v-1' i]", "[data-k^=V]", "div:not(.b) p", "h3, p", ".a.b", "span:last-of-type", "[class~=b]", "[data-k|=V]")] == [1, 1, 2, 1, 1, 1, 0, 2, 1, 1, 1, 1]
    for bad in ("", "p[", "::x", "p >", "a:hover", "p!"):
        with pytest.raises(SelectorError):
            d.select(bad)


def run(body, head="<title>T</title>", **o):
    return scrape(parse(f"<html><head>{head}</head><body>{body}</body></html>"), URL, ScrapeOptions(**o))


def test_links_and_cleaning():
    out = run('<a href="/a" title=" t ">One</a><a href="/a">Two</a><a href="https://x.org/b">X</a><a href=" ">n</a><a href="mailto:a@b">m</a><script>s</script><p></p><div style="c" data-x=1 id=k>t</div>')
    assert [(x["href"], x["text"], x["title"]) for x in out["links"]["internal"]] == [("https://example.com/a", "One", "t")]
    assert [x["href"] for x in out["links"]["external"]] == ["https://x.org/b", "mailto:a@b"]
    assert "<script" not in out["cleaned_html"] and "<p>" not in out["cleaned_html"] and '<div id="k">t</div>' in out["cleaned_html"]
    gone = run('<a href="https://x.org/b">X</a><a href="/i">I</a>', exclude_external_links=True)
    assert not gone["links"]["external"] and "X" not in gone["cleaned_html"]
    assert run("<a href=p>x</a>", head='<base href="https://o.org/d/">')["links"]["internal"][0]["href"] == "https://o.org/d/p"


def test_options():
    assert run("<p>a <b>b</b></p>", only_text=True)["cleaned_html"] == "<p>a b</p>"
    assert run("<main><p>x</p></main><p>y</p>", css_selector="main p")["cleaned_html"] == "<p>x</p>"
    assert "y" in run("<p>y</p>", css_selector=".none")["cleaned_html"]
    with pytest.raises(SelectorError):
        run("<p>y</p>", css_selector="p[")
    assert "y" in run("<p>y</p>", excluded_selector="p[")["cleaned_html"]
    assert run('<form>f</form><p data-a="1">y</p>', remove_forms=True, keep_data_attributes=True)["cleaned_html"] == '<p data-a="1">y</p>'


def test_media_and_tables():
    out = run('<p>Words here <img src="/a.jpg" width="800px" height=600 alt=x srcset="/a2.jpg 2x, /b.jpg 400w"></p><div class="logo-box"><img src=/l.png width=900 height=900 alt=z></div><video src=/v.mp4><source src="/w.webm"></video>')
    assert [(i["src"], i["score"], i["width"]) for i in out["media"]["images"]] == [("https://example.com/a.jpg", 6, None), ("https://example.com/a2.jpg", 6, 2), ("https://example.com/b.jpg", 6, 400)]
    assert [v["src"] for v in out["media"]["videos"]] == ["https://example.com/v.mp4", "https://example.com/w.webm"]
    assert srcset("a 1x,, b") == [("a", 1), ("b", None)]
    t = run("<table><caption>C</caption><tr><th>H<th>I</tr><tr><td>1<td>2</tr><tr></tr></table><table><tr><td>x</tr></table>")["tables"]
    assert t == [{"headers": ["H", "I"], "rows": [["1", "2"]], "caption": "C"}, {"headers": ["x"], "rows": [["x"]], "caption": ""}]
    m = run("", head='<title> T </title><meta name="Description" content=" d "><meta property="og:description" content=o><link rel=canonical href=/c>')["metadata"]
    assert (m["title"], m["description"], m["canonical"], m["author"]) == ("T", "d", "/c", "")


def test_filters():
    long = "word " * 400
    page = f"<html><head><title>Solar panels</title></head><body><nav>menu</nav><article><h1>Solar</h1><p>{long}</p><p>Solar panels turn light into power.</p></article><span></span></body></html>"
    assert filters.composite_score(parse(f"<p>{long}</p>").body.elements[0]) > 0.48
    assert filters.composite_score(parse("<p>a b</p>").body.elements[0], min_words=3) == -1.0
    pruned = filters.apply_filter(parse(page), "pruning-legacy")
    assert "menu" not in pruned and "Solar panels turn" in pruned
    hit = filters.apply_filter(parse(page), "bm25", {"query": "light power", "threshold": 0.5})
    assert "turn light" in hit and "word word" not in hit
    assert filters.apply_filter(parse(page), "bm25", {"query": "the of"}) == "" and filters.apply_filter(parse(page), "none") == ""
    read = filters.apply_filter(parse(page), "readability")
    assert "turn light" in read and "menu" not in read
    assert filters.apply_filter(parse("<body></body>"), "readability") == ""
    with pytest.raises(ValueError):
        filters.apply_filter(parse(page), "what")
    d = parse(page)
    filters.apply_filter(d, "pruning-legacy")
    assert "menu" in d.body.inner_html


def test_markdown():
    assert to_markdown("<h2>T</h2><p>a <b>b</b> <i>c</i></p>") == "## T\n\na **b** _c_"
    assert to_markdown("<table><tr><th>A<th>B</tr><tr><td>1<td>2</tr></table>") == "| A | B |\n| --- | --- |\n| 1 | 2 |"
    assert to_markdown('<pre><code class="language-py">x = 1\n</code></pre>') == "```py\nx = 1\n```"
    assert to_markdown("  ") == "" and to_markdown(None) == ""
    body, refs = cite('[a](/x "T") ![i](y.png) [b](/x) [c](mailto:q@r)', "https://e.com/d/")
    assert body == "a⟨1⟩ !i⟨2⟩ b⟨1⟩ c⟨3⟩"
    assert refs == "\n\n## References\n\n⟨1⟩ https://e.com/x: T - a\n⟨2⟩ https://e.com/d/y.png: i\n⟨3⟩ mailto:q@r: c\n"
    assert cite("plain", URL) == ("plain", "")


def test_overlays():
    html = "<body class=modal-open><div class='Cookie-Banner'>c</div><div role=dialog>d</div><p>text</p></body>"
    out = P.process_html(html, URL, ("cleaned_html",), overlays=True)
    assert out["cleaned_html"] == "<p>text</p>"


def test_extraction():
    page = parse('<div class=p data-id=7><h3> Name </h3><b class=t>x</b><b class=t>y</b></div><p class=n>note</p><div class=p></div>')
    schema = {"baseSelector": "div.p", "baseFields": [{"name": "id", "type": "attribute", "attribute": "data-id"}], "fields": [
        {"name": "name", "selector": "h3", "type": "text", "transform": "uppercase"}, {"name": "tags", "selector": ".t", "type": "list", "fields": [{"name": "v", "type": "text"}]},
        {"name": "note", "source": "+ p.n", "type": "text"}, {"name": "m", "selector": "h3", "type": ["text", "regex"], "pattern": "(?<a>N\\w+)", "group": 1},
        {"name": "bad", "selector": "h3", "type": "regex", "pattern": "(", "default": "d"}, {"name": "sum", "type": "computed", "function": lambda i: len(i)}, {"name": "ev", "type": "computed", "expression": "1+1"},
    ]}
    got = extract(page, schema)
    assert got[0] == {"id": "7", "name": "NAME", "tags": [{"v": "x"}, {"v": "y"}], "note": "note", "m": "Name", "bad": "d", "sum": 6 - 1}
    assert any("computed" in p for p in problems(schema))
    assert problems({"baseSelector": "a", "fields": [{"name": "x", "type": "text"}]}) == []
    assert len(problems({})) == 2
    with pytest.raises(ValueError):
        extract(page, {"fields": []})


def test_pipeline(spark):
    rows = [("https://e.com/a", "<title>A</title><p>one two</p><a href='/b'>b</a>"), ("https://e.com/n", None), ("https://e.com/x", "<<<>>&#xZ;"), (None, "<p>t</p>")]
    done = {r.url: r for r in P.process(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert len(done) == 4 and all(r.success for r in done.values())
    a = done["https://e.com/a"]
    assert a.metadata.title == "A" and a.links.internal[0].href == "https://e.com/b" and a.word_count == 3 and a.markdown.raw_markdown.startswith("one two")
    bad = P.process(spark.createDataFrame(rows[:1], "url string, html string"), ("cleaned_html",), scrape_options=ScrapeOptions(css_selector="p[")).first()
    assert not bad.success and bad.error
    err = P.process(spark.createDataFrame(rows[:1], "url string, html string"), ("extracted",), schema={"baseSelector": "a["} | {"fields": []}).first()
    assert "error" in json.loads(err.extracted)
    with pytest.raises(ValueError):
        P.process(spark.createDataFrame(rows, "url string, html string"), content_filter="what")
    assert P.process(spark.createDataFrame([], "url string, html string")).count() == 0


def test_native_bm25_matches_page_filter(spark):
    html = "<p>solar power light</p><p>other words here</p><h2>solar</h2><li>power grid power</li>"
    page = parse(html)
    pages = spark.createDataFrame([(1, URL, html)], "page_id long, url string, html string")
    got = {r.chunk_no: r.score for r in bm25.scores(P.page_chunks(pages, keep=("page_id",)), "solar power").collect()}
    kept = filters.bm25(page, "solar power", threshold=0.0001)
    assert {i for i, s in got.items() if s > 0} == {0, 2, 3} and kept.count("\n") == 2
    assert got[2] > got[0] > got[1] == 0
