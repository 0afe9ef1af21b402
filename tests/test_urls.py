import pytest
from pyspark.sql import functions as F

from corpusloom.functions import predicates, scorers, urls

BASE = "https://example.com/docs/guide"


@pytest.mark.parametrize(
    "href, want",
    [
        ("page", "https://example.com/docs/page"), ("../a/./b", "https://example.com/a/b"), ("/x", "https://example.com/x"), ("//cdn.e.com/p", "https://cdn.e.com/p"),
        ("#top", "https://example.com/docs/guide"), ("?p=1", "https://example.com/docs/guide?p=1"), ("/x?utm_source=a&b=2&ref=z", "https://example.com/x?b=2"), ("/x?utm_source=a", "https://example.com/x"),
        ("HTTPS://EXAMPLE.com:443/A", "https://example.com/A"), ("http://e.com:8080", "http://e.com:8080/"), ("/a b/ü,", "https://example.com/a%20b/%C3%BC,"),
        ("/x?q=a%20b&gclid=1", "https://example.com/x?q=a+b"), ("/x?q=a%20b", "https://example.com/x?q=a%20b"), ("/dir/", "https://example.com/dir/"),
        ("mailto:a@b.c", "mailto:a@b.c"), ("", None), (None, None), ("http://", None), ("http://[bad", None), ("http://a b/", None),
    ],
)
def test_normalize(href, want):
    assert urls.normalize(href, BASE) == want


def test_normalize_options():
    assert urls.normalize("/x?b=1&a=2#f", BASE, keep_fragment=True, sort_query=True) == "https://example.com/x?a=2&b=1#f"
    assert urls.normalize("/x", None) is None


def test_columns_agree_with_scalars(spark):
    rows = ["https://www.example.com/a/b.HTML?x=.z", "http://a.b.example.co.uk:8080/", "https://deep.sub.example.org", "mailto:a@b", "http://10.0.0.1/x", "HTTPS://EVILexample.com/", "/rel", "https://m.facebook.com/p", "https://facebook.com.evil.org/", "tel:1"]
    u = F.col("u")
    got = spark.createDataFrame([(r,) for r in rows], "u string").select(
        "u", urls.base_domain_col(u).alias("d"), urls.is_external_col(u, F.lit("example.com")).alias("e"), urls.is_social_col(u).alias("s"), urls.depth_col(u).alias("n"), urls.extension_col(u).alias("x")
    )
    for r in got.collect():
        assert r.d == urls.base_domain(r.u), r
        assert r.e == urls.is_external(r.u, "example.com"), r
        assert r.s == urls.is_social(r.u), r
    by = {r.u: r for r in got.collect()}
    assert by[rows[0]].n == 2 and by[rows[0]].x == "html" and by[rows[2]].n == 0 and by[rows[8]].s is False and by[rows[5]].e is True


def test_scorers(spark):
    df = spark.createDataFrame([("https://e.com/2024/x",), ("https://e.com/a_2019-b",), ("https://e.com/2031/",), ("https://e.com/page",), ("https://e.com/19999/",), ("https://e.com/2001",)], "u string")
    got = [round(r[0], 6) for r in df.select(scorers.Freshness(2026)(F.col("u"))).collect()]
    assert got == [0.8, 0.3, 0.5, 0.5, 0.5, 0.1]
    one = df.limit(1)
    val = lambda s: one.select(s(F.col("u"))).first()[0]
    assert val(scorers.Keywords(["E.com", "zzz"])) == 0.5 and val(scorers.Keywords(["E.com"], case_sensitive=True)) == 0.0 and val(scorers.Keywords([])) == 0.0
    assert val(scorers.PathDepth(2)) == 1.0 and val(scorers.PathDepth(4, weight=3)) == 1.0
    assert val(scorers.Composite([scorers.PathDepth(2), scorers.Keywords(["q"])])) == 0.5 and val(scorers.Composite([])) == 0.0
    assert val(scorers.Authority({"E.COM": 0.7})) == 0.7 and val(scorers.ContentType({".pdf$": 2})) == 0.0
    assert scorers.build() is None


def test_predicates(spark):
    ok = lambda f, u: spark.createDataFrame([(u,)], "u string").select(f(F.col("u"))).first()[0]
    assert ok(predicates.glob(["*/keep/*"]), "https://e.com/keep/x") and not ok(predicates.glob(["*/keep/*"]), "https://e.com/other")
    assert not ok(predicates.content_type(), "https://e.com/a.PDF?x=1") and ok(predicates.content_type(), "https://e.com/a?x=.pdf")
    d = predicates.domain(["a.com"], ["bad.a.com"])
    assert ok(d, "https://x.a.com/") and not ok(d, "https://y.bad.a.com/") and not ok(d, "https://nota.com/")
    can = lambda u, n: spark.createDataFrame([(u,)], "u string").select(predicates.can_process(F.col("u"), F.lit(n), predicates.glob(["*x*"]))).first()[0]
    assert can("https://e.com/", 0) and not can("https://e.com/", 1) and can("https://e.com/x", 1) and not can("ftp://e.com/x", 1) and not can("http://localhost/x", 0)
