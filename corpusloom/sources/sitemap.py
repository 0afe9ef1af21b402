"""Sitemaps as tables: bodies in, ordered page addresses out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.urls import origin_col, parse, path_col
from corpusloom.session import staged

MAX_INDEX_DEPTH = 3
LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"
IS_INDEX = r"(?i)<sitemapindex"
IS_SITEMAP = r"(?i)<urlset|<sitemapindex|<loc>"


def same_origin(child: Column, parent: Column) -> Column:
    """Both are http(s), with equal scheme, host and port."""
    return F.lower(child).rlike(r"^https?://") & (origin_col(child) == origin_col(parent))


def looks_like_sitemap(url: Column) -> Column:
    return url.rlike(r"(?i)\.xml(\?|\z)|sitemap")


def derived_match(url: Column) -> Column:
    """'/first segment/' of an address, or null."""
    first = F.regexp_extract(path_col(url), "^/+([^/]+)", 1)
    return F.when(first != "", F.concat(F.lit("/"), first, F.lit("/")))


def guesses(url: Column) -> Column:
    """Where a site's sitemap may be."""
    o = origin_col(url)
    return F.when(o != "", F.array(*[F.concat(o, F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml", "/robots.txt")])).otherwise(F.array().cast("array<string>"))


def _locs(body: Column) -> Column:
    """Addresses in an XML body, or the lines of a plain text one."""
    xml = F.regexp_extract_all(body, F.lit(LOC), F.lit(1))
    plain = F.filter(F.transform(F.split(body, r"\r?\n"), F.trim), lambda x: x != "")
    return F.when(body.rlike(r"(?i)<urlset|<sitemapindex|<loc"), xml).otherwise(plain)


def sitemap_urls(sitemaps: DataFrame, roots: DataFrame, match: str | None = None, limit: int | None = None, strict: bool = False) -> DataFrame:
    """Rows (root, ordinal, url): each root's page addresses in the order found, each once.

    sitemaps: (url, body). roots: (url). Index files are followed up to
    MAX_INDEX_DEPTH deep, to children of the same origin only; children that
    are missing are passed over, and so are roots unless `strict` raises.
    """
    bodies = sitemaps.select(F.col("url").alias("at"), "body")
    if strict:
        lost = roots.join(bodies, roots["url"] == bodies["at"], "left_anti").select(roots["url"]).first()
        if lost:
            raise ValueError(f"no such sitemap: {lost['url']}")
    level = roots.select(F.col("url").alias("root"), F.col("url").alias("at"), F.array().cast("array<int>").alias("order"))
    pages = None
    for depth in range(MAX_INDEX_DEPTH + 1):
        got = level.join(bodies, "at")
        # A body is read once and left behind; what follows the explode runs once for each address.
        got = got.select("root", "at", "order", F.col("body").rlike(IS_INDEX).alias("is_index"), _locs(F.col("body")).alias("locs"))
        found = got.select("root", "at", "is_index", "order", F.posexplode("locs").alias("i", "url"))
        found = staged(found.withColumn("order", F.concat("order", F.array("i"))), "sitemap")
        here = found.where(~F.col("is_index") & F.lower("url").rlike("^https?://")).select("root", "order", "url")
        pages = here if pages is None else pages.unionByName(here)
        level = found.where(F.col("is_index") & same_origin(F.col("url"), F.col("at"))).select("root", F.col("url").alias("at"), "order")
        if depth == MAX_INDEX_DEPTH:
            break
    if match:
        pages = pages.where(F.col("url").rlike(match))
    firsts = pages.groupBy("root", "url").agg(F.min("order").alias("order"))
    out = firsts.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("order")))
    if limit is not None:
        out = out.where(F.col("place") <= limit)  # on the number itself, so that each task sends no more than these
    return out.select("root", (F.col("place") - 1).alias("ordinal"), "url")


def discover(sitemaps: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows (url, sitemap): the first candidate of each page's site that is there and looks like a sitemap.

    Candidates are what robots.txt names (same origin only), then the usual places.
    """
    pages = sites.select("url", origin_col(F.col("url")).alias("origin"))
    robots = sitemaps.select(F.col("url").alias("robots_url"), F.col("body").alias("robots"))
    named = pages.join(robots, F.concat("origin", F.lit("/robots.txt")) == F.col("robots_url"), "left")
    told = F.filter(F.regexp_extract_all(F.coalesce("robots", F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), lambda x: same_origin(x, F.col("url")))
    usual = F.array(F.concat("origin", F.lit("/sitemap.xml")), F.concat("origin", F.lit("/sitemap_index.xml")))
    tries = named.select("url", F.posexplode(F.concat(told, usual)).alias("ordinal", "candidate"))
    good = sitemaps.where(F.col("body").rlike(IS_SITEMAP)).select(F.col("url").alias("candidate"))
    return tries.join(good, "candidate", "left_semi").groupBy("url").agg(F.min_by("candidate", "ordinal").alias("sitemap"))


def to_seeds(start: str | list[str] | None) -> list[str]:
    seeds = [s for s in ([start] if isinstance(start, str) else start or []) if s]
    if not seeds:
        raise ValueError("a crawl needs at least one start URL")
    return seeds


def plan_seeds(spark: SparkSession, url: str, sitemaps: DataFrame | None = None, use_sitemap: bool = False, sitemap_url: str | None = None, sitemap_match: str | None = None, max_pages: int | None = None) -> list[str]:
    """The addresses a crawl starts from: the page itself, or what its sitemap lists (max_pages or 50 at most)."""
    if not use_sitemap or sitemaps is None:
        return to_seeds(url)
    at, derived = sitemap_url, False
    if not at:
        row = discover(sitemaps, spark.createDataFrame([(url,)], "url string")).first()
        at, derived = (row["sitemap"] if row else None), True
    if not at:
        raise ValueError("no sitemap found")
    match = sitemap_match
    if not match and derived:
        u = parse(url)
        first = next((p for p in (u.path if u else "").split("/") if p), None)
        match = f"/{re.escape(first)}/" if first else None
    limit = 50 if max_pages is None else max_pages
    roots = spark.createDataFrame([(at,)], "url string")
    seeds = [r["url"] for r in sitemap_urls(sitemaps, roots, match, limit, strict=True).orderBy("ordinal").collect()]
    if not seeds and match and not sitemap_match:
        seeds = [r["url"] for r in sitemap_urls(sitemaps, roots, None, limit).orderBy("ordinal").collect()]
    if not seeds:
        raise ValueError("the sitemap lists no matching pages")
    return seeds
