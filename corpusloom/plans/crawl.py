"""Crawls over a corpus of pages, and their results."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.urls import normalize
from corpusloom.operators import pages as P
from corpusloom.plans.config import CrawlConfig
from corpusloom.plans.traverse import traverse
from corpusloom.session import staged, unstage
from corpusloom.sources.sitemap import plan_seeds


class Crawler:
    """spark, pages (url, html and optional status_code), optional sitemaps (url, body): crawl() gives stored results."""

    def __init__(self, spark: SparkSession, pages: DataFrame, sitemaps: DataFrame | None = None):
        self.spark, self.pages, self.sitemaps = spark, pages, sitemaps
        self._edges: DataFrame | None = None

    def edges(self) -> DataFrame:
        """The link graph of the whole corpus, extracted once."""
        if self._edges is None:
            found = P.links(self.pages)
            self._edges = staged(found.select(F.col("url").alias("src"), F.col("href").alias("dst"), "ordinal", "kind"), "graph")
        return self._edges

    def visits(self, config: CrawlConfig, **hooks) -> DataFrame:
        if config.normalize_seeds:
            config = CrawlConfig(**{**config.__dict__, "start_urls": tuple(normalize(u, None) or u for u in config.start_urls)})
        return traverse(self.pages.select("url"), self.edges(), config, **hooks)

    def crawl(self, config: CrawlConfig, **hooks) -> DataFrame:
        """Stored results of a crawl; only visited pages are processed in full."""
        visits = staged(self.visits(config, **hooks), "visits")
        wanted = self.pages.join(visits.where("success").select("url").distinct(), "url", "left_semi")
        done = P.process(wanted, content_filter=config.content_filter, **config.options).drop("success", "error")
        return stored_results(visits.join(done, "url", "left"))


    def seeded(self, url: str, sitemap_url: str | None = None, sitemap_match: str | None = None, **settings) -> CrawlConfig:
        """Settings of a crawl that starts from what the site's sitemap lists."""
        seeds = plan_seeds(self.spark, url, self.sitemaps, True, sitemap_url, sitemap_match, settings.get("max_pages"))
        return CrawlConfig(tuple(seeds), **settings)

    def start(self, config: CrawlConfig, checkpoint: str | None = None) -> CrawlJob:
        """Crawl in the background."""
        return CrawlJob(self, config, checkpoint)


class CrawlJob:
    """A crawl that runs in a thread of the driver: status, cancel, wait, results, clear."""

    def __init__(self, crawler: Crawler, config: CrawlConfig, checkpoint: str | None = None):
        self._cancelled, self._error, self._results = threading.Event(), None, None
        self._progress: dict = {"pages_crawled": 0, "queued": len(config.start_urls), "depth": 0}

        def run() -> None:
            try:
                found = crawler.crawl(config, on_progress=self._progress.update, should_cancel=self._cancelled.is_set, checkpoint=checkpoint)
                self._results = staged(found, "results")
            except Exception as e:  # kept for wait() and status()
                self._error = e

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def status(self) -> dict:
        """state (running, done, cancelled, failed), error, and how far the crawl is."""
        state = "running" if self._thread.is_alive() else "failed" if self._error else "cancelled" if self._cancelled.is_set() else "done"
        return {"state": state, "error": str(self._error) if self._error else None, **self._progress}

    def cancel(self) -> None:
        """Stop after the level or step that is under way; what was crawled stays."""
        self._cancelled.set()

    def wait(self, timeout: float | None = None) -> DataFrame:
        """The stored results, also of a crawl that was cancelled."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError("the crawl still runs")
        if self._error:
            raise self._error
        return self._results

    def clear(self) -> None:
        """Drop the results and their files."""
        self.wait()
        unstage(self._results)
        self._results = self._results.sparkSession.createDataFrame([], self._results.schema)


def stored_results(results: DataFrame) -> DataFrame:
    """The 17 columns that are kept, with defaults for what is missing."""
    has = set(results.columns)
    col = lambda n, t: F.col(n) if n in has else F.lit(None).cast(t)
    md = lambda n: F.coalesce(F.col(f"markdown.{n}"), F.lit("")) if "markdown" in has else F.lit("")
    empty = lambda n: F.coalesce(F.col(n), F.from_json(F.lit("{}" if n != "tables" else "[]"), P.FIELDS[n])) if n in has else F.lit(None).cast(P.FIELDS[n])
    title = F.coalesce(F.col("metadata.title"), F.lit("")) if "metadata" in has else F.lit("")
    return results.select(
        "url", "success", col("error", "string").alias("error"), col("status_code", "int").alias("status_code"), title.alias("title"),
        F.coalesce(col("depth", "int"), F.lit(0)).alias("depth"), col("parent_url", "string").alias("parent_url"), col("score", "double").alias("score"),
        F.coalesce(col("word_count", "int"), F.lit(0)).alias("word_count"), md("raw_markdown").alias("markdown"), md("markdown_with_citations").alias("markdown_with_citations"),
        md("references_markdown").alias("references"), md("fit_markdown").alias("fit_markdown"), empty("links").alias("links"), empty("media").alias("media"), empty("tables").alias("tables"),
        col("extracted", "string").alias("extracted"), *([F.col("visit")] if "visit" in has else []),
    )


def stats(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))


def sorted_by(results: DataFrame, column: str = "visit", descending: bool = False, locale: bool = False) -> DataFrame:
    key = F.collate(F.col(column), "UNICODE") if locale else F.col(column)
    return results.orderBy(key.desc() if descending else key.asc())


def link_view(results: DataFrame) -> DataFrame:
    """All links of results, one row each, with their kind."""
    row = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["href"].alias("href"), x["text"].alias("text"))
    kinds = F.concat(*[F.transform(f"links.{k}", row(k)) for k in ("internal", "external")])
    return results.select("url", F.explode(kinds).alias("l")).select("url", "l.*")


def media_view(results: DataFrame) -> DataFrame:
    every = F.concat("media.images", "media.videos", "media.audios")
    return results.select("url", F.explode(every).alias("m")).select("url", "m.*")


def export_markdown(results: DataFrame) -> DataFrame:
    """One row per successful page: its section of the export, in order of visit."""
    name = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url"))
    section = F.concat(F.lit("# "), name, F.lit("\n\n<"), F.col("url"), F.lit(">\n\n"), F.col("markdown"), F.lit("\n"))
    return results.where("success").select("visit", "url", section.alias("section"))


def write_markdown(results: DataFrame, path: str) -> None:
    """Sections joined by rules, in order; sorted files, so that no task holds them all."""
    export_markdown(results).orderBy("visit").select("section").write.option("lineSep", "\n---\n\n").text(path)


def write_json(results: DataFrame, path: str) -> None:
    """All results, one JSON object a line."""
    results.write.json(path)


def pretty_json(results: DataFrame, limit: int) -> str:
    """The first `limit` results in order of visit as one indented array; for looking at, not for bulk."""
    rows = results.orderBy("visit").limit(limit).select(F.to_json(F.struct("*")).alias("j")).collect()
    return json.dumps([json.loads(r["j"]) for r in rows], indent=2, ensure_ascii=False)
