"""Fetching pages: from a corpus by join, or live over HTTP from the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship

TIMEOUT_MS = 60_000
HTML_TYPES = ("text/html", "application/xhtml+xml")
FETCHED = "url string, success boolean, error string, status_code int, final_url string, redirected_url string, html string"

#: url, timeout in seconds -> (status, final url, content type, body)
Opener = Callable[[str, float], tuple[int, str, str, str]]


def open_url(url: str, timeout: float) -> tuple[int, str, str, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        answer = urlopen(Request(url, headers={"Accept": ", ".join(HTML_TYPES)}), timeout=timeout)
    except HTTPError as e:
        answer = e
    with answer:
        body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        return answer.status, answer.url, answer.headers.get("Content-Type", ""), body


def raw_fetch(url: str, timeout_ms: int = TIMEOUT_MS, opener: Opener = open_url) -> dict:
    """One page as a row of FETCHED. It never raises; a page with an error status keeps its HTML."""
    row = dict.fromkeys(("error", "status_code", "final_url", "redirected_url", "html")) | {"url": url, "success": False}
    try:
        status, final, kind, body = opener(url, timeout_ms / 1000)
    except TimeoutError:
        return row | {"error": f"Timed out after {timeout_ms}ms"}
    except Exception as e:
        return row | {"error": str(e)}
    row |= {"status_code": status, "final_url": final, "redirected_url": final if final != url else None}
    if not any(t in kind for t in HTML_TYPES):
        return row | {"error": f"Unsupported content type: {kind or 'unknown'}"}
    ok = 200 <= status < 300
    return row | {"success": ok, "error": None if ok else f"HTTP {status}", "html": body}


def fetch_live(urls: DataFrame, concurrency: int = 5, timeout_ms: int = TIMEOUT_MS, opener: Opener = open_url) -> DataFrame:
    """Fetch each address once; `concurrency` tasks at a time."""
    ship(urls.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FETCHED.split(", ")]
        for f in frames:
            yield pd.DataFrame([raw_fetch(u, timeout_ms, opener) for u in f["url"]], columns=names, dtype=object)

    return urls.select("url").distinct().repartition(concurrency).mapInPandas(run, FETCHED)


def fetch_corpus(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Join a frontier to the pages that are there; what is missing gives an error row."""
    have = pages.select("url", "html", F.lit(True).alias("success"))
    return frontier.join(have, "url", "left").withColumn("error", F.when(F.col("success").isNull(), "not in the corpus")).withColumn("success", F.coalesce("success", F.lit(False)))
