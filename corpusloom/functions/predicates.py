"""URL predicates as column expressions, and the chain that a crawl's settings build."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.urls import SOCIAL, extension_col, host_col

Filter = Callable[[Column], Column]

#: Extensions of files that are not pages.
BINARY = (
    "jpg jpeg png gif webp avif svg bmp ico tif tiff mp3 wav ogg flac m4a aac mp4 m4v avi mov mkv webm wmv "
    "zip tar gz tgz bz2 xz 7z rar pdf doc docx xls xlsx ppt pptx odt ods odp exe msi dmg apk iso bin deb rpm woff woff2 ttf otf eot"
).split()


def content_type(block: list[str] = BINARY) -> Filter:
    return lambda url: ~extension_col(url).isin(*block)


def domain(allowed: list[str] | None = None, blocked: list[str] = (), block_social: bool = False) -> Filter:
    """Hosts and their subdomains: of the allowed ones if any are named, never of the blocked ones."""

    def within(host: Column, names) -> Column:
        return reduce(lambda a, b: a | b, [(host == d.lower()) | host.endswith("." + d.lower()) for d in names], F.lit(False))

    def run(url: Column) -> Column:
        host = host_col(url)
        out = ~within(host, [*blocked, *(SOCIAL if block_social else ())])
        return out & within(host, allowed) if allowed else out

    return run


def glob(patterns: list[str]) -> Filter:
    """Any of the patterns; * stands for any characters, ? for one."""
    regex = "|".join("^" + re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") + r"\z" for p in patterns)
    return lambda url: url.rlike("(?s)" + regex)


def max_depth(depth: Column, n: int) -> Column:
    return depth <= n


def chain(filters: list[Filter]) -> Filter:
    return lambda url: reduce(lambda a, b: a & b, [f(url) for f in filters], F.lit(True))


def can_process(url: Column, depth: Column, filters: Filter | None = None) -> Column:
    """A page's address that the chain accepts; at depth 0 any page's address."""
    page = F.lower(url).rlike(r"^https?://") & host_col(url).contains(".")
    return page & ((depth == 0) | (filters(url) if filters else F.lit(True)))


def build(include_external: bool = False, allowed: list[str] | None = None, blocked: list[str] = (), patterns: list[str] = (), block_social: bool = True) -> Filter:
    filters = [content_type()]
    if not include_external or allowed or blocked:
        filters.append(domain(allowed, blocked, block_social))
    if patterns:
        filters.append(glob(patterns))
    return chain(filters)
