"""Settings of a crawl."""

from __future__ import annotations

from dataclasses import dataclass, field

STRATEGIES = ("bfs", "dfs", "best-first")


@dataclass(frozen=True)
class CrawlConfig:
    start_urls: tuple[str, ...]
    strategy: str = "bfs"
    max_depth: int = 2
    max_pages: int | None = None
    include_external: bool = False
    score_threshold: float | None = None
    #: "reference": whole levels are fetched even past the cap; "strict": never more successes than max_pages.
    cap_mode: str = "reference"
    allowed_domains: tuple[str, ...] = ()
    blocked_domains: tuple[str, ...] = ()
    url_patterns: tuple[str, ...] = ()
    exclude_social_media: bool = True
    keywords: tuple[str, ...] = ()
    prefer_fresh: bool = False
    optimal_depth: int | None = None
    current_year: int | None = None
    normalize_seeds: bool = False
    content_filter: str = "readability"
    batch: int = 10
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not any(self.start_urls):
            raise ValueError("a crawl needs at least one start URL")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"Unknown crawl strategy: {self.strategy}")
        for name in ("max_depth", "max_pages"):
            v = getattr(self, name)
            if v is not None and (not isinstance(v, int) or isinstance(v, bool) or v < 0):
                raise ValueError(f"{name} must be a whole number that is not negative")
        if self.cap_mode not in ("reference", "strict"):
            raise ValueError(f"Unknown cap mode: {self.cap_mode}")


def keyword_list(text: str) -> tuple[str, ...]:
    """Keywords from text with commas or spaces between them."""
    return tuple(k for k in text.replace(",", " ").split() if k)
