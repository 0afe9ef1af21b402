"""URL scorers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.urls import depth_col, extension_col, host_col

#: Score by age in years, and below that 1 - 0.1 a year, 0.1 at least; fixed values.
FRESH = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)


class Scorer:
    """weight * value(url)."""

    def __init__(self, weight: float = 1.0):
        self.weight = weight

    def value(self, url: Column) -> Column:
        raise NotImplementedError

    def __call__(self, url: Column) -> Column:
        return self.value(url) * F.lit(float(self.weight))


class Keywords(Scorer):
    def __init__(self, keywords: list[str], weight: float = 1.0, case_sensitive: bool = False):
        super().__init__(weight)
        self.case_sensitive = case_sensitive
        self.keywords = list(keywords) if case_sensitive else [k.lower() for k in keywords]

    def value(self, url: Column) -> Column:
        if not self.keywords:
            return F.lit(0.0)
        text = url if self.case_sensitive else F.lower(url)
        return reduce(lambda a, b: a + b, [text.contains(k).cast("int") for k in self.keywords]) / F.lit(float(len(self.keywords)))


class PathDepth(Scorer):
    def __init__(self, optimal: int = 3, weight: float = 1.0):
        super().__init__(weight)
        self.optimal = optimal

    def value(self, url: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.abs(depth_col(url) - F.lit(self.optimal)))


class Freshness(Scorer):
    def __init__(self, current_year: int | None = None, weight: float = 1.0):
        super().__init__(weight)
        self.current_year = current_year

    def value(self, url: Column) -> Column:
        now = F.lit(self.current_year) if self.current_year is not None else F.year(F.current_date())
        years = F.transform(F.regexp_extract_all(url, F.lit(r"[/\-_]((?:19|20)\d{2})(?=[/\-_]|\z)"), F.lit(1)), lambda y: y.cast("int"))
        age = now - F.array_max(F.filter(years, lambda y: y <= now))
        table = F.array(*[F.lit(x) for x in FRESH])
        return F.when(age.isNull(), 0.5).when(age < len(FRESH), F.get(table, age)).otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - age * F.lit(0.1)))


class ContentType(Scorer):
    def __init__(self, weights: dict[str, float], weight: float = 1.0):
        super().__init__(weight)
        self.weights = {k.removeprefix(".").removesuffix("$").lower(): float(v) for k, v in weights.items()}

    def value(self, url: Column) -> Column:
        ext, out = extension_col(url), F.lit(0.0)
        for k, v in self.weights.items():
            out = F.when(ext == k, F.lit(v)).otherwise(out)
        return out


class Authority(Scorer):
    def __init__(self, weights: dict[str, float], default: float = 0.5, weight: float = 1.0):
        super().__init__(weight)
        self.weights, self.default = {k.lower(): float(v) for k, v in weights.items()}, float(default)

    def value(self, url: Column) -> Column:
        host, out = host_col(url), F.lit(self.default)
        for k, v in self.weights.items():
            out = F.when(host == k, F.lit(v)).otherwise(out)
        return out


class Composite(Scorer):
    def __init__(self, scorers: list[Scorer], normalize: bool = True):
        super().__init__(1.0)
        self.scorers, self.normalize = scorers, normalize

    def value(self, url: Column) -> Column:
        if not self.scorers:
            return F.lit(0.0)
        total = reduce(lambda a, b: a + b, [s(url) for s in self.scorers])
        return total / F.lit(float(len(self.scorers))) if self.normalize else total


def build(keywords: list[str] = (), prefer_fresh: bool = False, optimal_depth: int | None = None, current_year: int | None = None) -> Scorer | None:
    """The scorer that a crawl's settings ask for: none, one, or a composite."""
    found: list[Scorer] = []
    if keywords:
        found.append(Keywords(list(keywords), weight=2.0))
    if prefer_fresh:
        found.append(Freshness(current_year))
    if optimal_depth is not None:
        found.append(PathDepth(optimal_depth))
    return None if not found else found[0] if len(found) == 1 else Composite(found)
