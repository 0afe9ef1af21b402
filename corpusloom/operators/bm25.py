"""BM25 over text chunks in DataFrame operations: one pass of counts, no per-page Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.filters import BOOSTS, STOPWORDS
from corpusloom.functions.filters import tokens as plain_tokens


def tokens(text: Column) -> Column:
    """Lower-case letters and digits, without single characters and stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def boost(tag: Column) -> Column:
    out = F.lit(1.0)
    for k, v in BOOSTS.items():
        out = F.when(tag == k, F.lit(v)).otherwise(out)
    return out


def scores(chunks: DataFrame, query: str, page: str = "page_id", chunk: str = "chunk_no", tag: str | None = "tag", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows (page, chunk, score): each chunk against the query, statistics taken over its page.

    Terms are filtered to the query before the only shuffle, which is on the
    page; term counts are arrays of the query's length, so rows stay small.
    """
    terms = list(dict.fromkeys(plain_tokens(query)))
    t = chunks.select(F.col(page).alias("page"), F.col(chunk).alias("chunk"), (F.col(tag) if tag else F.lit("")).alias("tag"), tokens(F.col(text)).alias("tokens"))
    equals = lambda w: lambda x: x == F.lit(w)
    tf = F.array(*[F.size(F.filter("tokens", equals(w))) for w in terms]) if terms else F.array().cast("array<int>")
    rows = t.select("page", "chunk", "tag", F.size("tokens").alias("len"), tf.alias("tf"))
    stats = rows.groupBy("page").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = rows.join(stats, "page")
    mean = F.when(F.col("avg_len") == 0, 1.0).otherwise(F.col("avg_len"))
    score = F.lit(0.0)
    for i in range(len(terms)):
        f = F.col("tf")[i]
        score = score + F.when(f > 0, idf(F.col(f"df{i}"), F.col("n")) * (f * F.lit(k1 + 1)) / (f + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / mean))).otherwise(0.0)
    return joined.select(F.col("page").alias(page), F.col("chunk").alias(chunk), (score * boost(F.col("tag"))).alias("score"))
