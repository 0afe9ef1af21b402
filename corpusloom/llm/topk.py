"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors become integers, floor(scale * x). Candidates are dealt into blocks by
a hash of their id. A block keeps, for each dimension, its vectors ordered by
their quantised value: posting segments of equal quantised impact. A query
takes the segments of a block by descending impact (the most that a segment can
add to a score above its dimension's least), adding upper bounds to the vectors
in them. It stops only when proof is there: no vector outside the possible
members can reach the query's threshold even if it were in the best segment
left in each dimension. The possible members are rescored exactly. The
threshold is the k-th best exact score that the query has seen: first over a
bounded sample of the candidates, which are candidates themselves and so prove
it, then over the block.

A block's index is built once for each QUERY_BLOCK queries, so a candidate moves
once for as many; blocks of both sides meet by an equi-join on block numbers,
and neither side is broadcast. Bounds are sums of whole numbers in double
precision, which are exact below 2^53; where sums could be larger nothing is
pruned.

Defined results: vectors that are null or empty, or hold null or non-finite
components, take no part, neither as query nor as candidate; null ids take no
part; of repeated ids each row is a candidate, never for its own id; ties go
to the smaller id; fewer than k candidates give all; an empty table gives no
rows; only the components that both vectors have count; extra columns are
ignored. Integers and scores have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corpusloom.llm.common import first_by_hash
from corpusloom.session import read_table, ship, staged

K, SCALE, EVERY = 10, 1024, 100
#: What the integers of a block of candidates hold; its least length where there is work for more tasks; queries in a block.
BLOCK_BYTES, LEAST_BLOCK, QUERY_BLOCK = 32 << 20, 8192, 4096
#: Vectors that set the first thresholds; levels of an impact at most, and vectors for each level.
SAMPLE, LEVELS, PER_LEVEL = 2048, 64, 256
#: After which part of the segments the proof is tried.
PROOFS = (0.5, 0.65, 0.75, 0.85, 1.0)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, ties to the smaller id."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= bar)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class ImpactIndex:
    """Posting segments of one block: for each dimension, vectors by quantised value."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, levels: int | None = None):
        self.vectors, self.ids = vectors, ids
        n, d = vectors.shape
        levels = levels or min(LEVELS, max(16, n // PER_LEVEL))
        self.low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.width = np.maximum(1, -(-(high - self.low + 1) // levels))
        self.levels = levels
        self.code = ((vectors - self.low) // self.width).astype(np.int8)
        self.order = np.stack([np.argsort(self.code[:, j], kind="stable").astype(np.int32) for j in range(d)])
        self.ends = np.stack([np.searchsorted(self.code[self.order[j], j], np.arange(levels + 1)) for j in range(d)])
        edge = self.low[:, None] + self.width[:, None] * np.arange(levels + 1)[None, :]
        self.first, self.last = edge[:, :-1], np.minimum(edge[:, 1:] - 1, high[:, None])

    def search(self, q: np.ndarray, query_id: int, k: int, bar: int | None, proofs: tuple[float, ...] = PROOFS) -> tuple[np.ndarray, np.ndarray, int]:
        """(positions, exact scores, segments taken) of the query's best k in this block."""
        # The most that a segment adds to a score, and how much that is above the least its dimension can add.
        most = np.maximum(q[:, None] * self.first, q[:, None] * self.last)
        filled = np.diff(self.ends, axis=1) > 0
        least = np.where(filled, most, np.iinfo(np.int64).max).min(axis=1)
        impact = np.where(filled, most - least[:, None], -1)
        dims, levels = np.nonzero(filled)
        by = np.argsort(-impact[dims, levels], kind="stable")
        dims, levels = dims[by], levels[by]
        gains = impact[dims, levels]
        falling = -np.sort(-impact, axis=1)
        base, up = int(least.sum()), q > 0
        exact_sums = float(np.abs(most.astype(np.float64)).max(axis=1).sum()) < 2.0**50
        got = np.zeros(len(self.ids), np.int64)
        used = np.zeros(len(q), np.int64)
        reached = np.where(up, self.levels, -1)  # the last level taken in each dimension
        taken, alive = 0, np.arange(len(self.ids))
        for part in proofs:
            end = round(len(dims) * part)
            js, lvs = dims[taken:end], levels[taken:end]
            for j, a, b, g in zip(js.tolist(), self.ends[js, lvs].tolist(), self.ends[js, lvs + 1].tolist(), gains[taken:end].tolist()):
                got[self.order[j, a:b]] += g
            used += np.bincount(js, minlength=len(q))
            reached[js] = lvs  # of a dimension's levels the one taken last stays
            taken = end
            # The k-th best exact score among the furthest so far proves a threshold too.
            ahead = alive[np.argpartition(got[alive], -4 * k)[-4 * k :]] if len(alive) > 4 * k else alive
            exact = self.vectors[ahead[self.ids[ahead] != query_id]] @ q
            if len(exact) >= k:
                bar = max(int(np.partition(exact, -k)[-k]), bar if bar is not None else np.iinfo(np.int64).min)
            if bar is None:
                continue
            # At most: what was added, and in each dimension not yet met the best segment left there.
            left = np.maximum(0, np.where(used < self.levels, falling[np.arange(len(q)), np.minimum(used, self.levels - 1)], 0))
            code = self.code[alive]
            unmet = (code < reached) & up | (code > reached) & ~up
            possible = np.ones(len(alive), bool)
            if exact_sums:
                for s in range(0, len(alive), 16_384):
                    part_unmet = unmet[s : s + 16_384].astype(np.float64) @ left.astype(np.float64)
                    possible[s : s + 16_384] = base + got[alive[s : s + 16_384]] + part_unmet.astype(np.int64) >= bar
            alive = alive[possible]
            if len(alive) <= 16 * k:
                break
        alive = alive[self.ids[alive] != query_id]
        exact = self.vectors[alive] @ q
        best = top(exact, self.ids[alive], k)
        return alive[best], exact[best], taken


def _matrix(lists: list[np.ndarray], d: int, scale: int) -> np.ndarray:
    """Vectors as rows of integers, floor(scale * x), padded by zeros."""
    out = np.zeros((len(lists), d), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = np.clip(np.floor(np.asarray(x, np.float64) * scale), -(2.0**62), 2.0**62)
    return out


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column, without a copy."""
    out = []
    for c in column.chunks:
        flat, ends = c.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(c.offsets.to_numpy()))
        out += np.split(flat, ends[:-1]) if len(c) else []
    return out


def _search(k: int, scale: int):
    """Cogroup function: one block of queries against one block of candidates."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found, at_ids, at_scores = [], [], []
        if queries.num_rows and rows.num_rows:
            q, v = _lists(queries.column("v")), _lists(rows.column("v"))
            d = max(map(len, q + v))
            index = ImpactIndex(_matrix(v, d, scale), rows.column("id").to_numpy())
            for qid, x, bar in zip(queries.column("id").to_pylist(), _matrix(q, d, scale), queries.column("bar").to_pylist()):
                at, scores, _ = index.search(x, qid, k, bar)
                found += [qid] * len(at)
                at_ids.append(index.ids[at])
                at_scores.append(scores)
        none = np.empty(0, np.int64)
        return pa.table({"query_id": pa.array(found, pa.int64()), "vec_id": np.concatenate([none, *at_ids]), "score": np.concatenate([none, *at_scores])})

    return run


def _thresholds(k: int, sample_ids: np.ndarray, sample: list[np.ndarray], scale: int):
    """mapInPandas function: the k-th best score of each query over the sample, which no worse candidate can beat."""

    def run(frames):
        for f in frames:
            d = max([1, *map(len, sample), *map(len, f["v"])])
            scores = _matrix(list(f["v"]), d, scale) @ _matrix(sample, d, scale).T
            bars = [None] * len(f)
            for i, (x, qid) in enumerate(zip(scores, f["id"])):
                x = x[sample_ids != qid]
                if len(x) >= k:
                    bars[i] = int(np.partition(x, -k)[-k])
            yield f.assign(bar=pd.array(bars, dtype="Int64"))

    return run


def taking_part(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (id, v) of the vectors that take part, in the type they came in."""
    v = F.col(vec_col)
    if not isinstance(df.schema[vec_col].dataType.elementType, FloatType):
        v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & (F.size(v) > 0) & fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def search(df: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the rows whose id is divisible by `every`.

    sample: how many vectors (the first by hash) set the first thresholds; a
    bound on what the driver holds, not on what is searched.
    """
    spark = df.sparkSession
    ship(spark)
    rows = staged(taking_part(df, id_col, vec_col), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.count_if(F.col("id") % every == 0).alias("queries")).first()
    n, d = size["n"], size["d"] or 1
    first = first_by_hash(rows, n, sample, "id", "v").toArrow()
    known, known_ids = _lists(first.column("v")), first.column("id").to_numpy()
    kind = rows.schema["v"].dataType.simpleString()
    queries = staged(rows.where(F.col("id") % every == 0).mapInPandas(_thresholds(k, known_ids, known, scale), f"id long, v {kind}, bar long"), "queries")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n * d * 8 // BLOCK_BYTES), min(width, n // LEAST_BLOCK))
    query_blocks = max(1, -(-size["queries"] // QUERY_BLOCK))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("cb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_search(k, scale), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""
