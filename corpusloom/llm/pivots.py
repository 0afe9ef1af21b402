"""Embedding near-duplicates over a pivot-permutation index.

Each vector is described by its nearest reference points (pivots) in order, 8 of
up to 1,024 pivots and more where there are more. Every pivot has an inverted
list of the vectors that name it. Within a list, vectors are retrieved that
share at least `shared` pivots (all, where there are fewer), and verified by
cosine in double precision. A pair that meets in several lists counts in that
of its smallest shared pivot alone; as this is never among the last
`shared` - 1 that a vector names, it isn't entered there. Lists are cut
into blocks, and pairs of blocks are tasks of their own, so that a list of any
length is done in bounded pieces. A task emits one row per vector: its links
and its local root, never the pairs. Equal vectors are collapsed first and
counted by weight; vectors go about in the type they came in.

The pivots are a sample of the distinct vectors, the first by hash: about the
square root of their number, between MIN_PIVOTS and MAX_PIVOTS, and no more
than PIVOT_BYTES hold. A sampled vector within cosine NEAR of a pivot is passed
over, so that a large group of near copies doesn't fill the pivots with its own
members.

A vector whose nearest pivot lies within NEAR and one link of it is at home in
that pivot's cell, and is compared there with every vector that can link with
it: by the triangle inequality these lie within the cell's radius and one link
of the pivot, and within one link of the plane halfway to their own nearest
pivot. So all links of vectors at home are found, and each vector that links
with a sampled one is at home. The inverted lists serve the others alone; the
README gives the recall against brute force.

Defined results: vectors that are null, empty, all zero, or hold null or
non-finite components link with nothing and stand alone; vectors of different
lengths never link; each row is a vector of its own, also where it repeats an
id, a vector or both, and equal vectors link; a null id takes part, but is a
component's smallest only if it has no other (its component_id is null then);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corpusloom.llm.common import components, first_by_hash
from corpusloom.session import read_table, ship, staged

THRESHOLD = 0.95
SHARED = 3
#: Pivots that a vector names: up to so many pivots in all, and beyond.
PREFIXES, LONGEST = ((1024, 8), (4096, 10)), 12
MIN_PIVOTS, MAX_PIVOTS = 256, 32_768
#: What all pivots hold in double precision, and what a block's vectors do.
PIVOT_BYTES, BLOCK_BYTES = 32 << 20, 8 << 20
#: No two pivots are as near as this.
NEAR = 0.9
#: Slack for rounding in bounds, and the home of a vector that has none.
EPS, NOWHERE = 1e-6, 2**31 - 1


def prefix_of(n_pivots: int) -> int:
    """How many pivots a vector names. The share of near pairs that have 3 in common falls as pivots grow more, and rises with the names."""
    return next((n for most, n in PREFIXES if n_pivots <= most), LONGEST)


def thinned(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Up to `wanted` of the sample's unit vectors, in order, none within cosine NEAR of one before it."""
    kept = sample[:0]
    for s in range(0, len(sample), 256):
        part = sample[s : s + 256]
        part = part[(part @ kept.T < NEAR).all(axis=1)]
        near = part @ part.T >= NEAR
        take = []
        for i in range(len(part)):
            if not near[i, take].any():
                take.append(i)
        kept = np.concatenate([kept, part[take]])
        if len(kept) >= wanted:
            break
    return kept[:wanted]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square leaves its range."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cosines(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = min(v.shape[1], pivots.shape[1])
    return unit(v)[:, :d] @ pivots[:, :d].T


def by_nearness(near: np.ndarray, prefix: int) -> np.ndarray:
    """The ordered numbers of the largest cosines of each row."""
    m = min(prefix, near.shape[1])
    part = np.argpartition(-near, m - 1, axis=1)[:, :m]
    order = np.lexsort((part, -np.take_along_axis(near, part, axis=1)), axis=1)
    return np.take_along_axis(part, order, axis=1).astype(np.int32)


def nearest(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ordered numbers of each vector's nearest pivots by cosine."""
    return by_nearness(cosines(v, pivots), prefix)


def cells(near: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each row or NOWHERE, rows, cells): every cell that a row is at home in or can link into."""
    link = np.arccos(np.clip(threshold, -1, 1))
    reach = np.arccos(NEAR) + link
    first = near.argmax(axis=1)
    best = near[np.arange(len(near)), first]
    home = np.where(best >= np.cos(min(reach, np.pi)) - EPS, first, NOWHERE)
    row, cell = np.nonzero(near >= np.cos(min(reach + link, np.pi)) - EPS)
    apart = np.linalg.norm(pivots[first[row]] - pivots[cell], axis=1)
    keep = best[row] - near[row, cell] <= np.sin(min(link, np.pi / 2)) * apart + EPS
    return home, row[keep], cell[keep]


LISTS = "pivot int, dim int, id long, w long, v binary, named binary, home int, angle double"


def _lister(pivots: np.ndarray, prefix: int, shared: int, threshold: float):
    """mapInArrow function: vectors to their entries in inverted lists, and in cells (pivot -1 - p)."""
    schema = pa.schema([("pivot", pa.int32()), ("dim", pa.int32()), ("id", pa.int64()), ("w", pa.int64()), ("v", pa.binary()), ("named", pa.binary()), ("home", pa.int32()), ("angle", pa.float64())])

    def entries(part: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
        v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        ids, w = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        near = cosines(v, pivots)
        home, row, cell = cells(near, pivots, threshold)
        alone = np.flatnonzero(home == NOWHERE)
        named = np.sort(by_nearness(near[alone], prefix), axis=1) if len(alone) else np.zeros((0, 1), np.int32)
        raw, tags = [x.tobytes() for x in v], dict(zip(alone.tolist(), (x.tobytes() for x in named)))
        entered = named[:, : max(1, named.shape[1] - shared + 1)]
        pivot = np.concatenate([entered.ravel(), -1 - cell]).astype(np.int32)
        at = np.concatenate([np.repeat(alone, entered.shape[1]), row])
        angle = np.arccos(np.clip(near[at, np.where(pivot < 0, -1 - pivot, pivot)], -1, 1))
        for s in range(0, len(at), 8192):
            r, p = at[s : s + 8192], pivot[s : s + 8192]
            told = pa.array([tags[i] if q >= 0 else b"" for i, q in zip(r.tolist(), p.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.full(len(r), d, np.int32)), pa.array(ids[r]), pa.array(w[r]), pa.array([raw[i] for i in r], pa.binary()), told, pa.array(home[r].astype(np.int32)), pa.array(angle[s : s + 8192])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column(2).offsets.to_numpy())
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for s in range(0, len(at), 2048):
                    yield from entries(b.take(pa.array(at[s : s + 2048])), d)

    return run


def postings(named: np.ndarray) -> dict[int, np.ndarray]:
    """The rows that name each pivot."""
    order = np.argsort(named.ravel(), kind="stable")
    values, starts = np.unique(named.ravel()[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order // named.shape[1], starts[1:])))


def retrieved(a: dict[int, np.ndarray], b: dict[int, np.ndarray], shape: tuple[int, int], pivot: int, shared: int) -> np.ndarray:
    """Which pairs share `shared` pivots or more and none smaller than `pivot`, which all name: posting lists merged to counts."""
    count = np.ones(shape, np.int16)
    for p in a.keys() & b.keys():
        if p != pivot:
            count[np.ix_(a[p], b[p])] += 1 if p > pivot else -1000
    return count >= shared


def _verifier(threshold: float, shared: int):
    """Per list or cell and pair of blocks: each vector's links and local root."""

    def read(raw: pd.Series, d: int) -> np.ndarray:
        flat = b"".join(raw)
        return unit(np.frombuffer(flat, np.float32 if len(flat) == 4 * d * len(raw) else np.float64).reshape(-1, d))

    def linked(va: np.ndarray, vb: np.ndarray, candidate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that pass, verified one by one where they are few among all pairs."""
        i, j = np.nonzero(candidate)
        if len(i) * 16 > candidate.size:
            near = (va @ vb.T)[i, j]
        else:
            near = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", va[i[s : s + 65_536]], vb[j[s : s + 65_536]]) for s in range(0, len(i), 65_536))])
        keep = near >= threshold
        return i[keep], j[keep]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, d, x, y = (int(k) for k in key)
        sides = []
        for side in (x, y) if x != y else (x,):
            part = rows[rows["block"] == side]
            named = np.array([np.frombuffer(r, np.int32) for r in part["named"]]) if pivot >= 0 and len(part) else None
            sides.append((part["id"].to_numpy(), part["w"].to_numpy(), read(part["v"], d) if len(part) else np.empty((0, d)), named, part["home"].to_numpy()))
        (ia, wa, va, na, ha), (ib, wb, vb, nb, hb) = sides[0], sides[-1]
        if not len(ia) or not len(ib):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype(np.int64)
        ids = ia if x == y else np.concatenate([ia, ib])
        off = 0 if x == y else len(ia)
        links = np.zeros(len(ids), np.int64)
        pairs = []
        post = postings(nb) if pivot >= 0 else None
        for s in range(0, len(ia), 1024):
            e = min(len(ia), s + 1024)
            if pivot < 0:
                candidate = np.minimum(ha[s:e, None], hb[None, :]) == -1 - pivot
            else:
                candidate = retrieved(postings(na[s:e]), post, (e - s, len(ib)), pivot, min(shared, na.shape[1]))
            if x == y:
                candidate &= np.arange(s, e)[:, None] < np.arange(len(ib))[None, :]
            i, j = linked(va[s:e], vb, candidate)
            if len(i):
                np.add.at(links, s + i, wb[j])
                np.add.at(links, off + j, wa[s + i])
                pairs.append((s + i, off + j))
        root = ids.copy()
        if pairs:
            i, j = (np.concatenate(p) for p in zip(*pairs))
            while True:
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                if (root == before).all():
                    break
        at = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[at], "links": links[at], "root": root[at]})

    return run


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, prefix: int | None = None, shared: int = SHARED, id_col: str = "vec_id", vec_col: str = "embedding", max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept). prefix: pivots that a vector names (prefix_of their number if None)."""
    spark = df.sparkSession
    ship(spark)
    v = F.col(vec_col)
    if not isinstance(df.schema[vec_col].dataType.elementType, FloatType):
        v = v.cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(v.isNotNull() & fine, v).alias("v"))
    # 128 bits of hash stand for a vector; a null vector has none.
    keys = [F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(i), "v")).alias(f"h{i}") for i in (1, 2)]
    rows = staged(rows.select("vec_id", "v", *keys), "vectors")
    distinct = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.any_value("v").alias("v"))
    distinct = staged(distinct.select(F.monotonically_increasing_id().alias("id"), "w", "v", "h1", "h2", "least"), "distinct")
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    most = max(1, min(max_pivots, PIVOT_BYTES // (8 * size["width"])))
    wanted = int(min(most, max(MIN_PIVOTS, np.sqrt(size["n"]))))
    sample = first_by_hash(distinct.select("v", "h1", "h2"), size["n"], min(4 * wanted, max(wanted, most)), "h1", "h2").select("v").toArrow()
    pivots = np.zeros((sample.num_rows, size["width"]))
    for i, x in enumerate(sample.column("v")):
        x = x.values.to_numpy(zero_copy_only=False)
        pivots[i, : len(x)] = x
    pivots = thinned(unit(pivots), wanted)
    lister = _lister(pivots, prefix or prefix_of(len(pivots)), shared, threshold)
    lists = staged(distinct.select("id", "w", "v").mapInArrow(lister, LISTS), "lists")
    # Of those that a cell could hold, the ones that its farthest vector at home could link with.
    far = lists.where("home = -1 - pivot").groupBy("pivot", "dim").agg(F.max("angle").alias("far"))
    link = float(np.arccos(np.clip(threshold, -1, 1))) + EPS
    # Both tables have a row for each pivot and length: no more than a batch of pivots times the lengths there are.
    lists = lists.join(far, ["pivot", "dim"], "left").where((F.col("pivot") >= 0) | (F.col("angle") <= F.col("far") + link)).drop("far", "angle")
    sizes = lists.groupBy("pivot", "dim").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("pivot", "dim", F.ceil(F.col("n") * F.col("dim") * 8 / F.lit(BLOCK_BYTES)).cast("int").alias("blocks"))
    cut = lists.join(sizes, ["pivot", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("pivot", "dim", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "w", "v", "named", "home")
    found = staged(cut.groupBy("pivot", "dim", "x", "y").applyInPandas(_verifier(threshold, shared), "id long, links long, root long"), "found")
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("child"), F.col("root").alias("parent"))).select(F.col("node").alias("id"), "root")
    node = distinct.select("id", "w", "h1", "h2", "least").join(degree, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = node.groupBy("root").agg(F.min("least").alias("component_id"))
    node = node.join(least, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "h1", "h2").join(node, ["h1", "h2"], "left")
    root = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), ok AS (
  SELECT n, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.n AS a, b.n AS b FROM ok a JOIN ok b ON a.n <> b.n AND a.norm > 0 AND b.norm > 0 AND len(a.v) = len(b.v)
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT n AS a, n AS b FROM v
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT r.a, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.n = r.b GROUP BY r.a
)
SELECT v.vec_id,
  (SELECT count(*) FROM links l WHERE l.a = v.n) AS n_links,
  component_id,
  v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least ON least.a = v.n
"""
