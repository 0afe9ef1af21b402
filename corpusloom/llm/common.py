"""Parts that several operators share: ranks, prefix sums, components, permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import staged, unstage

#: Rows that one window partition of a rank or prefix sum holds on average.
ROWS_PER_BUCKET = 1024
#: Bucket sums of one key that a task adds up.
ROWS_PER_TASK = 1 << 17


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, n_rows: int, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the rows before this one among the same keys.

    With value 1 this is a gapless rank from 0. The order is by the hash of
    the `order` columns, then by these; it is total up to equal rows. Rows of
    one key are spread over hashed buckets, so that no task holds a whole hot
    key: bucket sums are added up first, then rows within each bucket. Where the
    buckets of a key are too many for a task, their sums go the same way.
    """
    buckets = max(1, -(-n_rows // ROWS_PER_BUCKET))
    b, v, base = f"__{name}_b", f"__{name}_v", f"__{name}_base"
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets))).withColumn(v, value.cast("long"))
    sums = df.groupBy(*keys, b).agg(F.sum(v).alias(base))
    if buckets > ROWS_PER_TASK:
        sums = running(sums, keys, [b], F.col(base), buckets, f"{name}_up").drop(base).withColumnRenamed(f"{name}_up", base)
    else:
        before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    inside = Window.partitionBy(*[F.col(k) for k in keys], F.col(b)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(name, F.coalesce(F.sum(v).over(inside), F.lit(0)))
    renamed = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(b).alias("__kb"), base)
    same = F.col(b) == F.col("__kb")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = df.join(renamed, same, "left")
    return out.withColumn(name, F.col(name) + F.col(base)).drop(b, v, base, "__kb", *[f"__k_{k}" for k in keys])


def first_by_hash(df: DataFrame, n_rows: int, wanted: int, *keys: str) -> DataFrame:
    """Up to `wanted` rows of df (which has n_rows), the first by a hash of the keys.

    Only rows under a hash bound that somewhat more than `wanted` meet are
    sorted, so what the tasks send does not grow with their number.
    """
    place = F.pmod(F.xxhash64(F.lit(17), *keys), F.lit(1 << 40))
    share = (1.2 * wanted + 200) / max(1, n_rows)
    if share < 0.5:
        df = df.where(place < int(share * (1 << 40)))
    return df.orderBy(place, *keys).limit(wanted)


def permuted(x: Column, n: Column, seed: list[Column], rounds: int = 10) -> Column:
    """A pseudorandom permutation of x within 0..n-1, chosen by the seed columns.

    Swap-or-not shuffle: a bijection on any domain. In each round x pairs
    with (K - x) mod n, and a hash of the larger of the two says whether the
    pair swaps. A lambda holds the value of each round, so that the expression
    does not double from round to round.
    """

    def step(v: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(r * 2, *seed) - v, n)
        swap = F.xxhash64(r * 2 + 1, *seed, F.greatest(v, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("long"), step)


def components(edges: DataFrame, child: str = "child", parent: str = "parent", max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (child > parent): rows (node, root) for nodes that have a smaller root.

    Each round keeps every node's smallest parent, links its other parents to
    that one, and then lets every edge jump to its parent's parent; the sum of
    all parents falls until each node points at its component's minimum.
    Everything stays in joins and map-side combined aggregates; each round is
    written to the shared folder, so that a lost executor costs one round.
    """
    e = staged(edges.select(F.col(child).alias("u"), F.col(parent).alias("w")).where("u > w").distinct(), "edges")
    for _ in range(max_rounds):
        least = e.groupBy("u").agg(F.min("w").alias("m"))
        linked = e.join(least.withColumnRenamed("u", "mu"), F.col("u") == F.col("mu")).select(
            F.explode(F.when(F.col("w") == F.col("m"), F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("w")))).otherwise(F.array(F.struct(F.col("w").alias("u"), F.col("m").alias("w"))))).alias("x")
        ).select("x.u", "x.w").distinct()
        e1 = staged(linked, "edges")
        up = e1.groupBy("u").agg(F.min("w").alias("g")).withColumnRenamed("u", "p")
        jumped = e1.join(up, F.col("w") == F.col("p"), "left").select("u", F.coalesce("g", "w").alias("w"), F.col("g").isNotNull().alias("moved"))
        e2 = staged(jumped.groupBy("u", "w").agg(F.max("moved").alias("moved")), "edges")
        unstage(e)
        unstage(e1)
        state = e2.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes"), F.max(F.col("moved").cast("int")).alias("moved")).first()
        e = e2.select("u", "w")
        e._corpusloom_path = e2._corpusloom_path
        if state["n"] == state["nodes"] and not state["moved"]:
            return e.select(F.col("u").alias("node"), F.col("w").alias("root"))
    raise RuntimeError("components did not settle")
