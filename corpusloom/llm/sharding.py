"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group. Groups are ordered by the
64-bit hash of the text; the smallest shard capacity that lets the ordered
groups be cut into n contiguous runs is found by binary search with a greedy
check, and the cuts are set there, each as near to an even split as that
capacity allows. The driver never holds the groups: it works on sums over
hash prefixes, and lengthens only prefixes that a cut can fall into.

Defined results: a null text has no bytes (size 8, crc32 0) and all null texts
form one group; empty texts form one; texts whose 64-bit hashes collide stay
together; an empty table gives no rows; repeated rows each get a slot; columns
other than the id and the text are ignored. A group larger than an even share
gets a shard of its own, and the rest is cut on either side of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import running
from corpusloom.session import read_table, staged

N_SHARDS = 24
FIRST_BITS, MORE_BITS = 12, 8

#: One run of groups: (first hash as unsigned, bits of its prefix, bytes, groups)
Segment = tuple[int, int, int, int]


def greedy_ends(sizes: list[int], n: int, cap: int) -> list[int] | None:
    """Ends (exclusive indexes) of at most n runs, each filled as far as cap lets it; None if that fails."""
    ends, total = [], 0
    for i, s in enumerate(sizes):
        if s > cap:
            return None
        if total + s > cap:
            ends.append(i)
            total = 0
            if len(ends) == n:
                return None
        total += s
    return ends + [len(sizes)] * (n - len(ends))


def least_capacity(sizes: list[int], n: int) -> int:
    """The smallest capacity that greedy_ends can meet, by binary search."""
    low, high = max([0, *sizes, -(-sum(sizes) // n)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if greedy_ends(sizes, n, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def balanced_ends(sizes: list[int], n: int, cap: int) -> list[int]:
    """Cuts within cap, each as near to an even split as the cuts before and after it allow."""
    at = [0]
    for s in sizes:
        at.append(at[-1] + s)
    first = [len(sizes) - e for e in reversed(greedy_ends(sizes[::-1], n, cap)[:-1])]
    ends, last = [], 0
    for k in range(1, n):
        want = at[-1] * k / n
        top = last
        while top < len(sizes) and at[top + 1] - at[last] <= cap:
            top += 1
        best = min(range(max(last, first[k - 1]), top + 1), key=lambda i: (abs(at[i] - want), i))
        ends.append(best)
        last = best
    return [*ends, len(sizes)]


def parts(segments: list[Segment], n: int) -> list[tuple[int, int, int]]:
    """(start, end, shards): around groups that exceed an even share and so get a shard alone."""

    def split(a: int, b: int, n: int) -> list[tuple[int, int, int]]:
        total = sum(s[2] for s in segments[a:b])
        i = max(range(a, b), key=lambda i: (segments[i][2] if segments[i][3] == 1 else 0, -i), default=None)
        if n < 2 or i is None or segments[i][3] > 1 or segments[i][2] * n < total or b - a == 1:
            return [(a, b, n)]
        left, right = sum(s[2] for s in segments[a:i]), sum(s[2] for s in segments[i + 1 : b])
        if n == 2 and left and right:
            return [(a, b, n)]
        k = n - 1
        m = round(k * left / max(1, left + right))
        m = min(max(m, 1 if left else 0), k - (1 if right else 0))
        return (split(a, i, m) if m else []) + [(i, i + 1, 1)] + (split(i + 1, b, k - m) if k - m else [])

    return split(0, len(segments), n)


def cut_points(groups: DataFrame, n: int, hash_col: str = "h", size_col: str = "size") -> list[int]:
    """Unsigned hashes at which shards 1..n-1 start (2**64: no such shard has rows)."""

    def sums(rows: DataFrame, bits: int) -> list[Segment]:
        p = F.shiftrightunsigned(F.col(hash_col), 64 - bits)
        by_hash = rows.groupBy(hash_col).agg(F.sum(size_col).alias("s"))
        found = by_hash.groupBy(p.alias("p")).agg(F.sum("s").alias("s"), F.count("*").alias("n")).collect()
        return [((r["p"] % (1 << bits)) << (64 - bits), bits, r["s"], r["n"]) for r in found]

    def edges(segments: list[Segment]) -> tuple[list[int], set[int]]:
        cuts: list[int] = []
        open_: set[int] = set()
        for a, b, m in parts(segments, n):
            sizes = [s[2] for s in segments[a:b]]
            cap, total = least_capacity(sizes, m), sum(sizes)
            ends = balanced_ends(sizes, m, cap)
            tight = max([-(-total // m), *(s[2] for s in segments[a:b] if s[3] == 1)], default=0) if m else 0
            # A cut's true place lies where the capacities between `tight` and `cap` can put it.
            at = [0]
            for s in sizes:
                at.append(at[-1] + s)
            for k, e in enumerate(ends[:-1], 1):
                want, slack = total * k / m, (cap - tight) * min(k, m - k)
                lo, hi = min(want, at[e]) - slack, max(want, at[e]) + slack
                open_ |= {a + i for i in range(len(sizes)) if sizes[i] and segments[a + i][3] > 1 and at[i] < hi and at[i + 1] > lo}
            cuts += [segments[a + e][0] if a + e < len(segments) else 1 << 64 for e in ends]
        return (cuts + [1 << 64] * n)[: n - 1], open_

    segments = sorted(sums(groups, FIRST_BITS))
    while True:
        cuts, open_ = edges(segments)
        todo = [i for i in open_ if segments[i][1] < 64]
        if not todo:
            return cuts
        finer = []
        for bits in {segments[i][1] for i in todo}:
            prefixes = [segments[i][0] >> (64 - bits) for i in todo if segments[i][1] == bits]
            inside = groups.where(F.shiftrightunsigned(F.col(hash_col), 64 - bits).isin(prefixes))
            finer += sums(inside, min(64, bits + MORE_BITS))
        gone = set(todo)
        segments = sorted([s for i, s in enumerate(segments) if i not in gone] + finer)


def shard_of(h: Column, cuts: list[int]) -> Column:
    """The shard of an unsigned 64-bit hash kept in a long."""
    flip = lambda x: x - (1 << 63)
    key = h.bitwiseXOR(F.lit(-(1 << 63)))
    out = F.lit(0)
    for c in cuts:
        if c < 1 << 64:
            out = out + (key >= F.lit(flip(c))).cast("int")
    return out


def shard(df: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot); see the module's text."""
    text = F.col(text_col)
    rows = staged(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.when(text.isNull(), F.lit(1).cast("long")).otherwise(F.xxhash64(text)).alias("h"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        ),
        "sizes",
    )
    n = rows.count()
    cuts = cut_points(rows, n_shards) if n else [1 << 64] * (n_shards - 1)
    out = rows.withColumn("shard", shard_of(F.col("h"), cuts).cast("int"))
    return running(out, ["shard"], ["doc_id", "h"], F.lit(1), n, "slot").drop("h")


def write_shards(df: DataFrame, path: str, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the texts under path/shard=K, several files for each shard where it is large."""
    where = shard(df, n_shards, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), "shard", "slot").dropDuplicates(["__id", "__crc"])
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    joined = df.select(id_col, text_col).join(where, F.col(id_col).eqNullSafe(F.col("__id")) & (crc == F.col("__crc")))
    joined.drop("__id", "__crc").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
