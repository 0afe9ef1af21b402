"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has one bit for each of 64 positions: set if over half
the hashes of its word shingles have it. Equal fingerprints are collapsed
first. Fingerprints link at `budget` or fewer differing bits.

The trie of all fingerprints is cut over the cluster by the pigeonhole
principle: of budget + 1 equal bit blocks, two linked fingerprints share at
least one. So the trie is held once for each block, with that block's bits on
top, where the joined node pairs have no differing bit; each top node is a
group of its own. A group that is large is cut again the same way over its
remaining bits. Within a group node pairs are walked together from the top,
the differing bits of their paths are added up, and a pair over the budget is
left; only pairs of nodes that hold a handful of fingerprints are compared
outright. The node pairs of all groups of a task go down together, a bit at a
time, as arrays. Each group emits a spanning forest of its links, never the
pairs; a distributed union-find joins the forests. Nodes of that are
fingerprints, so that null ids and ids of several texts neither cut nor join.

Defined results: a null text counts as empty; a text without words has
fingerprint 0, which links like any other; repeated rows share a component;
an empty table gives no rows; texts of any length count whole; extra columns
are ignored. A null id takes part, and is the smallest only if it is alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import components
from corpusloom.session import read_table, ship, staged

SHINGLE, SEED, BUDGET = 3, 42, 3
#: Fingerprints that one group holds before it is cut again.
GROUP = 20_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 65_536):
        m = min(n, i + 65_536)
        part = zip(starts[i:m].tolist(), ends[i + k - 1 : m + k - 1].tolist())
        h = np.fromiter((digest(flat[a:b], seed) for a, b in part), np.uint64, m - i)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, 1024):
            part = b.slice(a, 1024)
            fp = np.fromiter((text_fingerprint(t) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "th", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, th, fp); th, a hash of the text, tells rows that share an id apart."""
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.xxhash64(text_col).alias("th"))
    return docs.mapInArrow(_fingerprints, "doc_id long, th long, fp long")


#: Nodes whose pairs are compared outright hold no more fingerprints than this, by geometric mean.
LEAF = 8
#: Node pairs that go down together, which bounds a walk's memory, and links that are joined at once.
FRONT, LINKS = 16_384, 1 << 18


def leaf_pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j, of the runs [a, b) and [c, d), in pieces."""
    wide = (d - c).astype(np.int64)
    many = (b - a) * wide
    ends = np.cumsum(many)
    s = 0
    while s < len(a):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + (1 << 21), "right")))
        p = np.repeat(np.arange(s, e), many[s:e])
        at = np.arange(len(p)) - np.repeat(ends[s:e] - many[s:e] - (ends[s - 1] if s else 0), many[s:e])
        i, j = a[p] + at // wide[p], c[p] + at % wide[p]
        yield i[i < j], j[i < j]
        s = e


def trie_links(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, leaf: int = LEAF, walked: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j) within groups [start, end) of fps, each sorted and distinct, by walking the node pairs of their tries together.

    A node is a run of the sorted array whose bits above the current one are
    equal. A front of node pairs goes down one bit: each pair gives up to four,
    with one more differing bit where their branches differ, and those over
    the budget are dropped. `walked` gets the number of pairs of each front.
    """
    ones: dict[int, np.ndarray] = {}
    starts, ends = starts.astype(np.int32), ends.astype(np.int32)
    stack = [(63, starts[s : s + FRONT], ends[s : s + FRONT], starts[s : s + FRONT], ends[s : s + FRONT], np.zeros(len(starts[s : s + FRONT]), np.int8)) for s in range(0, len(starts), FRONT)]
    while stack:
        bit, a, b, c, d, diff = stack.pop()
        if walked is not None:
            walked.append(len(a))
        small = (b - a).astype(np.int64) * (d - c) <= (leaf * leaf if bit >= 0 else np.iinfo(np.int64).max)
        for i, j in leaf_pairs(a[small], b[small], c[small], d[small]):
            near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
            yield i[near], j[near]
        if small.all():
            continue
        a, b, c, d, diff = (x[~small] for x in (a, b, c, d, diff))
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1))]).astype(np.int32)
        up = ones[bit]
        ma, mc = b - (up[b] - up[a]), d - (up[d] - up[c])
        two = a != c  # a node paired with itself has its two branches meet once
        down = [(a, ma, c, mc, diff), (ma, b, mc, d, diff), (a, ma, mc, d, diff + 1), (ma[two], b[two], c[two], mc[two], diff[two] + 1)]
        a, b, c, d, diff = (np.concatenate(x) for x in zip(*down))
        on = (a < b) & (c < d) & (diff <= budget)
        a, b, c, d, diff = (x[on] for x in (a, b, c, d, diff))
        stack += [(bit - 1, *(x[s : s + FRONT] for x in (a, b, c, d, diff))) for s in range(0, len(a), FRONT)]


def _union(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Component of each of n nodes as its smallest node."""
    label = np.arange(n)

    def join(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        nonlocal label
        i, j = (np.concatenate(x) for x in zip(*held))
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up

    held, size = [], 0
    for x in links:
        held.append(x)
        size += len(x[0])
        if size > LINKS:
            join(held)
            held, size = [], 0
    if held:
        join(held)
    return label


def _joiner(budget: int):
    """Per bucket of groups: a spanning forest of each group's links."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        used, key, fp = (rows[c].to_numpy() for c in ("used", "key", "fp"))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, key, used))
        used, key, fp = used[order], key[order], fp[order]
        new = np.concatenate([[True], (used[1:] != used[:-1]) | (key[1:] != key[:-1])])
        starts = np.flatnonzero(new)
        ends = np.concatenate([starts[1:], [len(fp)]])
        more = ends - starts > 1
        label = _union(len(fp), trie_links(fp, starts[more], ends[more], budget))
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[at].view(np.int64), "b": fp[label[at]].view(np.int64)})

    return run


def blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of `parts` near equal blocks of bits."""
    edges = [round(i * width / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def link_groups(fps: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """Rows (a, b): fp a is linked through its group to the fp b; a spanning forest of each group."""
    level = fps.select("fp", F.lit(0).cast("long").alias("used"), F.array(F.lit(0).cast("long")).alias("key"))
    out = None
    cut = [blocks(64, budget + 1)]
    # Each further cut divides the bits that the block before has left over.
    for depth in range(3):
        keyed = []
        if depth == 0:
            for i, (s, w) in enumerate(cut[0]):
                m = ((1 << w) - 1) << s
                keyed.append((i, m))
            opts = F.array(*[F.struct(F.lit(_signed(m)).alias("mask")) for _, m in keyed])
            level = level.withColumn("o", F.explode(opts)).select("fp", F.col("o.mask").alias("used"))
        else:
            choices = F.lit(None).cast("array<bigint>")
            for used in _masks(budget, depth):
                free = [i for i in range(64) if not used >> i & 1]
                opts = [sum(1 << free[i] for i in range(s, s + w)) for s, w in blocks(len(free), budget + 1)]
                choices = F.when(F.col("used") == F.lit(_signed(used)), F.array(*[F.lit(_signed(used | o)) for o in opts])).otherwise(choices)
            level = level.withColumn("used", F.explode(choices)).select("fp", "used")
        level = level.withColumn("key", F.col("fp").bitwiseAND(F.col("used")))
        sizes = level.groupBy("used", "key").agg(F.count("*").alias("n")).where("n > 1")
        big = staged(sizes.where(F.col("n") > group).select(F.col("used").alias("bu"), F.col("key").alias("bk")), "big") if depth < 2 else None
        same = (F.col("used") == F.col("bu")) & (F.col("key") == F.col("bk"))
        many = big is not None and bool(big.head(1))
        small = level.join(big, same, "left_anti") if many else level
        out = small if out is None else out.unionByName(small)
        if not many:
            break
        level = level.join(big, same, "left_semi")
    buckets = 4 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.groupBy(F.pmod(F.xxhash64("used", "key"), F.lit(buckets))).applyInPandas(_joiner(budget), "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(budget: int, depth: int) -> list[int]:
    """All bit masks that `depth` cuts can have used."""
    masks = [0]
    for _ in range(depth):
        nxt = []
        for used in masks:
            free = [i for i in range(64) if not used >> i & 1]
            nxt += [used | sum(1 << free[i] for i in range(s, s + w)) for s, w in blocks(len(free), budget + 1)]
        masks = nxt
    return masks


def near_duplicates(df: DataFrame, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, th, fp, group, component_id).

    group is the component as its least fingerprint, and component_id the
    smallest id in it. Components are of fingerprints: null ids and ids that
    several texts share neither cut nor join them.
    """
    rows = staged(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = link_groups(nodes.select("fp"), budget).distinct()
    roots = components(found.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")))
    named = staged(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("group")), "groups")
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "group").join(ids, "group")
    return rows.join(named, "fp").select("doc_id", "th", "fp", "group", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
