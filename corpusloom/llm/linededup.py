"""Fuzzy line deduplication by MinHash.

Equal lines are collapsed first. Each distinct line gets a signature from its
character shingles: one hash a shingle, its smallest value in each of
BANDS * ROWS bins, empty bins filled from the next full one. Lines that agree
in all rows of a band are candidates: a run. A run's lines within one batch are
compared with the first of them by the exact Jaccard similarity of the shingle
sets, and these firsts with the run's first; so a run of any length sends one
entry a batch to the task that sorts its key. Lines that fail that, or whose
first fails it, are open, and in runs of three and more each open line is
compared with the whole run, in blocks. So every link that matters for
connectivity is checked, and no run's pairs are written out. A distributed
union-find joins the links; of each component the line that comes first (by
document id, then line number) is kept and the others are removed.

Bands and rows give a pair at the threshold a chance of 99.9 % to meet.

Defined results: lines are cut at newline; blank lines (white space only) are
neither compared nor removed; a line shorter than a shingle is one shingle
itself; a null text stays null; a text whose lines all go becomes ''; null ids
come first; of rows that repeat an id and a text one keeps what its document
keeps and the others lose all lines; an empty table gives no rows. Lines are
known by a 64-bit hash, and where different lines share one (a second hash
tells), by one of their own. Other columns stay as they are, but for one of the
name dropped_lines, which is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.llm.common import components
from corpusloom.session import read_table, shared_dir, ship, staged, unstage

SHINGLE, THRESHOLD = 8, 0.8
BANDS, ROWS = 10, 3
#: Lines of one run that one task compares with others at once; rows of a hot run that one join task gets.
BLOCK, SPREAD = 512, 1024
NO_VALUE = np.iinfo(np.uint64).max


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit numbers evenly."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def signatures(lines: list[str], shingle: int = SHINGLE, bins: int = BANDS * ROWS) -> np.ndarray:
    """One row of `bins` numbers a line: bin-wise minima of its shingles' hashes."""
    # A line is padded to one shingle by zeros; separators keep windows inside lines.
    lens = np.fromiter(map(len, lines), np.int64, len(lines))
    padded = np.maximum(lens, shingle)
    text = "".join(x if len(x) >= shingle else x.ljust(shingle, "\0") for x in lines)
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(padded)
    step, done, h = np.uint64(0x100000001B3), 1, u
    while done < shingle:  # windows of 2, 4, 8 ... code points, then the odd rest
        add = min(done, shingle - done)
        power = np.uint64(pow(int(step), add, 1 << 64))
        h = h[: len(h) - add] * power + (h[add:] if add == done else window_hash(u, add, step)[done : done + len(h) - add])
        done += add
    # Every window has a bin of its line; those that run over a line's end go to a bin that is thrown away.
    bin_ = (((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    key = np.repeat(np.arange(0, len(lines) * bins, bins), padded)[: len(h)] + bin_.astype(np.int64)
    over = (ends[:-1, None] - np.arange(1, shingle)[None, :]).ravel()
    key[over] = len(lines) * bins
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    out = np.full(len(lines) * bins + 1, NO_VALUE, np.uint64)
    np.minimum.at(out, key, h >> np.uint64(1))
    out = out[:-1]
    out = out.reshape(-1, bins)
    full = out != NO_VALUE
    for d in range(1, bins):  # an empty bin takes the value of the next full one, marked by the distance
        empty = ~full
        if not empty.any():
            break
        src, ok = np.roll(out, -d, axis=1), np.roll(full, -d, axis=1)
        take = empty & ok & (out == NO_VALUE)
        out = np.where(take, mix(src + np.uint64(d)), out)
    return out


def window_hash(u: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    h = np.zeros(len(u) - n + 1, np.uint64)
    for i in range(n):
        h = h * step + u[i : i + len(h)]
    return h


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = sig.reshape(len(sig), bands, -1)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows.shape[2]):
        key = mix(key * np.uint64(0x100000001B3) + rows[:, :, r])
    return key


def shingles(line: str, k: int = SHINGLE) -> frozenset:
    return frozenset(line[i : i + k] for i in range(max(1, len(line) - k + 1)))


def packed(line: str) -> np.ndarray | None:
    """The line's shingles as sorted distinct 64-bit numbers, a byte for each character; None if that cannot hold them."""
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if len(raw) < SHINGLE:  # one shingle, told from longer ones by its zeros, unless it has zeros itself
        return None if b"\0" in raw else np.frombuffer(raw.ljust(8, b"\0"), "<u8")
    x = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def similarity(a: str, b: str) -> float:
    """Exact Jaccard similarity of two lines' shingle sets."""
    x, y = packed(a), packed(b)
    if x is None or y is None:
        s, t = shingles(a), shingles(b)
        return len(s & t) / len(s | t)
    z = np.sort(np.concatenate([x, y]))
    both = int(np.count_nonzero(z[1:] == z[:-1]))
    return both / (len(x) + len(y) - both)


def _bander(n_buckets: int):
    """mapInArrow function: lines (lid, line) to packed band entries, a row for each batch and bucket.

    An entry is a key, the least line of the batch that has it, and how many have it. The
    others that have it are in rows of bucket -1, with that least line.
    """
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("lids", pa.binary()), ("more", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lids, lines = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            size = np.concatenate([[0], np.cumsum(np.maximum(1, np.fromiter(map(len, lines.to_pylist()), np.int64, len(lines))))])
            a = 0
            while a < len(lids):
                e = max(a + 1, int(np.searchsorted(size, size[a] + 2_000_000, "right")) - 1)
                keys = band_keys(signatures(lines.slice(a, e - a).to_pylist()))
                ids = np.repeat(lids[a:e], keys.shape[1])
                order = np.lexsort((ids, keys.ravel()))
                keys, ids = keys.ravel()[order], ids[order]
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                many = np.diff(np.concatenate([starts, [len(keys)]]))
                firsts = np.repeat(ids[starts], many)
                rest = np.ones(len(keys), bool)
                rest[starts] = False
                out = [(-1, keys[rest], ids[rest], firsts[rest])] if rest.any() else []
                keys, ids = keys[starts], ids[starts]
                bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                out += [(i, keys[order[s:t]], ids[order[s:t]], many[order[s:t]].astype(np.int32)) for i, (s, t) in enumerate(zip(ends, ends[1:])) if t > s]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in cols[1:])], schema=schema)
                a = e

    return run


def _runs(rows: pd.DataFrame) -> pd.DataFrame:
    """Per bucket: of each run of two or more lines the entries, with the run's first line and its length."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"]])
    lids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["lids"]])
    many = np.concatenate([np.frombuffer(x, np.int32) for x in rows["more"]]).astype(np.int64)
    order = np.lexsort((lids, keys))
    keys, lids, many = keys[order], lids[order], many[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    entries = np.diff(np.concatenate([starts, [len(keys)]]))
    size = np.repeat(np.add.reduceat(many, starts), entries)
    keep = size > 1
    return pd.DataFrame({"run": keys[keep].view(np.int64), "a": np.repeat(lids[starts], entries)[keep], "b": lids[keep], "n": size[keep], "m": many[keep]})


def _locals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of bucket -1 to (run, a, b): line b beside the least line a of its batch."""
    for batch in batches:
        for part in zip(*(batch.column(c).to_pylist() for c in ("keys", "more", "lids"))):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in part], names=["run", "a", "b"])


def _pair_verifier(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ok = [similarity(x, y) >= threshold for x, y in zip(f["ta"], f["tb"])]
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "linked": np.array(ok, bool)})

    return run


def jaccard(lines: list[str], others: list[str], k: int = SHINGLE) -> np.ndarray:
    """Exact Jaccard similarities of all lines with all others, from 0/1 matrices of their shingles."""
    block = [*lines, *others]
    sets = [packed(t) for t in block]
    if any(x is None for x in sets):
        number: dict[str, int] = {}
        sets = [np.array(sorted(number.setdefault(x, len(number)) for x in shingles(t, k))) for t in block]
    sizes, n = np.array([len(x) for x in sets]), len(lines)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(block)), sizes)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    # A shingle that one line has alone adds to no pair.
    shared = np.bincount(at)[at] > 1
    at, row = np.unique(at[shared], return_inverse=True)[1], row[shared]
    both = np.zeros((n, len(block) - n), np.float32)
    for s in range(0, int(at.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(at, [s, s + 4096])
        m = np.zeros((len(block), 4096), np.float32)
        m[row[a:b], at[a:b] - s] = 1
        both += m[:n] @ m[n:].T
    return both / (sizes[:n, None] + sizes[None, n:] - both)


#: What a line is in a pair of blocks: one of all, an open one, or both.
MEMBER, OPEN, BOTH = 0, 1, 2


def _block_verifier(threshold: float):
    """Per bucket of runs' block pairs: a spanning forest of the links of open lines to lines of their run."""

    def forest(ids: np.ndarray, lines: list[str], others: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
        i, j = np.nonzero(jaccard(lines, texts) >= threshold - 1e-6)
        root: dict[int, int] = {}

        def find(u: int) -> int:
            while root.setdefault(u, u) != u:
                root[u] = u = root[root[u]]
            return u

        out = []
        for u, v in zip(ids[i].tolist(), others[j].tolist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((max(u, v), min(u, v)))
        return out

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, side, lids, lines = rows[["run", "ub", "mb"]].to_numpy(), rows["side"].to_numpy(), rows["lid"].to_numpy(), rows["line"].to_numpy()
        order = np.lexsort(keys.T)
        cuts = np.flatnonzero((keys[order][1:] != keys[order][:-1]).any(axis=1)) + 1
        out = []
        for g in np.split(order, cuts):
            u, m = g[side[g] != MEMBER], g[side[g] != OPEN]
            if len(u) and len(m):
                out += forest(lids[u], lines[u].tolist(), lids[m], lines[m].tolist())
        return pd.DataFrame(out, columns=["b", "a"], dtype="int64")

    return run


def line_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, th, line_no, line) of all lines that are not blank."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return docs.where(F.col("line").rlike(r"[^\s]"))


def line_hash(line: Column) -> Column:
    """The hash that a line is known by."""
    return F.xxhash64(line)


def line_links(lines: DataFrame, threshold: float = THRESHOLD, scrap: list[DataFrame] | None = None) -> DataFrame:
    """Links (b, a) with b > a between distinct lines (lid, line), as forests over the runs of all bands.

    `scrap` gets the tables that may go once the links have been read.
    """
    spark = lines.sparkSession
    scrap = [] if scrap is None else scrap

    def staged(df: DataFrame, name: str) -> DataFrame:
        scrap.append(session.staged(df, name))
        return scrap[-1]

    n_buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = staged(lines.select("lid", "line").mapInArrow(_bander(n_buckets), "bucket int, keys binary, lids binary, more binary"), "bands")
    heads = staged(packed.where("bucket >= 0").groupBy("bucket").applyInPandas(_runs, "run long, a long, b long, n long, m long"), "runs")
    # A batch's other lines of a run hang on the batch's first: at most a batch of rows for each (run, first).
    local = packed.where("bucket < 0").select("keys", "more", "lids").mapInArrow(_locals, "run long, a long, b long")
    runs = staged(heads.select("run", "a", "b", "n").unionByName(local.join(heads.where("m > 1").select("run", F.col("b").alias("a"), "n"), ["run", "a"]).select("run", "a", "b", "n")), "members")
    needed = runs.select(F.col("b").alias("need")).distinct()
    texts = staged(lines.select("lid", "line").join(needed.hint("shuffle_hash"), F.col("lid") == F.col("need")).select("lid", "line"), "texts")
    pairs = runs.where("a <> b").select("a", "b").distinct()
    ta, tb = texts.select(F.col("lid").alias("a"), F.col("line").alias("ta")), texts.select(F.col("lid").alias("b"), F.col("line").alias("tb"))
    checked = staged(pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInPandas(_pair_verifier(threshold), "a long, b long, linked boolean"), "checked")
    links = checked.where("linked").select("b", "a")
    # Open in a run of three and more: lines unlike the one they hang on, and those that hang on an open one.
    bad = checked.where("not linked").select("a", "b")
    unlike = staged(runs.where("n > 2").join(bad, ["a", "b"], "left_semi").select("run", "b"), "unlike")
    hanging = runs.where("n > 2 and a <> b").join(unlike.select("run", F.col("b").alias("a")), ["run", "a"], "left_semi").select("run", "b")
    open_ = staged(unlike.unionByName(hanging).distinct(), "open")
    # Runs of several bands with the same lines are compared once.
    long_runs = runs.where("n > 2").groupBy("run", "n").agg(F.expr("bit_xor(xxhash64(b))").alias("lines"))
    long_runs = long_runs.join(open_.groupBy("run").agg(F.count("*").alias("u")), "run")
    long_runs = long_runs.groupBy("n", "lines").agg(F.min(F.struct("run", "u")).alias("x")).select("x.run", "x.u", F.ceil(F.col("n") / SPREAD).cast("int").alias("spread"))
    spread = staged(long_runs.select("run", "u", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("s")), "spread")
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SPREAD)).cast("int")
    members = runs.where("n > 2").select("run", "b", "n", salt.alias("s")).join(spread, ["run", "s"])
    members = members.join(open_.withColumn("open", F.lit(True)), ["run", "b"], "left").select("run", F.col("b").alias("lid"), F.col("open").isNotNull().alias("is_open"), F.ceil(F.col("n") / BLOCK).cast("int").alias("mbs"), F.ceil(F.col("u") / BLOCK).cast("int").alias("ubs"))
    members = members.join(texts, "lid")
    at = F.xxhash64(F.lit(3), "lid")
    # Of a run that is one block each line goes once, of others the open lines go to the members' blocks as well.
    one = (F.col("ubs") == 1) & (F.col("mbs") == 1)
    side = F.when(one & F.col("is_open"), BOTH).otherwise(MEMBER)
    every = members.select("run", "lid", "line", side.alias("side"), F.explode(F.sequence(F.lit(0), F.col("ubs") - 1)).alias("ub"), F.pmod(at, F.col("mbs")).cast("int").alias("mb"))
    some = members.where(F.col("is_open") & ~one).select("run", "lid", "line", F.lit(OPEN).alias("side"), F.pmod(at, F.col("ubs")).cast("int").alias("ub"), F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"))
    bucket = F.pmod(F.xxhash64("run", "ub", "mb"), F.lit(2 * n_buckets))
    rest = every.unionByName(some).groupBy(bucket).applyInPandas(_block_verifier(threshold), "b long, a long").where("a <> b")
    return links.unionByName(rest)


def repeated_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, th, n) of the ids and texts that more than one row has."""
    rows = df.where(F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th")).agg(F.count("*").alias("n"))
    return staged(rows.where("n > 1"), "repeated")


def dropped_lines(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, th, line_no) of the lines that a smaller copy or near copy makes redundant.

    Rows that repeat an id and a text stand here as one; see repeated_rows for the others.
    """
    spark = df.sparkSession
    ship(spark)
    rows = line_rows(df, id_col, text_col)
    where = staged(rows.select("doc_id", "th", "line_no", line_hash(F.col("line")).alias("h")), "places")
    lines = rows.select(line_hash(F.col("line")).alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")
    lines = lines.groupBy("h").agg(F.any_value("line").alias("line"), F.min("h2").alias("low"), F.max("h2").alias("high"))
    name = f"corpusloom_lines_{uuid.uuid4().hex}"
    table = staged_buckets(lines.select(F.col("h").alias("lid"), "line", (F.col("low") != F.col("high")).alias("shared")), name, "lid")
    nodes = table.select("lid", "line")
    shared = table.where("shared").select(F.col("lid").alias("sh"))
    if shared.head(1):
        # Different lines with one hash: each gets one of its own, in both tables.
        own = F.xxhash64(F.lit(2), F.col("line"))
        apart = staged(rows.join(shared, line_hash(F.col("line")) == F.col("sh")).select("doc_id", "th", "line_no", own.alias("h"), "line"), "apart")
        where = staged(where.join(shared, F.col("h") == F.col("sh"), "left_anti").unionByName(apart.drop("line")), "places")
        nodes = staged(table.where("not shared").select("lid", "line").unionByName(apart.groupBy(F.col("h").alias("lid")).agg(F.any_value("line").alias("line"))), "lines")
    scrap: list[DataFrame] = []
    roots = staged(components(line_links(nodes, threshold, scrap), "b", "a"), "roots")
    placed = where.groupBy("h").agg(F.min(F.struct("doc_id", "th", "line_no")).alias("place"), F.count("*").alias("n"))
    grouped = staged(placed.join(roots, F.col("h") == F.col("node"), "left").select("h", F.coalesce("root", "h").alias("root"), "place", "n"), "grouped")
    spark.sql(f"DROP TABLE {name}")
    for done in [*scrap, roots, table]:
        unstage(done)
    best = grouped.groupBy("root").agg(F.min("place").alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1).withColumnRenamed("root", "r")
    many = grouped.join(best, F.col("root") == F.col("r")).select("h", "first")
    return where.join(many, "h").where(~(F.col("first") == F.struct("doc_id", "th", "line_no"))).select("doc_id", "th", "line_no")


def staged_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write df as a table in the shared folder, bucketed by key: joins on key move the other side only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, key).option("path", path).saveAsTable(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.table(name)
    out._corpusloom_path = path
    return out


def dedup_lines(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with redundant lines removed from its texts, and the column dropped_lines (their numbers).

    Repeated rows are numbered only where there are any; those of one id and text in one task, a row at a time.
    """
    gone = dropped_lines(df, threshold, id_col, text_col).groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__gone")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th"))
    lines = F.split(F.col(text_col), "\n", -1)
    out = df.join(gone, same, "left").drop("__id", "__th").withColumn("__all", F.lit(False))
    repeated = repeated_rows(df, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    if repeated.head(1):
        once = out.join(repeated, same, "left_anti")
        more = out.join(repeated.hint("shuffle_hash"), same)
        number = F.row_number().over(Window.partitionBy("__id", "__th").orderBy(F.lit(0)))
        out = once.unionByName(more.withColumn("__all", number > 1).drop("__id", "__th"))
    some = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].rlike(r"[^\s]")), lambda p: p["i"])
    out = out.withColumn("__gone", F.when(F.col("__all"), some).otherwise(F.col("__gone")))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    out = out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept))
    return out.withColumn("dropped_lines", F.coalesce(F.array_sort("__gone"), F.array().cast("array<int>"))).drop("__gone", "__all")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them go, and their numbers."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = dropped_lines(docs).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("lines")).withColumn("copy", F.lit(0).cast("long"))
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    sizes = docs.select("doc_id", F.xxhash64("text").alias("th"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("copy"))
    repeated = repeated_rows(docs).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("n").alias("__n"))
    if repeated.head(1):
        # Equal rows are told apart by number alone: they become one row each, of which the first keeps the document's lines.
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
        chunk = 4096
        more = sizes.join(repeated, same).groupBy("doc_id", "th", "n_lines", "__n").agg(F.max("copy")).select("doc_id", "th", "n_lines", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / chunk))).alias("__c"))
        more = more.select("doc_id", "th", "n_lines", F.explode(F.sequence(F.col("__c") * chunk, F.least(F.col("__n"), (F.col("__c") + 1) * chunk) - 1)).alias("copy"))
        sizes = sizes.join(repeated, same, "left_anti").unionByName(more)
        whole = line_rows(docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))).select("doc_id", "text"), "doc_id", "text")
        whole = whole.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("lines"))
        gone = gone.unionByName(more.where("copy > 0").select("doc_id", "th", "copy").join(whole.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "lines"), same).drop("__id", "__th"))
    gone = gone.select("doc_id", "th", "copy", F.size("lines").cast("long").alias("n_dropped"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("dropped"))
    same = sizes["doc_id"].eqNullSafe(gone["doc_id"]) & (sizes["th"] == gone["th"]) & (sizes["copy"] == gone["copy"])
    return sizes.join(gone, same, "left").select(sizes["doc_id"], "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("dropped", F.lit("")).alias("dropped"))
