"""Traversal of a link graph.

edges: (src, dst, ordinal, kind), kind being internal or external, dst already
normalised. nodes: (url), the pages that can be fetched. Breadth-first runs as
one DataFrame job a level; a page's place is the path of link places that leads
to it, so no level is ever numbered through in one task. Depth-first and
best-first depend on each single step, so they run as a sequential walk over the
edges of one crawl, many crawls in parallel. Hooks (progress, cancelling,
resuming) work for all strategies: after each level, or each STEP pages of a walk.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import predicates, scorers
from corpusloom.functions.urls import base_domain, is_external_col
from corpusloom.plans.config import CrawlConfig
from corpusloom.session import ship, staged

RESULT = "url string, success boolean, error string, depth int, parent_url string, score double, visit long"
MISSING = "not in the corpus"
#: Pages of a walk between two calls of its hooks.
STEP = 1000
#: Pages of a walk that are held as Python rows at once.
HELD = 100_000


def _filters(c: CrawlConfig) -> predicates.Filter:
    return predicates.build(c.include_external, list(c.allowed_domains), list(c.blocked_domains), list(c.url_patterns), c.exclude_social_media)


def _scorer(c: CrawlConfig) -> scorers.Scorer | None:
    return scorers.build(list(c.keywords), c.prefer_fresh, c.optimal_depth, c.current_year)


def eligible(edges: DataFrame, c: CrawlConfig) -> DataFrame:
    """Edges that a crawl may follow, with their scores: scheme, scope, filters and threshold are all native."""
    kept = edges if c.include_external else edges.where("kind = 'internal'")
    kept = kept.where(predicates.can_process(F.col("dst"), F.lit(1), _filters(c)))
    scorer = _scorer(c)
    if not c.include_external:
        kept = kept.where(~is_external_col(F.col("dst"), F.lit(base_domain(c.start_urls[0]))))
    kept = kept.withColumn("score", scorer(F.col("dst")) if scorer else F.lit(0.0))
    if c.score_threshold is not None and (scorer or c.strategy == "best-first"):
        kept = kept.where(F.col("score") >= c.score_threshold)
    return kept.select("src", "dst", (F.when(F.col("kind") == "internal", 0).otherwise(1) * F.lit(1 << 40) + F.col("ordinal")).alias("link_ord"), "score")


def bfs(nodes: DataFrame, edges: DataFrame, c: CrawlConfig, on_progress: Callable[[dict], None] | None = None, should_cancel: Callable[[], bool] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Breadth-first, level by level. Order within a level: the parents' order, then link order.

    A page is marked at discovery, before truncation. Each level is written to
    the shared folder; with `checkpoint` (a folder there) a later call resumes.
    """
    spark = nodes.sparkSession
    has_scorer = _scorer(c) is not None
    links = staged(eligible(edges, c), "edges")
    pages = staged(nodes.select("url").distinct(), "pages").withColumn("ok", F.lit(True))  # read at every level
    state = {"depth": 0, "n": 0}
    saved = _load(spark, checkpoint)
    if saved:
        state, frontier, visited, levels = saved
    else:
        frontier = staged(spark.createDataFrame([([i], u, None) for i, u in enumerate(c.start_urls)], "ord array<long>, url string, parent_url string"), "frontier")
        visited, levels = frontier.select("url"), []
    while True:
        room = None if c.max_pages is None else c.max_pages - state["n"]
        if (should_cancel and should_cancel()) or (room is not None and room <= 0):
            break
        level = staged(frontier.join(pages, "url", "left").select("url", F.coalesce("ok", F.lit(False)).alias("ok"), "ord", "parent_url"), "level")
        count = level.agg(F.count("*").alias("all"), F.count_if("ok").alias("ok")).first()
        if not count["all"]:
            break
        # Of a level that reaches the cap only so many successes matter as there is room for.
        first = None if room is None or count["ok"] < room else level.where("ok").orderBy("ord").limit(room)
        if first is not None and c.cap_mode == "strict":
            level = staged(level.join(F.broadcast(first.agg(F.max("ord").alias("last"))), F.col("ord") <= F.col("last"), "left_semi"), "level")
            count = level.agg(F.count("*").alias("all"), F.count_if("ok").alias("ok")).first()
        levels.append(level.select("url", "ok", F.lit(state["depth"]).alias("depth"), "parent_url", "ord"))
        before, state["n"], state["depth"] = state["n"], state["n"] + count["ok"], state["depth"] + 1
        if state["depth"] > c.max_depth:
            break
        source = level.where("ok").withColumn("run", F.lit(None).cast("long"))
        if c.max_pages is not None:
            some = level.where("ok").orderBy("ord").limit(max(0, room - 1))
            source = some.withColumn("run", F.row_number().over(Window.orderBy("ord")).cast("long") + before)
        found = source.select(F.col("url").alias("src"), "ord", "run").join(links, "src").join(visited.withColumnRenamed("url", "dst"), "dst", "left_anti")
        found = found.groupBy("dst").agg(F.min_by(F.struct("ord", "link_ord", "src", "run", "score"), F.struct("ord", "link_ord")).alias("x")).select("dst", "x.*")
        place, fits = F.col("link_ord"), F.lit(True)
        if c.max_pages is not None:
            per = Window.partitionBy("ord")
            rank = (F.col("score").desc(), F.col("link_ord")) if has_scorer else (F.col("link_ord"),)
            found = found.withColumn("room", F.lit(c.max_pages) - F.col("run")).withColumn("cnt", F.count("*").over(per)).withColumn("rank", F.row_number().over(per.orderBy(*rank)))
            over = F.col("cnt") > F.col("room")
            fits, place = ~over | (F.col("rank") <= F.col("room")), F.when(over, F.col("rank").cast("long")).otherwise(F.col("link_ord"))
        found = staged(found.select("dst", "src", F.concat("ord", F.array(place)).alias("ord"), fits.alias("fits")), "found")
        fresh = found.select(F.col("dst").alias("url"))
        visited = visited.unionByName(fresh)
        frontier = found.where("fits").select("ord", F.col("dst").alias("url"), F.col("src").alias("parent_url"))
        if on_progress:
            on_progress({"pages_crawled": state["n"], "queued": frontier.count(), "depth": state["depth"]})
        _save(checkpoint, state, frontier, fresh, levels)
    if not levels:
        return spark.createDataFrame([], RESULT)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    out = numbered(out, ["depth", "ord"], "visit")
    return out.select("url", F.col("ok").alias("success"), F.when(~F.col("ok"), MISSING).alias("error"), "depth", "parent_url", F.lit(None).cast("double").alias("score"), "visit")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the row's number, from 0, in the given order: sorted ranges are numbered each by itself, then moved up."""
    mark, low = "__at", (1 << 33) - 1
    ranged = staged(df.orderBy(*order).withColumn(mark, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(mark, 33).alias("part")
    sizes = sorted(map(tuple, ranged.groupBy(part).agg(F.count("*").alias("n")).collect()))  # a row for each task of the sort
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    starts = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    joined = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__start") + F.col(mark).bitwiseAND(F.lit(low))).drop(mark, "__part", "__start")


def _save(checkpoint: str | None, state: dict, frontier: DataFrame, fresh: DataFrame, levels: list[DataFrame]) -> None:
    if not checkpoint:
        return
    spark = frontier.sparkSession
    at = f"{checkpoint.rstrip('/')}/round-{state['depth']}"
    frontier.write.mode("overwrite").parquet(f"{at}/frontier")
    fresh.write.mode("overwrite").parquet(f"{at}/found")
    levels[-1].write.mode("overwrite").parquet(f"{at}/level")
    # The state is written last: a round counts only when all of it is there.
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{at}/state")


def _load(spark: SparkSession, checkpoint: str | None):
    if not checkpoint:
        return None
    levels, last, d = [], None, 1
    while True:
        at = f"{checkpoint.rstrip('/')}/round-{d}"
        if not _exists(spark, f"{at}/state/_SUCCESS"):
            break
        levels.append(spark.read.parquet(f"{at}/level"))
        last, d = at, d + 1
    if last is None:
        return None
    state = json.loads(spark.read.text(f"{last}/state").first()[0])
    # What was seen: the first level, and what each round found.
    visited = levels[0].select("url")
    for i in range(1, d):
        visited = visited.unionByName(spark.read.parquet(f"{checkpoint.rstrip('/')}/round-{i}/found"))
    return state, spark.read.parquet(f"{last}/frontier"), visited, levels


class Graph:
    """One crawl's seeds, known pages and edges in memory, for the sequential walks."""

    def __init__(self, rows: pd.DataFrame):
        seed, page = rows["src"].isna(), rows["dst"].isna()
        self.score: dict[str, float] = {}
        self.seeds: list[str] = rows[seed].sort_values("link_ord", kind="stable")["dst"].tolist()
        self.known = set(rows.loc[page, "src"])
        self.links: dict[str, list[str]] = {}
        for src, dst, score in rows[~page].sort_values(["src", "link_ord"], kind="stable")[["src", "dst", "score"]].itertuples(index=False):
            self.score[dst] = float(score)
            if isinstance(src, str):
                self.links.setdefault(src, []).append(dst)


def walk_dfs(g: Graph, c: CrawlConfig, state: dict | None = None, most: int | None = None) -> tuple[list[tuple], dict | None]:
    """Last in, first out; a page is marked when it is taken. (rows, state to go on from; None at the end)."""
    state = state or {"todo": [[u, None, 0] for u in reversed(g.seeds)], "visited": [], "n": 0}
    stack, visited, n = state["todo"], dict.fromkeys(state["visited"]), state["n"]
    scored, out = _scorer(c) is not None, []
    while stack and (c.max_pages is None or n < c.max_pages):
        if most is not None and len(out) >= most:
            return out, {"todo": stack, "visited": list(visited), "n": n}
        url, parent, depth = stack.pop()
        if url in visited or depth > c.max_depth:
            continue
        ok = url in g.known
        out.append((url, ok, None if ok else MISSING, depth, parent, g.score[url] if scored and ok else None, len(visited)))
        visited[url] = None
        n += ok
        if ok and depth < c.max_depth:
            stack.extend([u, url, depth + 1] for u in reversed(g.links.get(url, ())) if u not in visited)
    return out, None


def walk_best_first(g: Graph, c: CrawlConfig, state: dict | None = None, most: int | None = None) -> tuple[list[tuple], dict | None]:
    """Highest score first, then the shallower, then by address; batches are taken whole before their links are known."""
    state = state or {"todo": [[-g.score[u], 0, u, i, None] for i, u in enumerate(g.seeds)], "visited": [], "n": 0, "pushed": len(g.seeds)}
    queue, visited, n, pushed = state["todo"], dict.fromkeys(state["visited"]), state["n"], state["pushed"]
    heapq.heapify(queue)  # equal entries leave in the order they came, by their number
    out: list[tuple] = []
    while queue and (c.max_pages is None or n < c.max_pages):
        if most is not None and len(out) >= most:
            return out, {"todo": queue, "visited": list(visited), "n": n, "pushed": pushed}
        batch, at = [], len(visited)
        while queue and len(batch) < c.batch:
            item = heapq.heappop(queue)
            if item[2] not in visited:
                visited[item[2]] = None
                batch.append(item)
        for i, (neg, depth, url, _, parent) in enumerate(batch):
            ok = url in g.known
            out.append((url, ok, None if ok else MISSING, depth, parent, -neg or 0.0, at + i))
            n += ok
            if c.max_pages is not None and n >= c.max_pages:
                return out, None
            if ok and depth < c.max_depth:
                for u in g.links.get(url, ()):
                    if u not in visited:
                        pushed += 1
                        heapq.heappush(queue, [-g.score[u], depth + 1, u, pushed, url])
    return out, None


def reachable(nodes: DataFrame, edges: DataFrame, crawls: dict[str, CrawlConfig]) -> DataFrame:
    """Rows (crawl_id, src, dst, link_ord, score) of all crawls: seeds (src null), known pages (dst null), and the edges that max_depth steps can use."""
    spark = nodes.sparkSession
    links, starts = None, None
    for name, c in crawls.items():
        scorer = _scorer(c)
        mine = eligible(edges, c).select(F.lit(name).alias("crawl_id"), F.lit(c.max_depth).alias("most"), "src", "dst", "link_ord", "score")
        seeds = spark.createDataFrame([(name, u, i) for i, u in enumerate(c.start_urls)], "crawl_id string, dst string, link_ord long")
        seeds = seeds.withColumn("score", scorer(F.col("dst")) if scorer else F.lit(0.0))
        links, starts = (mine, seeds) if links is None else (links.unionByName(mine), starts.unionByName(seeds))
    links = staged(links, "edges")
    # Step by step, each from the pages that the step before was the first to reach.
    front = starts.select("crawl_id", F.col("dst").alias("url")).distinct()
    near = front
    for step in range(max(c.max_depth for c in crawls.values())):
        out = links.where(F.col("most") > step).withColumnRenamed("src", "url").join(front, ["crawl_id", "url"], "left_semi").select("crawl_id", F.col("dst").alias("url"))
        front = staged(out.distinct().join(near, ["crawl_id", "url"], "left_anti"), "near")
        if front.isEmpty():
            break
        near = near.unionByName(front)
    near = staged(near, "near")
    known = near.join(nodes.select("url").distinct(), "url").select("crawl_id", F.col("url").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0).cast("long").alias("link_ord"), F.lit(0.0).alias("score"))
    some = links.withColumnRenamed("src", "url").join(near, ["crawl_id", "url"], "left_semi").select("crawl_id", F.col("url").alias("src"), "dst", "link_ord", "score")
    return starts.select("crawl_id", F.lit(None).cast("string").alias("src"), "dst", "link_ord", "score").unionByName(known).unionByName(some)


def _walker(crawls: dict[str, CrawlConfig], most: int | None):
    """Per crawl: rows of RESULT, and where `most` is given a last row with the state in error (url null)."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        c = crawls[key[0]]
        at = frame["state"].dropna()
        g = Graph(frame[frame["state"].isna()])
        step = walk_dfs if c.strategy == "dfs" else walk_best_first
        got, state = step(g, c, json.loads(at.iloc[0]) if len(at) else None, most)
        if most is not None:
            got.append((None, None, json.dumps(state), None, None, None, None))
        made = pd.DataFrame(got, columns=["url", "success", "error", "depth", "parent_url", "score", "visit"])
        made = made.astype({"depth": "Int64", "visit": "Int64", "success": "boolean"})
        made.insert(0, "crawl_id", key[0])
        return made

    return run


class Numbers:
    """One crawl's graph in arrays: addresses are numbers in their order, links of a page lie side by side."""

    def __init__(self, rows: pa.Table):
        src, dst = (rows.column(k).to_numpy() if not rows.column(k).null_count else rows.column(k).fill_null(-1).to_numpy() for k in ("src", "dst"))
        ord_, score = rows.column("link_ord").to_numpy(), rows.column("score").to_numpy()
        seeds, linked = np.flatnonzero(src < 0), np.flatnonzero((src >= 0) & (dst >= 0))
        n = int(max(src.max(initial=-1), dst.max(initial=-1))) + 1
        self.seeds = dst[seeds[np.argsort(ord_[seeds], kind="stable")]].tolist()
        self.known, self.score = self.Known(n), np.zeros(n)
        self.known.flags[src[dst < 0]] = True
        self.score[dst[dst >= 0]] = score[dst >= 0]
        linked = linked[np.lexsort((ord_[linked], src[linked]))]
        self.links = self.Links(np.searchsorted(src[linked], np.arange(n + 1)), dst[linked])

    class Known:
        def __init__(self, n: int):
            self.flags = np.zeros(n, bool)

        def __contains__(self, i: int) -> bool:
            return bool(self.flags[i])

    class Links:
        def __init__(self, starts: np.ndarray, dst: np.ndarray):
            self.starts, self.dst = starts, dst

        def get(self, i: int, none: tuple = ()) -> list[int] | tuple:
            return self.dst[self.starts[i] : self.starts[i + 1]].tolist() or none


NUMBERED = "crawl_id string, id long, success boolean, depth int, parent long, score double, visit long"


def _number_walker(crawls: dict[str, CrawlConfig]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        name = key[0].as_py()
        c = crawls[name]
        g, step, state, made = Numbers(rows), walk_dfs if crawls[name].strategy == "dfs" else walk_best_first, None, []
        types = (pa.int64(), pa.bool_(), None, pa.int32(), pa.int64(), pa.float64(), pa.int64())
        while True:
            got, state = step(g, c, state, HELD)
            columns = [pa.array([r[i] for r in got], t) for i, t in enumerate(types) if t is not None]
            made.append(pa.Table.from_arrays([pa.array([name] * len(got), pa.string()), *columns], names=["crawl_id", "id", "success", "depth", "parent", "score", "visit"]))
            if state is None:
                return pa.concat_tables(made)

    return run


def walk(nodes: DataFrame, edges: DataFrame, crawls: dict[str, CrawlConfig]) -> DataFrame:
    """Depth-first and best-first crawls, one task each, in parallel: rows (crawl_id, RESULT).

    Only the pages that a crawl can reach in max_depth steps go to its task, as
    numbers: addresses are numbered in their order before, and put back after.
    """
    ship(nodes.sparkSession)
    rows = staged(reachable(nodes, edges, crawls), "graph")
    every = rows.select(F.col("src").alias("url")).union(rows.select("dst")).where("url is not null").distinct()
    names = staged(numbered(every, ["url"], "id"), "names")
    named = lambda df, at, to: df.join(names.select(F.col("url").alias(at), F.col("id").alias(to)), at, "left")
    rows = named(named(rows, "src", "s"), "dst", "d").select("crawl_id", F.col("s").alias("src"), F.col("d").alias("dst"), "link_ord", "score")
    got = rows.groupBy("crawl_id").applyInArrow(_number_walker(crawls), NUMBERED)
    got = got.join(names, "id").join(names.select(F.col("url").alias("parent_url"), F.col("id").alias("parent")), "parent", "left")
    return got.select("crawl_id", "url", "success", F.when(~F.col("success"), MISSING).alias("error"), "depth", "parent_url", "score", "visit")


def walk_with_hooks(nodes: DataFrame, edges: DataFrame, c: CrawlConfig, on_progress: Callable[[dict], None] | None = None, should_cancel: Callable[[], bool] | None = None, checkpoint: str | None = None, step: int = STEP) -> DataFrame:
    """One depth-first or best-first crawl in rounds of `step` pages, with hooks after each; `checkpoint` resumes."""
    spark = nodes.sparkSession
    ship(spark)
    rows = staged(reachable(nodes, edges, {"crawl": c}).withColumn("state", F.lit(None).cast("string")), "graph")
    schema, done, state, i = "crawl_id string, " + RESULT, [], None, 0
    while checkpoint and _exists(spark, f"{checkpoint.rstrip('/')}/walk-{i}/_SUCCESS"):
        done.append(spark.read.schema(schema).parquet(f"{checkpoint.rstrip('/')}/walk-{i}"))
        state, i = done[-1].where("url is null").first()["error"], i + 1
    while state != "null" and not (should_cancel and should_cancel()):
        given = rows
        if state is not None:
            given = rows.unionByName(spark.createDataFrame([("crawl", None, None, None, None, state)], rows.schema))
        got = given.groupBy("crawl_id").applyInPandas(_walker({"crawl": c}, step), schema)
        if checkpoint:
            path = f"{checkpoint.rstrip('/')}/walk-{i}"
            got.write.mode("overwrite").parquet(path)
            got = spark.read.schema(schema).parquet(path)
        else:
            got = staged(got, "walk")
        done.append(got)
        state, i = got.where("url is null").first()["error"], i + 1
        if on_progress:
            left = json.loads(state)
            crawled = sum(d.where("success").count() for d in done[-1:]) if left is None else left["n"]
            on_progress({"pages_crawled": crawled, "queued": len(left["todo"]) if left else 0, "depth": got.agg(F.max("depth")).first()[0]})
    out = spark.createDataFrame([], schema)
    for d in done:
        out = out.unionByName(d)
    return out.where("url is not null").drop("crawl_id")


def _exists(spark: SparkSession, at: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def traverse(nodes: DataFrame, edges: DataFrame, config: CrawlConfig, **hooks) -> DataFrame:
    """Crawl by the configured strategy; hooks are on_progress, should_cancel and checkpoint."""
    if config.strategy == "bfs":
        return bfs(nodes, edges, config, **hooks)
    if any(v is not None for v in hooks.values()):
        return walk_with_hooks(nodes, edges, config, **hooks)
    return walk(nodes, edges, {"crawl": config}).drop("crawl_id")
