"""Mixing sources to target weights, in DataFrame functions only.

The words of each source form one stream (documents in hashed order), which is
packed into blocks of a fixed length. The mix is a row of slots, cut into output
shards. Each shard draws its source counts from the multinomial distribution of
the slots that the targets need: every slot of the shard takes the source in
whose share a hash falls. Over all shards a source draws a few slots more or
less than its quota; what is drawn beyond quotas is dealt to the sources that
drew less, in the same shards, so that each source ends at its target.

The slots of a source are numbered through, shard by shard. Slot k is in pass
k // B of the source's B blocks, and reads block p(k mod B), p being a
pseudorandom permutation of its own for each pass, so that no block is read
twice in a pass. The last pass, if the target ends within it, takes full blocks
only, as far as there are any, and of its last block as many words as the target
still lacks. Slots and blocks meet in one join by block index.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source of its own and comes last; where all sizes are 0 all
targets are 0; repeated rows are separate documents, and share what the mix
takes in either order; null ids are kept; an empty table gives no rows; other
columns are ignored. Targets are capped at `max_passes` times a source's size
and the excess is shared again by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import permuted, running
from corpusloom.session import read_table, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MAX_PASSES = 1.5, 2
BLOCK_WORDS, SHARD_SLOTS = 256, 1024
#: Into how many cells (as a power of two) the draws are cut to find their source, and the sources up to which a join may broadcast them.
CELL_BITS, FEW_SOURCES = 12, 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """Per source (source, source_size): its number sid, weight and target in words.

    Sharing the excess again until nobody is above the cap ends at
    target = min(cap, level * weight) with one level for all: sources reach
    their caps in the order of cap / weight, so running sums find it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("sid", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid"), F.lit(len(weights))) + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_passes)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The level with the first i sources capped rises as long as the next one is capped too, and falls after.
    s = s.withColumn("level", F.max("level").over(everything))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "sid", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per source that takes words: blocks, quota of slots, slots of whole passes, words left for the last one, share of all draws."""
    s = sources.withColumn("words", F.round("target").cast("long")).where("words > 0")
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(block_words))).withColumn("full_blocks", F.floor(F.col("source_size") / F.lit(block_words)))
    whole = F.floor(F.col("words") / F.col("source_size"))
    rest = F.col("words") - whole * F.col("source_size")
    s = s.withColumn("whole_slots", whole * F.col("n_blocks")).withColumn("quota", F.col("whole_slots") + F.ceil(rest / F.lit(block_words)))
    s = s.withColumn("last_words", rest - F.greatest(F.ceil(rest / F.lit(block_words)) - 1, F.lit(0)) * block_words)
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("low", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    return s.select("sid", "n_blocks", "full_blocks", "whole_slots", "quota", "last_words", "low")


def shard_counts(needed: DataFrame, total: int, n_sources: int, shard_slots: int = SHARD_SLOTS, seed: int = 42) -> DataFrame:
    """Multinomial draws: rows (shard, sid, drawn), how many slots of each shard fall to each source."""
    cells = 1 << CELL_BITS
    # Source s has the draws from low to low + quota out of all; a cell knows the sources that reach into it.
    cell_of = lambda at: F.floor(at.cast("decimal(38,0)") * cells / F.lit(total).cast("decimal(38,0)")).cast("long")
    high = F.col("low") + F.col("quota") - 1
    by_cell = needed.select("sid", "low", F.explode(F.sequence(cell_of(F.col("low")), cell_of(high))).alias("cell"))
    by_cell = by_cell.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("low", "sid"))).alias("reach"))
    spark = needed.sparkSession
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total))
    draws = spark.range(0, total, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))).select(F.floor(F.col("id") / shard_slots).alias("shard"), draw.alias("u"))
    draws = draws.withColumn("cell", cell_of(F.col("u")))
    by_cell = F.broadcast(by_cell) if n_sources <= FEW_SOURCES else by_cell.hint("shuffle_hash")
    found = draws.join(by_cell, "cell").select("shard", F.element_at(F.filter("reach", lambda x: x["low"] <= F.col("u")), -1)["sid"].alias("sid"))
    return found.groupBy("shard", "sid").agg(F.count("*").alias("drawn"))


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 42) -> DataFrame:
    """The mix: rows (shard, slot, sid, pass_no, block, room); room: how many of the block's words the slot takes at most."""
    needed = staged(quotas(sources, block_words), "quotas")
    size = needed.agg(F.sum("quota").alias("total"), F.count("*").alias("n")).first()
    empty = "shard long, slot long, sid long, pass_no long, block long, room long"
    if not size["total"]:
        return sources.sparkSession.createDataFrame([], empty)
    small = F.broadcast if size["n"] <= FEW_SOURCES else (lambda df: df.hint("shuffle_hash"))
    counts = staged(shard_counts(needed, size["total"], size["n"], shard_slots, seed), "drawn")
    # Number each source's draws through, shard by shard; those from the quota on are dealt to others.
    n = counts.count()
    first = running(counts, ["sid"], ["shard"], F.col("drawn"), n, "first").join(small(needed.select("sid", "quota")), "sid")
    kept = F.greatest(F.lit(0), F.least(F.col("drawn"), F.col("quota") - F.col("first")))
    first = staged(first.withColumn("kept", kept).withColumn("over", F.col("drawn") - kept), "kept")
    # Sources whose draws end below their quota lack the numbers from there on; both sides are numbered from 0.
    drawn = counts.groupBy("sid").agg(F.sum("drawn").alias("all"))
    lack = needed.join(drawn, "sid", "left").select("sid", F.coalesce("all", F.lit(0)).alias("from"), (F.col("quota") - F.coalesce("all", F.lit(0))).alias("lack")).where("lack > 0")
    start = F.coalesce(F.sum("lack").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lack = lack.withColumn("start", start).select("sid", F.posexplode(F.sequence(F.col("from"), F.col("from") + F.col("lack") - 1)).alias("i", "k"), "start")
    lack = lack.select("sid", "k", (F.col("start") + F.col("i")).alias("e"))
    over = first.where("over > 0").select("shard", "sid", "over")
    over = running(over.withColumn("one", F.lit(0)), ["one"], ["shard", "sid"], F.col("over"), n, "e0")
    over = over.select("shard", F.explode(F.sequence(F.col("e0"), F.col("e0") + F.col("over") - 1)).alias("e"))
    dealt = over.join(lack.hint("merge"), "e").select("shard", "sid", "k")
    # Few rows become many here, so they are dealt over all tasks first.
    width = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = first.where("kept > 0").repartition(width, "shard").select("shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("kept") - 1)).alias("k"))
    k = own.unionByName(dealt).join(small(needed), "sid")
    in_whole, pass_no = F.col("k") < F.col("whole_slots"), F.floor(F.col("k") / F.col("n_blocks"))
    i = F.when(in_whole, F.pmod(F.col("k"), F.col("n_blocks"))).otherwise(F.col("k") - F.col("whole_slots"))
    pass_no = F.when(in_whole, pass_no).otherwise(F.floor(F.col("whole_slots") / F.col("n_blocks")))
    k = k.withColumn("i", i).withColumn("pass_no", pass_no.cast("long")).withColumn("among", F.when(in_whole, F.col("n_blocks")).otherwise(F.col("full_blocks")))
    # Beyond the full blocks there is the short one.
    block = F.when(F.col("i") < F.col("among"), permuted(F.col("i"), F.greatest(F.col("among"), F.lit(1)), [F.lit(seed + 1), F.col("sid"), F.col("pass_no")])).otherwise(F.col("i"))
    last = ~in_whole & (F.col("k") == F.col("quota") - 1)
    k = k.withColumn("block", block).withColumn("room", F.when(last, F.col("last_words")).otherwise(F.lit(block_words)).cast("long"))
    # Within its shard a slot's place is drawn by a hash.
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "sid", "k"), "sid", "k")) - 1
    return k.select("shard", place.cast("long").alias("slot"), "sid", "pass_no", "block", "room")


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Cut each document's stretch of its source's stream at block ends: (.., block, word_start, n_words)."""
    end = F.col("start") + F.col("size")
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.lit(block_words)), F.floor((end - 1) / F.lit(block_words)))))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(end, (F.col("block") + 1) * block_words)
    return cut.withColumn("word_start", low - F.col("start")).withColumn("n_words", high - low)


def planned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents with size, source number and stream offset; sources with targets), both staged."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = staged(df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = staged(targets(per), "targets")
    placed = running(rows, ["source"], ["doc_id", "th", "size"], F.col("size"), rows.count(), "start")
    named = sources.select(F.col("source").alias("__source"), "sid", "source_size", "target")
    return staged(placed.join(named, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source"), "placed"), sources


def read_words() -> Column:
    """How many words of a piece a slot takes that has room for the first `room` words of the block."""
    return F.greatest(F.lit(0), F.least(F.col("n_words"), F.col("room") - (F.col("start") + F.col("word_start") - F.col("block") * BLOCK_WORDS)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (shard, slot, sid, pass_no, block, doc_id, th, start, word_start, n_words): what each slot reads."""
    rows, sources = planned(df, id_col, text_col, source_col)
    # Sizes after explode are underestimated; the hints keep such sides from being broadcast.
    p = pieces(rows).select("sid", "block", "doc_id", "th", "start", "word_start", "n_words")
    out = slots(sources).hint("merge").join(p, ["sid", "block"]).withColumn("n_words", read_words())
    return out.where("n_words > 0").drop("room")


def taken(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: how many of its words the mix takes, repeats counted."""
    rows, sources = planned(df, id_col, text_col, source_col)
    # A block's readers are at most one a pass: their rooms fit in one row.
    rooms = slots(sources).groupBy("sid", "block").agg(F.collect_list("room").alias("rooms")).hint("merge")
    got = pieces(rows).join(rooms, ["sid", "block"]).select("sid", "start", "doc_id", "word_start", "n_words", "block", F.explode("rooms").alias("room"))
    got = got.groupBy("sid", "start", "doc_id").agg(F.sum(read_words()).alias("taken"))
    # Documents of size 0 share a start with the one after them but take no words.
    got = got.select(F.col("sid").alias("__s"), F.col("start").alias("__p"), F.col("doc_id").alias("__d"), "taken")
    same = (F.col("sid") == F.col("__s")) & (F.col("start") == F.col("__p")) & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("size") > 0)
    return rows.join(got.hint("merge"), same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df with each text cut to the words that the mix takes, pass after pass; documents it leaves out go.

    White space after a word stays with it. Rows that repeat an id and a text
    come out as one, with the words taken of all of them.
    """
    picks = mix(df, id_col, text_col, source_col).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("pass_no", "start", "word_start", "n_words"))).alias("__picks"))
    picks = picks.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__picks")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th"))
    joined = df.join(picks.hint("shuffle_hash"), same).dropDuplicates([id_col, "__th"])
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))

    def joined_text(w: Column) -> Column:
        piece = lambda p: F.array_join(F.slice(w, (p["word_start"] + 1).cast("int"), p["n_words"].cast("int")), "")
        one_pass = lambda i: F.array_join(F.transform(F.filter("__picks", lambda p: p["pass_no"] == i), piece), "")
        # A pass that ends in mid-line is closed by a newline before the next one starts.
        return F.array_join(F.filter(F.array(*[one_pass(i) for i in range(MAX_PASSES)]), lambda x: x != ""), "\n")

    # The lambda's argument holds the words, so that a text is cut once and not again for each piece.
    text = F.transform(F.array(words), joined_text)[0]
    return joined.withColumn(text_col, text).drop("__id", "__th", "__picks")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
