"""A corpus pipeline: each stage calls one operator and works on all that the one before it kept.

Stages keep the columns of documents (the last returns pieces). A row is known
by its id and a hash of its text, so that rows that share an id do not mix.

Defined results: null ids and null sources are kept as they are; rows that repeat
an id and a text come out of the line stage once with text; null and empty texts
pass the quality stage by their score and the line stage unchanged, form one
group in the SimHash stage and are never taken by the mix; an empty table stays
empty; columns beyond those of documents pass all stages but the last, unless
their name starts with two underscores; one named dropped_lines is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import linededup, mixing, packing, quality, simhash
from corpusloom.llm.tokencount import public_path
from corpusloom.session import read_table, staged


def keep(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs that `named` has by (doc_id, th)."""
    named = named.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    same = docs["doc_id"].eqNullSafe(named["__id"]) & (F.xxhash64(docs["text"]) == named["__th"])
    return docs.join(named.hint("shuffle_hash"), same, "left_semi")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go; without labels all stay."""
    found = quality.featurised(docs)
    model = quality.fit(found, read_table(spark, sf_dir, "labels"))
    return keep(docs, quality.scored(found, model).where("score >= 0.5"))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redundant lines go, and with them documents that lose all their lines; of equal lines the first by id, null ids first, stays."""
    out = linededup.dedup_lines(docs)
    text = F.col("text")
    left = (F.size("dropped_lines") == 0) | text.rlike(r"[^\s]")
    return out.where(left).withColumn("n_chars", F.length(text).cast("long")).select(*docs.columns)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; a group without ids keeps one."""
    rows = simhash.near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = rows.groupBy("group", "doc_id").agg(F.min("th").alias("th")).select("doc_id", "th")
    kept = keep(docs, named).withColumn("__th", F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", "__th"]).drop("__th")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mix takes, repeats included; documents it leaves out go."""
    return mixing.mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, a null text being the end id alone."""
    return packing.pack(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("quality", stage_quality),
    ("lines", stage_lines),
    ("simhash", stage_simhash),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
