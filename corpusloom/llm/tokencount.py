"""Token counts: pieces are counted once per distinct pre-token.

Each batch of documents is cut into pre-tokens. The batch keeps its distinct
pre-tokens, dealt into hash buckets, and for each of these the documents that
hold it and how often. Bucket by bucket the distinct pre-tokens of all batches
are merged and each one's pieces are counted once; the counts go back to the
batches, where they are weighted by the frequencies and summed by document.
Token ids are never kept. A pre-token that stands in every document costs one
entry a batch, so no bucket is hot. A bucket's entries stream through its task
in Arrow batches; what the task keeps is one number for each distinct pre-token
of the bucket. There are at most MAX_BUCKETS buckets, so that the entries of a
batch stay dozens of pre-tokens long whatever the size of the corpus.

Pre-tokens come from a pattern that was compared with the tokenizer's own for
every code point; texts outside the code points where both agree go through
the tokenizer's own pre-tokenizer.

Defined results: a null text counts as empty and has 0 bytes and 0 tokens;
repeated rows each get their row; null ids stay null and take nothing from the
ids beside them; an empty table gives no rows; texts of any length are counted
whole; extra columns are ignored. No result depends on an order, so there are
no ties.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import read_table, ship, staged

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Code points on whose classes the pattern and the tokenizer agree.
AGREED = regex.compile("[\\0-՗֐-ࢎऀ-౛Ḁ-⁯₠-₿℀-⯿　-鿿가-힣＀-￯\U0001f300-\U0001faff]*+")
BATCH_DOCS, BATCH_CHARS = 4096, 16_000_000
MIN_BUCKETS, MAX_BUCKETS = 16, 4096
LIMIT = 1024
_loaded: dict = {}


def vocabulary(path: str):
    """The tokenizer of a file, loaded once in each process, on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _planes(a: np.ndarray) -> bytes:
    """Unsigned 16-bit numbers as two byte planes, compressed."""
    b = a.astype("<u2").view(np.uint8).reshape(-1, 2)
    return zstandard.compress(b.T.tobytes(), 1)


def _unplanes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(b.reshape(2, -1).T).view("<u2").ravel()


SPLIT_SCHEMA = "batch long, bucket int, doc_id array<long>, n_bytes array<long>, special binary, tokens binary, df binary, docs binary, freq binary"
_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64()))] + [(n, pa.binary()) for n in ("special", "tokens", "df", "docs", "freq")])


def _splitter(path: str, n_buckets: int):
    """mapInArrow function: documents to batch rows (bucket -1) and dictionary rows (one a bucket)."""

    def batch_rows(batch: int, ids: list, sizes: list, texts: list[str]) -> pa.RecordBatch:
        tok = vocabulary(path)
        specials = [t.content for t in tok.get_added_tokens_decoder().values()]
        cut = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        number: dict[str, int] = defaultdict(count().__next__)
        at, docs, freq = [], [], []
        special = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            segments = [text]
            if cut and any(s in text for s in specials):
                segments = cut.split(text)
                special[i] = len(segments) - 1
            if AGREED.fullmatch(text):
                pieces = PATTERN.findall(segments[0]) if len(segments) == 1 else [p for s in segments for p in PATTERN.findall(s)]
            else:
                pieces = [s[a:b] for s in segments for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(s)]
            u, c = np.unique(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)), return_counts=True)
            while (c > 65535).any():  # a frequency that needs more bits is kept in parts
                big = c > 65535
                at.append(u[big])
                docs.append(np.full(big.sum(), i, np.uint16))
                freq.append(np.full(big.sum(), 65535, np.uint16))
                c = np.where(big, c - 65535, c)
            at.append(u)
            docs.append(np.full(len(u), i, np.uint16))
            freq.append(c.astype(np.uint16))
        words = list(number)
        raw = [w.encode() for w in words]
        bucket = np.fromiter((hash_bytes(r) % n_buckets for r in raw), np.int64, len(raw))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        tokens = place[np.concatenate(at)] if at else np.empty(0, np.int64)
        by = np.argsort(tokens, kind="stable")
        rows = {n: [] for n in _ARROW.names}

        def put(**x):
            for n in rows:
                rows[n].append(x.get(n))

        all_df = np.bincount(tokens, minlength=len(words))
        put(batch=batch, bucket=-1, doc_id=ids, n_bytes=sizes, special=special.tobytes(), df=zstandard.compress(all_df.astype("<u4").tobytes(), 1), docs=_planes((np.concatenate(docs) if docs else tokens)[by]), freq=_planes((np.concatenate(freq) if freq else tokens)[by]))
        ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            part = [raw[j] for j in order[ends[b] : ends[b + 1]]]
            if part:
                lens = np.fromiter(map(len, part), "<u4", len(part)).tobytes()
                put(batch=batch, bucket=b, tokens=zstandard.compress(len(part).to_bytes(4, "little") + lens + b"".join(part), 1))
        return pa.RecordBatch.from_pydict(rows, schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, sizes, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            lens = np.concatenate([[0], np.cumsum(b.column(1).to_numpy(zero_copy_only=False))])
            a = 0
            while a < len(ids):
                e = min(len(ids), a + BATCH_DOCS, max(a + 1, int(np.searchsorted(lens, lens[a] + BATCH_CHARS, "right")) - 1))
                yield batch_rows(n, ids[a:e], sizes[a:e], texts.slice(a, e - a).to_pylist())
                n, a = n + 1, e

    return run


def hash_bytes(b: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b)


def _words(raw: bytes) -> list[bytes]:
    raw = zstandard.decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
    body = raw[4 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def _bucket_counter(path: str):
    """Per bucket: count each distinct pre-token once, and give each batch its counts in its own order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = vocabulary(path)
        found: dict[bytes, int] = {}
        for b in batches:
            lists = [_words(r) for r in b.column("tokens").to_pylist()]
            fresh = list(set().union(*lists).difference(found))
            for i in range(0, len(fresh), 20_000):
                part = fresh[i : i + 20_000]
                found.update(zip(part, map(len, tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False))))
            out = [zstandard.compress(np.fromiter(map(found.__getitem__, x), "<u4", len(x)).tobytes(), 1) for x in lists]
            yield pa.RecordBatch.from_arrays([b.column("batch"), b.column("bucket"), pa.array(out, pa.binary())], names=["batch", "bucket", "counts"])

    return run


def _summed(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """Per batch: frequencies times piece counts, summed by document. Ids stay in Arrow, so null ids change no others."""
    r = rows.select(["special", "df", "docs", "freq"]).to_pylist()[0]
    per = [np.frombuffer(zstandard.decompress(x), "<u4") for x in counts.sort_by("bucket").column("counts").to_pylist()]
    per = np.concatenate(per) if per else np.empty(0, "<u4")
    df = np.frombuffer(zstandard.decompress(r["df"]), "<u4")
    special = np.frombuffer(r["special"], np.int64)
    weights = np.repeat(per, df).astype(np.float64) * _unplanes(r["freq"])
    n = np.bincount(_unplanes(r["docs"]), weights, minlength=len(special)).astype(np.int64) + special
    ids, sizes = (rows.column(c).combine_chunks().flatten() for c in ("doc_id", "n_bytes"))
    return pa.table({"doc_id": ids, "n_bytes": sizes, "n_tokens": pa.array(n)})


def count_tokens(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens); vocab: the path of a tokenizer file on every executor."""
    spark = df.sparkSession
    ship(spark)
    n_buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    split = staged(docs.mapInArrow(_splitter(vocab, n_buckets), SPLIT_SCHEMA), "pretokens")
    words = split.where("bucket >= 0").select("batch", "bucket", "tokens")
    counts = words.groupBy("bucket").applyInArrow(_bucket_counter(vocab), "batch long, bucket int, counts binary")
    rows = split.where("bucket < 0").select("batch", "doc_id", "n_bytes", "special", "df", "docs", "freq")
    return rows.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(read_table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
