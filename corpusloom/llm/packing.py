"""Packing into windows by non-negative least squares over length combinations.

Each document is tokenised once. Whole windows are cut from its front; what
remains has a length below the window. The histogram of these lengths (at most
one number for each length) goes to the driver. Shallow combinations that fill
a window exactly are enumerated: k times a and once the rest (k up to 4), and
three different lengths that the histogram has. Non-negative least squares finds
how often to repeat each so that the histogram is used up; the counts are
rounded and topped up greedily, as far as lengths last; what is left is packed
greedily into one stream that is cut at window ends. Only the last window of
that stream has padding. `Plan.placed` is the share of remainders that the
combinations place.

A document's rank among those of its length decides its place, so every
document finds its windows alone.

Defined results: a null text counts as empty and has the end id alone; texts of
any length are packed whole; repeated rows are packed each; null ids stay null
and take nothing from the ids beside them; documents of equal length are ranked
by their place in the table; an empty table gives no rows; extra columns are
ignored. Ids of vocabularies over 65,536 entries are kept in 32 bits.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import running
from corpusloom.llm.tokencount import public_path, vocabulary
from corpusloom.session import read_table, ship, staged

WINDOW, END_ID, DEPTH = 2048, 1, 4
#: Chunks whose ids a worker keeps; it starts anew when that is full.
CACHE = 1_000_000
#: Characters that normalisation leaves alone but for lower case, which all parts here agree on.
PLAIN = regex.compile("[\\x21-\\x7e\\xa1-\\u012f\\u0131-\\u024f]++")
#: The same, white space included and apostrophes (which start endings like 's) not; what a text must not hold to be plain.
NOT_PLAIN = r"[^\x09-\x0d\x20-\x26\x28-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]|<\|"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class ChunkEncoder:
    """Ids of texts by their chunks between ASCII white space, each encoded once while it is kept.

    Only for tokenizers that lower-case, drop white space and never look across
    it, and that cut words by WORD: then a text's ids are those of its chunks,
    and a plain chunk's ids those of its words, which a copy of the tokenizer
    without normaliser encodes at half the cost. Other chunks, and special
    strings, go through the tokenizer as they are. Arrow lower-cases plain
    texts, sets commas and full stops after letters apart, splits all texts and
    numbers their distinct chunks, so Python sees each chunk once a batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = vocabulary(path)
        bare = json.loads(self.full.to_str())
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        suffix = bare["model"]["end_of_word_suffix"]
        ends = [i for t, i in self.bare.get_vocab().items() if t.endswith(suffix)]
        entries = max([self.full.get_vocab_size(with_added_tokens=True), *(i + 1 for i in self.full.get_vocab().values())])
        self.dtype = id_type(entries)
        self.ends = np.zeros(entries, bool)
        self.ends[ends] = True
        self.known: dict[str, bytes] = {"": b""}

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 10_000):
            for e in self.full.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False):
                yield np.array(e.ids, self.dtype).tobytes()

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of single words, many in one call: each word's last token, and no other, ends a word."""
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            ids = np.array(self.bare.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(cuts) != len(part):  # a word whose last token does not end it: each word by itself
                yield from self._whole(part)
                continue
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist()))

    def _learn(self, missing: list[str]) -> None:
        words, compound, other = set(), {}, []
        for c in missing:
            if not (c.isascii() or PLAIN.fullmatch(c)) or "<|" in c or not c.isprintable():
                other.append(c)
            elif c.isalpha() and c == c.lower():
                words.add(c)
            else:
                compound[c] = WORD.findall(c.lower())
        known = self.known
        words = list(words.union(*compound.values()).difference(known))
        known.update(zip(words, self._words(words)))
        known.update((c, b"".join([known[w] for w in ws])) for c, ws in compound.items())
        known.update(zip(other, self._whole(other)))

    def encode(self, texts: pa.Array, end_id: int | None) -> list[bytes]:
        """Each text's ids as little-endian unsigned numbers of `dtype`."""
        plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"(\pL)([.,])", r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, NOT_PLAIN), texts, plain))
        coded = lists.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        missing = [c for c, v in zip(distinct, found) if v is None]
        if missing:
            if len(self.known) + len(missing) > CACHE:
                self.known = {"": b""}
            self._learn(missing)
            found = [self.known[c] if v is None else v for c, v in zip(distinct, found)]
        ids = np.empty(len(found), object)
        ids[:] = found
        parts = ids[coded.indices.to_numpy()].tolist()
        end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        ends = lists.offsets.to_pylist()
        return [b"".join(parts[a:b]) + end for a, b in zip(ends, ends[1:])]


def id_type(entries: int) -> str:
    """The narrowest unsigned type that holds the ids of a vocabulary."""
    return "<u2" if entries <= 1 << 16 else "<u4"


_encoders: dict[str, ChunkEncoder] = {}


def _tokeniser(path: str, end_id: int):
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = ChunkEncoder(path)
        width = np.dtype(_encoders[path].dtype).itemsize
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                ids = _encoders[path].encode(part.column(1), end_id)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + n), pa.int64()), part.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)
                rid += n

    return run


def combinations(window: int, lengths: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Every shallow combination that fills the window, a row of up to depth + 1 ascending lengths padded by zeros.

    k times a and once the rest, for all lengths, and three different ones out of `lengths`.
    """
    found = set()
    for k in range(1, depth + 1):
        for a in range(1, window // k + 1):
            rest = window - k * a
            if a < window and (rest or k > 1):
                found.add(tuple(sorted([0] * (depth - k) + [a] * k + [rest])))
    rows = [np.array(sorted(found), np.int64).reshape(-1, depth + 1)]
    has = np.zeros(window, bool)
    has[lengths] = True
    for a in np.unique(lengths).tolist():
        b = np.arange(a + 1, (window - a + 1) // 2)  # a < b < c
        b = b[has[b] & has[window - a - b]]
        three = np.zeros((len(b), depth + 1), np.int64)
        three[:, -3], three[:, -2], three[:, -1] = a, b, window - a - b
        rows.append(three)
    return np.concatenate(rows)


def nnls(combos: np.ndarray, h: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 with least squares distance of the used lengths to h, by accelerated projected gradients."""
    n, columns = len(h), [c for c in combos.T if c.any()]

    def used(x: np.ndarray) -> np.ndarray:
        u = sum((np.bincount(c, x, n) for c in columns), np.zeros(n))
        u[0] = 0
        return u

    def back(r: np.ndarray) -> np.ndarray:
        r = np.concatenate([[0], r[1:]])
        return sum((r[c] for c in columns), np.zeros(len(combos)))

    v, top = np.ones(len(combos)), 1.0
    for _ in range(30):
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top or 1.0
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - back(used(y) - h) / (top * 1.02))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


class Plan:
    """Where the j-th remainder of each length goes, and how many windows each part takes."""

    def __init__(self, hist: dict[int, int], full: dict[int, int], window: int):
        self.window = window
        h = np.zeros(window, np.int64)
        for length, n in hist.items():
            h[length] = n
        h[0] = 0
        combos = combinations(window, np.flatnonzero(h))
        left, repeats = h.copy(), {}
        x = nnls(combos, h.astype(float)) if h.any() and len(combos) else np.zeros(len(combos))
        order = np.argsort(-x, kind="stable")
        for most in (np.rint(x).astype(np.int64), None):  # rounded counts first, then whatever still fits
            at = order if most is None else order[most[order] > 0]
            # Of combinations that lack a length from the start none can be used.
            for p in at[((combos[at] == 0) | (left[combos[at]] > 0)).all(axis=1)].tolist():
                need = Counter(c for c in combos[p].tolist() if c)
                n = min(int(left[c]) // m for c, m in need.items())
                n = n if most is None else min(n, int(most[p]))
                if n > 0:
                    repeats[p] = repeats.get(p, 0) + n
                    for c, m in need.items():
                        left[c] -= n * m
        self.placed = 1 - int(left.sum()) / max(1, int(h.sum()))
        self.full_base = np.zeros(window, np.int64)
        base = 0
        for length in range(window):
            self.full_base[length] = base
            base += full.get(length, 0)
        slots: dict[int, list[tuple[int, int, int]]] = {}
        for p, times in repeats.items():
            at = 0
            for length in combos[p][combos[p] > 0].tolist():
                slots.setdefault(length, []).append((times, base, at))
                at += length
            base += times
        self.ends = {n: np.cumsum([s[0] for s in v]) for n, v in slots.items()}
        self.slots = {n: (np.array([s[1] for s in v]), np.array([s[2] for s in v])) for n, v in slots.items()}
        self.stream_base = base
        sizes = left * np.arange(window)
        self.stream_at = np.concatenate([[0], np.cumsum(sizes)])

    def remainder(self, length: int, j: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset) of each piece."""
        ends = self.ends.get(length)
        used = int(ends[-1]) if ends is not None else 0
        if j < used:
            i = int(np.searchsorted(ends, j, "right"))
            seq, at = self.slots[length]
            return [(0, length, int(seq[i]) + j - (int(ends[i - 1]) if i else 0), int(at[i]))]
        pos, out, start = int(self.stream_at[length]) + (j - used) * length, [], 0
        while start < length:
            offset = pos % self.window
            n = min(length - start, self.window - offset)
            out.append((start, n, self.stream_base + pos // self.window, offset))
            start, pos = start + n, pos + n
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _placer(plan: Plan, with_ids: bool):
    """mapInArrow function: tokenised documents with their ranks to pieces; ids of documents stay in Arrow."""
    w = plan.window
    names = [x.split()[0] for x in PIECES.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out, texts = [], [], []
            for i, (n, raw, j, windows) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n", "ids", "j", "windows_before")))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                whole, length = divmod(n, w)
                first = int(plan.full_base[length] + windows)
                places = [(k * w, w, first + k, 0) for k in range(whole)]
                if length:
                    places += [(whole * w + s, m, q, o) for s, m, q, o in plan.remainder(length, j)]
                for s, m, q, o in places:
                    piece = ids[s : s + m]
                    rows.append(i)
                    out.append((s, m, zlib.crc32(piece.tobytes()), n, q, o))
                    if with_ids:
                        texts.append(piece)
            made = [b.column("doc_id").take(pa.array(rows, pa.int64()))] + [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))]
            if with_ids:
                made.append(pa.array(texts, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", *names] + ["ids"] * with_ids)

    return run


def pack(df: DataFrame, vocab: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece (see PIECES); with_ids adds its token ids as an array."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = staged(docs.mapInArrow(_tokeniser(vocab, end_id), "rid long, doc_id long, n long, ids binary"), "ids")
    lengths = t.select("rid", F.pmod("n", F.lit(window)).alias("rem"), F.floor(F.col("n") / F.lit(window)).alias("full"))
    rows = lengths.groupBy("rem").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()
    plan = Plan({r["rem"]: r["n"] for r in rows}, {r["rem"]: r["full"] for r in rows}, window)
    total = sum(r["n"] for r in rows)
    placed = running(running(lengths, ["rem"], ["rid"], F.lit(1), total, "j"), ["rem"], ["rid"], F.col("full"), total, "windows_before")
    placed = placed.select(F.col("rid").alias("prid"), "j", "windows_before")
    joined = t.join(placed.hint("shuffle_hash"), F.col("rid") == F.col("prid")).select("doc_id", "n", "ids", "j", "windows_before")
    return joined.mapInArrow(_placer(plan, with_ids), PIECES + (", ids array<long>" if with_ids else ""))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
