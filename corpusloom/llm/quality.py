"""Quality classifier: a generalised additive model with pairwise interactions.

Features are read off the whole text's bytes and words. Each is binned at
quantiles. Boosting goes round the features in turn: a shallow tree over one
feature's bins fits the current gradient and is added, shrunk, to that
feature's lookup table. Then the pairs whose coarse cells explain most of what
is left get tables of their own, fitted the same way by trees that cut both
axes. A score is the sum of table entries at a text's bins, through the
logistic function.

The model is fitted on the driver from at most MAX_FIT labelled texts (those
first by hash of the id; a parameter), and only from ids whose crc32 is not 1
modulo 3. Features and scores cover every text.

Defined results: null and empty texts have all features 0 and a score like any
other; without labels of both kinds every score is the smoothed share of label
1 (0.5 without labels); null labels are not learned from; a null id is never
held out; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import first_by_hash
from corpusloom.session import read_table, ship, staged

MAX_FIT = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 120, 40, 10, 0.1
#: Characters whose rates among all bytes are features of their own.
MARKS = "!|*$#%&.,;:?<>-_/@\"'()[]{}=+"
NAMES = ["log_bytes", "space", "upper", "lower", "digit", "high_byte", "control", "newline", "punctuation", *[f"mark_{c}" for c in MARKS], "word_length", "word_spread", "long_words", "distinct_words", "marked_words", "line_words", "distinct_lines", "capital_words"]

_codes = np.arange(256)
_CLASSES = np.stack([
    (_codes == 32) | ((_codes >= 9) & (_codes <= 13)),
    (_codes >= 65) & (_codes <= 90),
    (_codes >= 97) & (_codes <= 122),
    (_codes >= 48) & (_codes <= 57),
    _codes >= 128,
    (_codes < 9) | ((_codes > 13) & (_codes < 32)) | (_codes == 127),
    _codes == 10,
    ((_codes >= 33) & (_codes <= 47)) | ((_codes >= 58) & (_codes <= 64)) | ((_codes >= 91) & (_codes <= 96)) | ((_codes >= 123) & (_codes <= 126)),
    *[_codes == ord(c) for c in MARKS],
]).astype(np.float32)
_ALNUM = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])


def features(text: bytes) -> np.ndarray:
    """One number for each of NAMES."""
    out = np.zeros(len(NAMES), np.float32)
    if not text:
        return out
    b = np.frombuffer(text, np.uint8)
    counts = np.bincount(b, minlength=256).astype(np.float32)
    out[0] = np.log1p(len(b))
    out[1 : 1 + len(_CLASSES)] = _CLASSES @ counts / len(b)
    words = text.split()
    if words:
        lens = np.fromiter(map(len, words), np.float32, len(words))
        distinct = set(words)
        lines = [x for x in text.split(b"\n") if x.strip()]
        at = 1 + len(_CLASSES)
        # Last bytes that are no letter or digit, and first bytes that are capitals, from the bytes around white space.
        white = _CLASSES[0].astype(bool)[b]
        starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
        ends = np.flatnonzero(~white & np.concatenate([white[1:], [True]]))
        n = len(words)
        out[at:] = (
            lens.mean(), lens.std(), (lens > 20).mean(), len(distinct) / n, (~_ALNUM[b[ends]]).mean(), np.log1p(n / len(lines)), len(set(lines)) / len(lines),
            ((b[starts] >= 65) & (b[starts] <= 90)).mean(),
        )
    return out


def _featuriser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, 1024):
            part = b.slice(a, 1024)
            x = [features(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x, pa.binary())], names=["doc_id", "th", "x"])


class Gam:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE):
        n, d = x.shape
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        self.edges: list[np.ndarray] = [np.empty(0)] * d
        self.tables: list[np.ndarray] = [np.zeros(1)] * d
        self.pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        if n == 0 or y.min() == y.max():
            return
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        b = [np.searchsorted(self.edges[j], x[:, j], "right") for j in range(d)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(n, self.base)
        for _ in range(rounds):
            for j in range(d):
                if len(self.edges[j]) == 0:
                    continue
                step = self._tree(b[j], len(self.tables[j]), y, score) * rate
                self.tables[j] += step
                score += step[b[j]]
        coarse_edges = [e[:: max(1, -(-len(e) // 7))] for e in self.edges]
        coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse_edges)]
        g, h = self._gradient(y, score)
        gain = []
        for i in range(d):
            for j in range(i + 1, d):
                if len(coarse_edges[i]) and len(coarse_edges[j]):
                    cell = coarse[i] * 8 + coarse[j]
                    gs, hs = np.bincount(cell, g, 64), np.bincount(cell, h, 64)
                    gain.append((float((gs * gs / (hs + 5)).sum()), i, j))
        for _, i, j in sorted(gain, reverse=True)[:pairs]:
            self.pairs.append((i, j, coarse_edges[i], coarse_edges[j], np.zeros((8, 8))))
        for _ in range(pair_rounds):
            for i, j, _, _, table in self.pairs:
                step = self._pair_tree(coarse[i], coarse[j], y, score) * rate
                table += step
                score += step[coarse[i], coarse[j]]

    @staticmethod
    def _gradient(y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    def _tree(self, b: np.ndarray, n: int, y: np.ndarray, score: np.ndarray, depth: int = 2, ridge: float = 2.0) -> np.ndarray:
        """A tree of the given depth over one feature's bins, as a table of leaf values."""
        g, h = self._gradient(y, score)
        gs, hs = np.bincount(b, g, n), np.bincount(b, h, n)
        out = np.zeros(n)

        def grow(lo: int, hi: int, left: int) -> None:
            g_all, h_all = gs[lo:hi].sum(), hs[lo:hi].sum()
            if left and hi - lo > 1:
                cg, ch = np.cumsum(gs[lo : hi - 1]), np.cumsum(hs[lo : hi - 1])
                gain = cg**2 / (ch + ridge) + (g_all - cg) ** 2 / (h_all - ch + ridge)
                k = int(np.argmax(gain))
                if gain[k] > g_all**2 / (h_all + ridge) + 1e-9:
                    grow(lo, lo + k + 1, left - 1)
                    grow(lo + k + 1, hi, left - 1)
                    return
            out[lo:hi] = g_all / (h_all + ridge)

        grow(0, n, depth)
        return out

    def _pair_tree(self, bi: np.ndarray, bj: np.ndarray, y: np.ndarray, score: np.ndarray, ridge: float = 5.0) -> np.ndarray:
        """The best cut of both axes into four cells, as an 8 by 8 table."""
        g, h = self._gradient(y, score)
        gs, hs = (np.bincount(bi * 8 + bj, v, 64).reshape(8, 8).cumsum(0).cumsum(1) for v in (g, h))

        def cells(s: np.ndarray) -> list[np.ndarray]:
            a = s[:7, :7]
            top, left = s[:7, 7:], s[7:, :7]
            return [a, top - a, left - a, s[7, 7] - top - left + a]

        values = [(cg, ch) for cg, ch in zip(cells(gs), cells(hs))]
        gain = sum(cg**2 / (ch + ridge) for cg, ch in values)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        v = [cg[i, j] / (ch[i, j] + ridge) for cg, ch in values]
        out = np.empty((8, 8))
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: table entries added up by bin."""
        s = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            if len(e):
                s += t[np.searchsorted(e, x[:, j], "right")]
        for i, j, ei, ej, t in self.pairs:
            s += t[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return 1 / (1 + np.exp(-s))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(found: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Gam:
    """The model from features (doc_id, x) and labels (doc_id, quality) of ids that are not held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("lid")))
    known = found.join(marked, F.col("doc_id") == F.col("lid")).select("x", "y", "doc_id")
    rows = first_by_hash(known, known.count(), max_fit, "doc_id", "y", "x").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, len(NAMES))
    return Gam(x, np.array([r["y"] for r in rows], float))


def _scorer(model: Gam):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(x))], names=["doc_id", "th", "score"])

    return run


def featurised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, th, x); th, a hash of the text, tells rows that share an id apart."""
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.xxhash64(text_col).alias("th"))
    return staged(docs.mapInArrow(_featuriser, "doc_id long, th long, x binary"), "features")


def scored(found: DataFrame, model: Gam) -> DataFrame:
    """Rows (doc_id, th, score) from features."""
    return found.mapInArrow(_scorer(model), "doc_id long, th long, score double")


def classify(df: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    found = featurised(df, id_col, text_col)
    model = fit(found, labels, max_fit)
    return scored(found, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
