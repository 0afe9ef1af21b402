"""Operators on documents against brute force, with null, empty, long, repeated and clashing rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import linededup, mixing, packing, quality, sharding, simhash, tokencount
from corpusloom.llm.tokencount import public_path
from corpusloom.session import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, h long, th long, size long, fp long, n long, ids string"
BYTES, WORDS = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma,", "delta.", "don't", "Ünïcode", "日本語", "x1y22", "<|endoftext|>", "end", "\u0085", "\x1c"]
    texts = [None, "", " \n ", "one", "two words", "A\tb\nc", "<|endoftext|><|startoftext|>", "İ ſ ǅ ß é", "١٢ ٣", "🙂🙂", "\x1cz q\x1d", "a" * 5000]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    texts += ["\n".join(" ".join(rng.choices(words[:8], k=9)) for _ in range(rng.randint(1, 5))) for _ in range(20)]
    texts += texts[14:20] * 3 + [" ".join(rng.choices(words, k=9000))]
    rows = [(i, t, "en", rng.choice(["a", "b", None, "é"]), 0, 7, 7, 7, 7, 7, 7, 7, "x") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "no id", "en", "a", 0, 7, 7, 7, 7, 7, 7, 7, "x"), (3, "another text of id 3", "en", "b", 0, 7, 7, 7, 7, 7, 7, 7, "x")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(cases, empty):
    rows, df = cases
    tok = Tokenizer.from_file(BYTES)
    want = Counter((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False))) for r in rows)
    got = Counter(tuple(r) for r in tokencount.count_tokens(df, BYTES).select("doc_id", "n_bytes", "n_tokens").collect())
    assert got == want
    assert tokencount.count_tokens(empty, BYTES).count() == 0


def test_pattern_agrees_with_tokenizer():
    tok = Tokenizer.from_file(BYTES)
    for c in [*range(0, 0x3000, 7), *range(0x1F300, 0x1F600, 11), 0x558, 0x208F]:
        ch = chr(c)
        if tokencount.AGREED.fullmatch(ch):
            s = f"a{ch}1{ch}!{ch}  {ch}b"
            assert [s[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(s)] == tokencount.PATTERN.findall(s), hex(c)


def check_packing(rows, pieces, window):
    tok = Tokenizer.from_file(WORDS)
    docs = defaultdict(list)
    for r in rows:
        docs[r[0]].append(np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4"))
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    for k, texts in docs.items():
        ends = Counter()
        for p in got[k]:
            fits = [t for t in texts if len(t) == p.doc_tokens and zlib.crc32(t[p.start : p.start + p.length].tobytes()) == p.ids_crc32]
            assert fits
            ends[p.doc_tokens] += p.length
        assert ends == Counter({n: n * sum(len(t) == n for t in texts) for n in {len(t) for t in texts}})
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding < window


def test_packing(cases, empty):
    rows, df = cases
    check_packing(rows, packing.pack(df, WORDS).collect(), 2048)
    pieces = packing.pack(df, WORDS, window=64, with_ids=True).collect()
    check_packing(rows, pieces, 64)
    assert all(len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    assert packing.pack(empty, WORDS).count() == 0


def test_chunk_encoder_is_exact():
    e = packing.ChunkEncoder(WORDS)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abzÀé'sİ<|endoftext|>́ .,!12ß\n\t \x1cΣЖ中") for _ in range(50)) for _ in range(400)] + ["don't I'VE it's", "ΑΣ ΣΑΣ", ""]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(pa.array(texts), None)] == [e.full.encode(t, add_special_tokens=False).ids for t in texts]


def test_nnls_uses_up_a_histogram():
    h = np.zeros(32)
    h[[10, 22, 8, 16, 3, 9, 20]] = 50, 50, 80, 20, 30, 30, 30
    combos = packing.combinations(32, np.flatnonzero(h))
    assert (combos.sum(axis=1) == 32).all() and len({tuple(c) for c in combos}) == len(combos) and [0, 0, 3, 9, 20] in combos.tolist()
    x = packing.nnls(combos, h)
    used = sum(np.bincount(c, x, 32) for c in combos.T)
    assert (x >= 0).all() and abs(used[1:] - h[1:]).max() < 1
    plan = packing.Plan({n: int(h[n]) for n in np.flatnonzero(h).tolist()}, {}, 32)
    assert plan.placed > 0.95


def test_plan_places_most_remainders():
    rng = np.random.default_rng(2)
    n, c = np.unique(rng.geometric(1 / 600, 4000) % 2048, return_counts=True)
    plan = packing.Plan(dict(zip(n.tolist(), c.tolist())), {}, 2048)
    assert plan.placed > 0.8


BIG = [2**60 + 1, None, 2**53 + 1, -(2**62) - 3, 7]


def test_large_ids_beside_null_ids(spark):
    df = spark.createDataFrame([(i, f"text number {i}", "a") for i in BIG], "doc_id long, text string, source string").coalesce(1)
    lab = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    want = sorted(map(repr, BIG))
    for out in (tokencount.count_tokens(df, BYTES), packing.pack(df, WORDS), quality.classify(df, lab), simhash.near_duplicates(df), mixing.taken(df), sharding.shard(df, 3)):
        assert sorted({repr(r.doc_id) for r in out.select("doc_id").collect()}) == want


def test_packing_of_wide_vocabularies(monkeypatch):
    assert packing.id_type(65_536) == "<u2" and packing.id_type(65_537) == "<u4"
    e = packing.ChunkEncoder(WORDS)
    texts = ["the quick don't, X9 é", "", "a b"]
    want = [e.full.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(packing, "id_type", lambda _: "<u4")
    wide = packing.ChunkEncoder(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in wide.encode(pa.array(texts), None)] == want
    wide.ends[:] = True  # no word can be told from the next: each is encoded by itself
    wide.known = {"": b""}
    assert [np.frombuffer(x, "<u4").tolist() for x in wide.encode(pa.array(texts), None)] == want


def brute_fingerprint(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels_of(adjacent):
    lab = np.arange(len(adjacent))
    while True:
        new = np.where(adjacent, lab[None, :], len(lab)).min(axis=1)
        if (new == lab).all():
            return lab
        lab = new


def test_simhash(cases, empty):
    rows, df = cases
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert Counter(g[:2] for g in got) == Counter((r[0], brute_fingerprint(r[1])) for r in rows)
    f = np.array([g[1] for g in got], np.uint64)
    lab = labels_of(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
    for i, g in enumerate(got):
        ids = [got[j][0] for j in np.flatnonzero(lab == lab[i]) if got[j][0] is not None]
        assert g[2] == (min(ids) if ids else None)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_through_null_ids(spark, monkeypatch):
    rows = [(5, 1, 0), (None, 2, 7), (3, 3, 63), (None, 4, -1), (None, 5, -2), (9, 6, 0x0F0F0F0F), (9, 7, 0x0F0F0F0F00000000)]
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(rows, "doc_id long, th long, fp long"))
    got = {r.th: (r.component_id, r.group) for r in simhash.near_duplicates(spark.range(1)).collect()}
    assert [got[i][0] for i in range(1, 8)] == [3, 3, 3, None, None, 9, 9]
    assert got[1] == got[2] == got[3] and got[4] == got[5] and len({g for _, g in got.values()}) == 4


@pytest.mark.parametrize("group", [20_000, 40, 2])
def test_trie_links_survive_cuts(spark, group):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(1, 4)).tolist()))) for _ in range(12)]
    chain = [base[0] ^ np.uint64((1 << (3 * i)) - 1) for i in range(1, 15)]
    f = np.unique(np.concatenate([base, *[base[:20] ^ x for x in flips], chain]))
    links = simhash.link_groups(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), 3, group).collect()
    at = {int(x): i for i, x in enumerate(f.view(np.int64))}
    found = np.eye(len(f), dtype=bool)
    for a, b in links:
        found[at[a], at[b]] = found[at[b], at[a]] = True
    assert (labels_of(found) == labels_of(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)).all()


def test_trie_walk(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**62, 500).astype(np.uint64)
    f = np.unique(np.concatenate([base, base[:100] ^ np.uint64(5), base[:100] ^ np.uint64(1 << 40)]))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, 1)))}
    assert len(want) > 200
    for front in (16_384, 50):
        monkeypatch.setattr(simhash, "FRONT", front)
        walked = []
        pairs = [(int(a), int(b)) for i, j in simhash.trie_links(f, np.array([0]), np.array([len(f)]), 3, walked=walked) for a, b in zip(i, j)]
        assert set(pairs) == want and len(pairs) == len(want)
        # The walk goes below the top and visits far fewer node pairs than there are pairs of fingerprints.
        assert 1000 < sum(walked) < len(f) ** 2 / 8
    # Groups go down side by side: 40 of 3 to 42 members.
    ends = np.cumsum(np.arange(3, 43))
    g = np.concatenate([np.sort(rng.choice(2**12, n, replace=False)).astype(np.uint64) for n in range(3, 43)])
    of = np.repeat(np.arange(40), np.arange(3, 43))
    near = (np.bitwise_count(g[:, None] ^ g[None, :]) <= 2) & (of[:, None] == of[None, :])
    got = {(int(a), int(b)) for i, j in simhash.trie_links(g, np.concatenate([[0], ends[:-1]]), ends, 2) for a, b in zip(i, j)}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))}


def brute_lines(rows):
    place, first = [], {}
    for r in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate(r[1].split("\n")):
            if re.search(r"[^\s]", line, re.A):
                place.append((r[0], r[1], i, line))
    lines = sorted({p[3] for p in place})
    sets = [linededup.shingles(x) for x in lines]
    lab = labels_of(np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]))
    group = dict(zip(lines, lab))
    for p in place:
        first.setdefault(group[p[3]], []).append(p[:3])
    return place, group, first


def line_case():
    rng = random.Random(9)
    base = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(30)) for _ in range(12)]
    near = [b[:100] + "zz" + b[102:] for b in base[:6]] + [b + " tail" for b in base[3:9]]
    texts = ["\n".join(rng.sample(base + near + ["short", "ab", "  ", ""], rng.randint(1, 6))) for _ in range(40)] + [None, "", "\n\n", base[0], base[0]]
    return [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0]), (5, "ab\n  \nonly here"), (5, "ab\n  \nonly here"), (None, base[1]), (None, None), (None, None)]


def lines_kept(rows):
    """Per row the numbers of the lines it loses, by brute force; of equal rows the first keeps what is kept."""
    place, group, _ = brute_lines(rows)
    best = {}
    for doc, text, i, line in place:
        k = (doc is not None, doc or 0, i)
        best[group[line]] = min(best.get(group[line], (k, doc, text, i)), (k, doc, text, i), key=lambda x: x[0])
    out, seen = [], set()
    for doc, text in rows:
        again = text is not None and (doc, text) in seen
        seen.add((doc, text))
        lost = [i for d, t, i, line in place if (d, t) == (doc, text) and (again or best[group[line]][1:] != (doc, text, i))]
        out.append((doc, len(text.split("\n")) if text is not None else 0, lost))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_line_dedup(spark, empty, tmp_path, monkeypatch, weak):
    if weak:  # a third of all lines share a hash with another
        monkeypatch.setattr(linededup, "line_hash", lambda c: F.pmod(F.xxhash64(c), F.lit(40)))
    rows = line_case()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lid", F.lit(1)).withColumn("h", F.lit(2)).withColumn("line", F.lit("x")).withColumn("dropped_lines", F.lit("old"))
    want = lines_kept(rows)
    got = linededup.dedup_lines(df).collect()
    assert Counter((r.doc_id, tuple(r.dropped_lines)) for r in got) == Counter((d, tuple(lost)) for d, _, lost in want)
    left = lambda t, lost: t if t is None or not lost else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], left(r[1], w[2])) for r, w in zip(rows, want))
    assert len(got[0]) == 6 and {r.h for r in got} == {2}
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    told = linededup.op9_lines(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, told)) == Counter((d, n, len(lost), ",".join(map(str, lost))) for d, n, lost in want)
    assert linededup.dropped_lines(empty).count() == 0 and linededup.dedup_lines(empty).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("corpusloom")]


def test_line_signatures():
    lines = ["ab", "", "abcdefgh", "x" * 40, "the quick brown fox jumps over the lazy dog"]
    one = linededup.signatures(lines)
    assert (one[2] == linededup.signatures(["abcdefgh"])[0]).all() and len({r.tobytes() for r in one}) == 5
    three = ["abcdefghij", "abcdefghijk", "zzzzzzzzzz"]
    j = linededup.jaccard(three, three)
    assert abs(j[0, 1] - 3 / 4) < 1e-6 and j[0, 2] == 0 and j[2, 2] == 1
    rng = random.Random(3)
    some = ["".join(rng.choices("abé", k=rng.randint(0, 40))) for _ in range(30)] + ["ab\0", "ab", "", "abababababab"]
    for more in ([], ["日本語" * 5, "ab日本語abcdefgh"]):
        block = some + more
        sets = [linededup.shingles(x) for x in block]
        want = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
        assert np.abs(linededup.jaccard(block, block[5:]) - want[:, 5:]).max() < 1e-6
        assert all(abs(linededup.similarity(x, y) - want[i, k]) < 1e-12 for i, x in enumerate(block) for k, y in enumerate(block))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_long_runs_are_compared_in_blocks(spark, monkeypatch, batch):
    """Runs over many batches, with lines unlike the one they hang on: chains that only their neighbours link."""
    monkeypatch.setattr(linededup, "BLOCK", 3)
    monkeypatch.setattr(linededup, "SPREAD", 2)
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefgh ", k=200))
    lines = [base[:i] + "#" + base[i + 1 :] for i in range(20, 180, 16)]
    chain = ["".join(rng.choices("abcdefgh ", k=200))]
    for i in range(12):  # each step changes a sixteenth: neighbours link, ends do not
        at = 12 * i
        chain.append(chain[-1][:at] + "".join(rng.choices("stuvwxyz", k=12)) + chain[-1][at + 12 :])
    sets = [linededup.shingles(x) for x in lines + chain]
    lab = labels_of(np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]))
    assert len(set(lab)) == 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame([(i, x) for i, x in enumerate(lines + chain)], "doc_id long, text string").repartition(2)
        assert linededup.dropped_lines(df).count() == len(sets) - 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mixing(cases, empty):
    rows, df = cases
    got = mixing.taken(df).collect()
    sizes = Counter((r[0], r[3], len(re.findall(mixing.WORD, r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == sizes
    per, took, want = Counter(), Counter(), {}
    for r in got:
        per[r.source] += r.size
        took[r.source] += r.taken
        want[r.source] = r.target
        assert r.taken <= 2 * r.size and r.source_size >= r.size
    names = sorted(per, key=lambda s: (s is None, s))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(per.values()), set()
    while True:
        left = total - sum(2 * per[s] for s in full)
        rest = sum(weights[s] for s in names if s not in full)
        target = {s: 2 * per[s] if s in full else left * weights[s] / rest for s in names}
        over = {s for s in names if target[s] > 2 * per[s] + 1e-9}
        if not over:
            break
        full |= over
    for s in names:
        assert abs(want[s] - target[s]) < 1e-6 and abs(took[s] - target[s]) <= 0.5
    assert sorted(map(tuple, mixing.taken(df).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.taken(empty).count() == 0


def test_mix_reads_every_block_once_a_pass(cases):
    _, df = cases
    m = mixing.mix(df).collect()
    blocks = Counter((r.sid, r.pass_no, r.block) for r in {(r.sid, r.pass_no, r.block, r.shard, r.slot): r for r in m}.values())
    assert set(blocks.values()) == {1}
    slots = {(r.shard, r.slot) for r in m}
    assert {a * mixing.SHARD_SLOTS + b for a, b in slots} == set(range(len(slots)))
    assert sum(r.n_words for r in m) == sum(r.taken for r in mixing.taken(df).collect())
    by = {(r.doc_id, r.th): r for r in mixing.taken(df).withColumn("th", F.lit(0)).collect()}
    texts = mixing.mixed_texts(df.where("doc_id > 20")).collect()
    assert texts and all(len(re.findall(mixing.WORD, r.text)) >= 1 for r in texts) and by


def test_shards_draw_multinomial_counts(spark):
    sizes = {0: 400_000, 1: 90_000, 2: 300, 3: 250_000, 4: 1}
    words = {0: 400_000 * 1.7, 1: 180_000, 2: 131, 3: 250_000 * 0.3 + 7, 4: 2}
    sources = spark.createDataFrame([(str(s), n, s, 1.0, float(words[s])) for s, n in sizes.items()], "source string, source_size long, sid int, weight double, target double")
    needed = mixing.quotas(sources)
    quota = {r.sid: r.quota for r in needed.collect()}
    total = sum(quota.values())
    drawn = defaultdict(Counter)
    for r in mixing.shard_counts(needed, total, 5, shard_slots=64).collect():
        drawn[r.shard][r.sid] += r.drawn
    assert [sum(drawn[i].values()) for i in range(len(drawn) - 1)] == [64] * (len(drawn) - 1) and sum(map(lambda c: sum(c.values()), drawn.values())) == total
    # The counts vary from shard to shard as multinomial ones do: variance n p (1 - p).
    p = quota[0] / total
    counts = np.array([drawn[i][0] for i in range(len(drawn) - 1)])
    assert abs(counts.mean() - 64 * p) < 4 * (64 * p * (1 - p) / len(counts)) ** 0.5
    assert 0.6 < counts.var() / (64 * p * (1 - p)) < 1.6
    # The mix has the drawn counts but for what quotas correct, and every quota is met.
    m = mixing.slots(sources, shard_slots=64).collect()
    mixed = defaultdict(Counter)
    for r in m:
        mixed[r.shard][r.sid] += 1
    assert Counter(r.sid for r in m) == quota and sorted((r.shard, r.slot) for r in m) == [(i // 64, i % 64) for i in range(total)]
    moved = sum((drawn[i] - mixed[i]).total() for i in drawn)
    assert 0 < moved < 4 * total**0.5 and drawn.keys() == mixed.keys()
    for s, n in sizes.items():
        took, full = Counter(), Counter()
        for r in m:
            if r.sid == s:
                took[r.pass_no, r.block] += 1
                full[r.pass_no] += min(r.room, n - r.block * mixing.BLOCK_WORDS, mixing.BLOCK_WORDS)
        assert set(took.values()) == {1} and full.total() == round(words[s]) and len(full) <= 2


def test_all_sizes_zero(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.taken(df).collect()] == [(0, 0.0, 0)] * 2


def brute_capacity(sizes, n):
    best = [[0] + [float("inf")] * len(sizes)]
    for _ in range(n):
        row = [0] + [min(max(best[-1][j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(1, len(sizes) + 1)]
        best.append(row)
    return best[-1][-1]


def test_capacity_search():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 14))]
        n = rng.randint(1, 5)
        cap = sharding.least_capacity(sizes, n)
        assert cap == brute_capacity(sizes, n)
        ends = sharding.balanced_ends(sizes, n, cap)
        assert len(ends) == n and ends[-1] == len(sizes) and max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends)) == cap


def test_distributed_cut_has_the_least_capacity(spark, small):
    """Cuts by hash prefixes against the smallest capacity of the real, ordered group sizes."""
    docs = read_table(spark, small, "documents")
    groups = docs.select(F.xxhash64("text").alias("h"), (F.octet_length("text") + 8).cast("long").alias("size"))
    sizes = [r.s for r in sorted(groups.groupBy("h").agg(F.sum("size").alias("s")).collect(), key=lambda r: r.h % 2**64)]
    assert len(sizes) > 100
    for n in (3, 24):
        got = sharding.shard(docs, n).groupBy("shard").agg(F.sum("size").alias("b")).collect()
        loads = sorted((r.b for r in got), reverse=True)
        # Groups over an even share have a shard alone; the others fill theirs up to the least capacity.
        if max(sizes) * n < sum(sizes):
            assert loads[0] == brute_capacity(sizes, n)
        else:
            assert loads[0] == max(sizes)


@pytest.mark.parametrize("n", [1, 4, 24])
def test_sharding(cases, empty, n):
    rows, df = cases
    got = sharding.shard(df, n).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for k, s in where.items() if k[1] > 8)
    assert sharding.shard(empty, n).count() == 0


def test_shards_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(50, 150) + str(i)) for i in range(3000)] + [(5000 + i, "hot" * 30) for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 12)
    per = {r.shard: r.b for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    rest = sorted(per.values())[:-1]
    assert len(per) == 12 and max(per.values()) == 900 * 98 and max(rest) - min(rest) < 0.05 * max(rest)


def test_write_shards(cases, spark, tmp_path):
    rows, df = cases
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


def test_quality(spark, empty):
    rng = random.Random(7)
    good = lambda: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(60)) + "."
    docs = [(i, good() if i % 2 else good().replace(" ", "!! ").upper(), "en", "s") for i in range(600)] + [(1000, None, "en", "s"), (1001, "", "en", "s"), (None, "z", "en", "s"), (0, "again", "en", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(600)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 100 and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.99 * len(held)
    assert {r.score for r in quality.classify(df, lab.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, lab).count() == 0


def test_held_out_labels_are_not_learned(spark):
    df = spark.createDataFrame([(i, "w" * (i % 7 + 1)) for i in range(200)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(zlib.crc32(str(i).encode()) % 3 == 1)) for i in range(200)], "doc_id long, quality int")
    assert len({r.score for r in quality.classify(df, lab).collect()}) == 1


def test_gam_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.NAMES))).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.Gam(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
