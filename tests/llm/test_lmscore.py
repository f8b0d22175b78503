import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chiffra.llm import lmscore

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*SPACE.findall(low), None]


def brute(rows, mus, order):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    uni, grams = Counter(), Counter()

    def contexts_of(seq, t):
        """The contexts of token t, the shortest first; the start is a word before the first one."""
        full = ["<start>", *seq]
        return [tuple(full[t + 1 - n : t + 1]) for n in range(1, order) if t + 1 >= n]

    for i, text in rows:
        if not held(i):
            seq = tokens(text)
            uni.update(seq)
            for t, w in enumerate(seq):
                for c in contexts_of(seq, t):
                    grams[c, w] += 1
    total, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.5) / (total + 0.5 * (v + 1))

    def count(c):
        """How often a context occurs in training: the start once a text, a word as often as it stands, longer ones as n-grams."""
        if len(c) > 1:
            return grams[c[:-1], c[-1]]
        return uni[c[0]] if c[0] != "<start>" else sum(not held(i) for i, _ in rows)

    out = []
    for i, text in rows:
        seq, score = tokens(text), 0.0
        for t, w in enumerate(seq):
            p = p1(w)
            for c in contexts_of(seq, t):
                m = mus[min(len(c) - 1, len(mus) - 1)]
                p = (grams[c, w] + m * p) / (count(c) + m)
            score += math.log10(p)
        out.append((i, held(i), len(seq), sum(uni[w] > 0 for w in seq), total, sum(math.log10(p1(w)) for w in seq), score))
    return out


@pytest.mark.parametrize("per_shard, order", [(50, 2), (2_000_000, 2), (50, 3), (2_000_000, 4)])
def test_scores(spark, per_shard, order):
    texts = ["a b c a b", "A b  c\td", "", None, "zz a", "the cat the dog the end", "a b c a b c a b c d a"] * 5 + ["x " * 4000, "é ü a b c", "a b c a q"]
    rows = list(enumerate(texts)) + [(3, "a b c a b"), (None, "a b"), (None, "a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(3)
    scores, levels = lmscore.train_and_score(df, lmscore.is_held_out(), mu=(2.0, 1.5), tokens_per_shard=per_shard, order=order)
    key = lambda r: (r[0] if r[0] is not None else -1, r[5])
    got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in scores.collect()], key=key)
    want = sorted(brute(rows, (2.0, 1.5), order), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    step = 1 / lmscore.STEPS_PER_DECADE
    for g, w in zip(got, want, strict=True):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert w[6] - step * w[2] - 1e-6 <= g[6] <= w[6] + 1e-6  # codes round down by less than a step
    assert {r["kind"] for r in levels.collect()} == {f"level{k}" for k in range(1, order + 1)}
    assert lmscore.train_and_score(df.limit(0), lmscore.is_held_out())[0].count() == 0


def test_tables_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r[0]: r for r in brute([(r["doc_id"], r["text"]) for r in d.collect()], lmscore.MU, 2)}
    for r in lmscore.op2_lm_scores(spark, "/root/testdata/sf0.001").collect():
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[1:5] and abs(r["base_score"] - w[5]) < 1e-6 * abs(w[5]) + 1e-9
        assert w[6] - r["n_tokens"] / lmscore.STEPS_PER_DECADE - 1e-6 <= r["score"] <= w[6] + 1e-6


def test_held_out_texts_gain(spark):
    out = lmscore.op2_lm_scores(spark, "/root/testdata/sf0.01").toPandas()
    held = out[out["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and len(out) == 1000


def test_elias_fano_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 0), (1, 2**60), (1000, 10), (1000, 2**50), (5000, 5000)):
        v = np.sort(rng.integers(0, top + 1, n).astype(np.uint64))
        data = np.frombuffer(lmscore.EliasFano.of(v).to_bytes(), np.uint8)
        back, size = lmscore.EliasFano.from_bytes(data)
        assert size == len(data) and (back.all() == v).all()
    for v in (np.array([], np.uint64), np.array([0, 255, 256, 2**40 + 1], np.uint64)):
        assert (lmscore.unpack(lmscore.pack(v)) == v).all()


def test_successors_are_found_without_unpacking():
    rng = np.random.default_rng(6)
    for n, top in ((1, 0), (3, 2**60), (1000, 10), (1000, 2**50), (5000, 5000)):
        v = np.sort(rng.integers(0, top + 1, n).astype(np.uint64))
        ask = np.unique(np.concatenate([v, v + np.uint64(1), rng.integers(0, top + 2, 500).astype(np.uint64), np.array([0, 2 * top + 9], np.uint64)]))
        at, equal = lmscore.EliasFano.of(v).successor(ask)
        assert (at == np.searchsorted(v, ask)).all() and (equal == np.isin(ask, v)).all()
        s = lmscore.EliasFano.of(v)
        beside = sum(x.nbytes for x in vars(s).values() if isinstance(x, np.ndarray) and x.base is None and x is not s.low and x is not s.high)
        assert beside <= 4 * (len(s.high) // 8 + 1) and (s.get(np.arange(n)) == v).all()


def test_word_level():
    rng = np.random.default_rng(7)
    words, counts = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64)), rng.integers(1, 9, 500)
    level = lmscore.WordLevel(lmscore.mapped(lmscore.WordLevel.encode(words, counts)))
    ask = np.concatenate([words, words + np.uint64(1)])
    ids, got = level.find(ask)
    assert (got == np.concatenate([counts, 0 * counts])).all() and (ids[:500] == np.cumsum(counts) - counts).all() and (ids[500:] == np.cumsum(counts)).all()
    assert lmscore.WordLevel(lmscore.mapped(lmscore.WordLevel.encode(words[:0], counts[:0]))).find(words[:2])[1].tolist() == [0, 0]


def test_no_table_stays_in_the_catalogue(spark):
    df = spark.createDataFrame([(i, f"a b {i}") for i in range(20)], "doc_id long, text string")
    assert lmscore.train_and_score(df, lmscore.is_held_out())[0].count() == 20
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("chiffra_chunks")]


def test_pair_level_finds_all_pairs_and_no_others(tmp_path):
    rng = np.random.default_rng(4)
    pairs = sorted({(int(b), int(w)) for b, w in zip(rng.integers(0, 40, 900), rng.integers(0, 300, 900))})
    b, w = (np.array(x, np.uint64) for x in zip(*pairs))
    codes = rng.integers(1, 65536, len(b)).astype("<u2")
    (tmp_path / "t").write_bytes(lmscore.PairLevel.encode(b, w, codes))
    level = lmscore.PairLevel.mapped(str(tmp_path / "t"))
    assert (level.find(b, w)[0] == codes).all() and (level.find(b, w)[1] == np.arange(len(b))).all()
    known = dict(zip(pairs, codes))
    qb, qw = rng.integers(0, 45, 3000).astype(np.uint64), rng.integers(0, 310, 3000).astype(np.uint64)
    order = np.argsort(qb, kind="stable")
    qb, qw = qb[order], qw[order]
    assert level.find(qb, qw)[0].tolist() == [int(known.get((int(x), int(y)), 0)) for x, y in zip(qb, qw)]


def test_codes_never_exceed_shares():
    s = np.random.default_rng(5).random(10000) ** 6
    q = lmscore.shares()[lmscore.quantise(s)]
    assert (q <= s * (1 + 1e-6)).all() and lmscore.quantise(np.array([1.0, 0.0])).tolist() == [65535, 0]


@pytest.mark.parametrize("total", [10**6, 2 * 10**8, 10**12])
def test_rare_successors_of_a_huge_context_keep_a_code(total):
    times = np.array([1, 2, 3, 1000, total // 2], np.uint64)
    row = {"shard": 0, "chunk": 0, "contexts": lmscore.pack(np.array([7])), "totals": lmscore.pack(np.array([total])), "runs": lmscore.pack(np.array([5])), "words": lmscore.pack(np.arange(5)), "times": lmscore.pack(times)}
    steps = lmscore.steps_for(total, 500.0)
    out = lmscore._gram_shard(2, 500.0, steps)(pa.Table.from_pylist([row])).to_pylist()
    codes = np.frombuffer(out[0]["a"], "<u2")
    exact = times / (total + 500.0)
    got = lmscore.shares(steps)[codes]
    assert (codes > 0).all() and (got <= exact * (1 + 1e-6)).all() and (np.log10(exact / got) <= 1 / steps + 1e-6).all()
    assert steps == lmscore.STEPS_PER_DECADE or total > 9 * 10**7
