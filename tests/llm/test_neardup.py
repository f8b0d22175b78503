import re

import numpy as np
import pytest

from chiffra.llm import neardup

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = SPACE.findall(low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    ids = sorted(i for i, _ in rows)
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    post = {}
    for i in ids:
        seen = {}
        for s in sets[i]:
            for j in post.setdefault(s, []):
                seen[j] = seen.get(j, 0) + 1
            post[s].append(i)
        for j, n in seen.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_families(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**9)}"
    rows = []
    base = [word() for _ in range(200)]
    for i in range(60):  # edited copies of one text, each far from the others but near to the original
        w = list(base)
        for j in rng.choice(200, 4, replace=False):
            w[j] = word()
        rows.append(" ".join(w))
    rows.append(" ".join(base))
    w = [word() for _ in range(150)]
    for i in range(40):  # a chain: each is near to the next only
        rows.append(" ".join(w))
        w = w[8:] + [word() for _ in range(8)]
    rows += [None, "", " \n", "a b", "A B", "a b c", "one two three four five", "One two  three\tfour FIVE", "x " * 3000]
    rows += [" ".join(base)] * 20
    check(spark, list(enumerate(rows)))


def test_sparse_template_family(spark, monkeypatch):
    """Links run between members that are no centres. Each slot stands in five shingles, so texts link when at most five differ."""
    rng = np.random.default_rng(11)
    values = rng.integers(0, 8, (1500, 12))
    rows = []
    for v in values:
        w = [f"w{i}" for i in range(200)]
        for k in range(12):
            w[8 + 16 * k] = f"s{k}v{v[k]}"
        rows.append(" ".join(w))
    want = np.arange(len(rows))
    near = (values[:, None, :] != values[None, :, :]).sum(axis=2) <= 5
    for _ in rows:
        low = np.where(near, want[None, :], len(rows)).min(axis=1)
        if (low == want).all():
            break
        want = low
    monkeypatch.setattr(neardup, "BLOCK", 100_000, raising=False)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("n, pool, share", [(1500, 24, 0.6), (5000, 30, 0.55)])
def test_shared_paragraphs(spark, n, pool, share):
    """Documents are random subsets of a pool of paragraphs, in its order: many share buckets, few are similar, and every
    link counts (its recall is 1)."""
    rng = np.random.default_rng(n)
    parts = [" ".join(f"p{k}w{j}" for j in range(30)) for k in range(pool)]
    texts = [" ".join(parts[k] for k in range(pool) if x[k]) for x in rng.random((n, pool)) < share]
    sets = [shingles(t) for t in texts]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((n, len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[x] for x in s]] = 1
    size = m.sum(axis=1)
    common = m @ m.T
    near = 100 * common >= 75 * (size[:, None] + size[None, :] - common)
    want = np.arange(n)
    while True:
        low = np.where(near, want[None, :], n).min(axis=1, initial=n)
        low = np.minimum(low, want)
        if (low == want).all():
            break
        want = low
    assert np.triu(near, 1).sum() > 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("shape, words", [((1, 1), 3), ((60, 40), 50), ((200, 150), 4000)])
def test_common_counts(shape, words):
    rng = np.random.default_rng(words)
    a, b = rng.random((shape[0], words)) < 0.1, rng.random((shape[1], words)) < 0.1
    a[:, 1], b[:, 1], a[:, 2], b[:, 2] = True, True, a[:, 0], b[:, 0]
    (rx, fx), (ry, fy) = np.nonzero(a), np.nonzero(b)
    assert (neardup.common_counts(fx, rx, fy, ry, shape) == a.astype(int) @ b.T.astype(int)).all()


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).collect() == []
    rows = [(1, "x " * 200_000 + "y", 5, "en"), (2, "X " * 200_000 + "y", 6, "de"), (None, "x x x x x", 1, None)]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, bands int, component_id string")).collect()}
    assert got == {1: (1, True), 2: (1, False), None: (None, True)}


def test_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()])


def test_kept_rows(spark):
    t = "one two three four five six seven"
    rows = [(3, t, "en"), (3, t, "en"), (5, t, "fr"), (None, t, None), (9, "", None), (None, None, None), (11, "other words here and there", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = neardup.kept_rows(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, -1, 3, 9, 11]
    assert neardup.kept_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 300])
def test_densified_slots_estimate_similarity(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, 4 * n).astype(np.uint64)
    a, b = np.unique(base[: 4 * n]), np.unique(base[:n * 3])
    s = neardup.signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 0.75) < (0.4 if n < 300 else 0.1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500 + i, 499) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 499: 499, **{500 + i: 499 for i in range(1, 50)}}
